import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import tessera as T
from tessera.operators.kernel import Tile, normalise
from tessera.params import JoinParams, exclusion_radius
from tessera.plans import tiles
from tessera.sources.series import Series

from . import oracle as O

PLANS = ["catalyst", "tiles"]


def col(df, *names, order="col_idx"):
    return [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df.orderBy(order).select(*names).collect()]


def close(found, expected, tol=1e-9):
    assert len(found) == len(expected)
    for f, e in zip(found, expected, strict=True):
        for x, y in zip(f, e, strict=True):
            assert (x is None and y is None) or (x is not None and y is not None and abs(x - y) <= tol), (f, e)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(42)
    a, b = rng.normal(size=70), rng.normal(size=64)
    a[20], b[33] = np.nan, np.inf
    b[40:50] = 3.0
    return a, b


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("m", [3, 5, 8, 9])
def test_self(spark, series, plan, m):
    a = series[0]
    p = O.pairs(a, a, m, exclusion_radius(m))
    close(col(T.selfjoin(a, m, pearson=True, plan=plan), "corr", "row_idx"), O.best(p))
    close(col(T.selfjoin_1nn(a, m, plan=plan), "dist"), [(None if v is None else math.sqrt(max(2 * m * (1 - v), 0)),) for v, _ in O.best(p)], 1e-6)
    close(col(T.selfjoin_sum(a, m, threshold=0.3, plan=plan), "corr_sum"), [(x,) for x in O.sums(p, 0.3)])
    close(col(T.selfjoin_knn(a, m, 3, threshold=0.1, pearson=True, plan=plan), "col_idx", "row_idx", "rank", "corr", order=["col_idx", "rank"]), O.nearest(p, 3, 0.1))
    found = T.selfjoin_matrix(a, m, mheight=4, mwidth=5, threshold=-1.0, pearson=True, plan=plan)
    cells = {(r.bin_row, r.bin_col): None if math.isnan(r.corr) else r.corr for r in found.collect()}
    expected = O.grid(p, 4, 5, -1.0, upper=True)
    assert set(cells) == set(expected)
    close([(cells[k],) for k in expected], [(v,) for v in expected.values()])


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("aligned", [False, True])
def test_two(spark, series, plan, aligned):
    (a, b), m = series, 7
    p = O.pairs(a, b, m, exclusion_radius(m) if aligned else 0)
    options = {"plan": plan, "allow_trivial_match": not aligned}
    close(col(T.abjoin(a, b, m, pearson=True, **options), "corr", "row_idx"), O.best(p))
    both = T.abjoin_bidirectional(a, b, m, pearson=True, **options)
    close(col(both.filter("axis = 'a'"), "corr", "match_idx", order="idx"), O.best(p))
    close(col(both.filter("axis = 'b'"), "corr", "match_idx", order="idx"), O.best(p.T))
    close(col(T.abjoin_1nn(a, b, m, pearson=True, **options), "corr"), [(v,) for v, _ in O.best(p)])
    close(col(T.abjoin_sum(a, b, m, **options), "corr_sum"), [(x,) for x in O.sums(p, 0.0)])
    close(col(T.abjoin_knn(a, b, m, 4, threshold=-1.0, pearson=True, **options), "col_idx", "row_idx", "rank", "corr", order=["col_idx", "rank"]), O.nearest(p, 4, -1.0))
    cells = {(r.bin_row, r.bin_col): None if math.isnan(r.corr) else r.corr for r in T.abjoin_matrix(a, b, m, mheight=3, mwidth=6, threshold=0.4, pearson=True, **options).collect()}
    expected = O.grid(p, 3, 6, 0.4)
    close([(cells[k],) for k in expected], [(v,) for v in expected.values()])


@pytest.mark.parametrize("plan", PLANS)
def test_offsets_and_zone(spark, series, plan):
    (a, b), m = series, 6
    p = O.pairs(a, b, m, 2, 3, 1)
    close(col(T.abjoin(a, b, m, pearson=True, plan=plan, allow_trivial_match=False, col_offset=3, row_offset=1), "corr", "row_idx"), O.best(p))
    close(col(T.selfjoin(a, m, pearson=True, plan=plan, exclusion_zone=9), "corr", "row_idx"), O.best(O.pairs(a, a, m, 9)))


@pytest.mark.parametrize("plan", PLANS)
def test_ties_take_the_smallest_row(spark, plan):
    a, b = np.tile([0.0, 1, 3, 2], 9), np.tile([0.0, 1, 3, 2], 10)
    both = T.abjoin_bidirectional(a, b, 4, plan=plan)
    for axis in "ab":
        assert all(r.match_idx == r.idx % 4 for r in both.filter(f"axis = '{axis}'").collect())
    found = T.abjoin_knn(np.tile([0.0, 1, 0, -1], 12), np.tile([0.0, 1, 0, -1], 16), 4, 5, threshold=0.99, plan=plan).filter("col_idx = 0")
    assert [r.row_idx for r in found.orderBy("rank").collect()] == [0, 4, 8, 12, 16]


@pytest.mark.parametrize("plan", PLANS)
def test_extremes(spark, plan):
    one = lambda a, b, **k: T.abjoin(a, b, 3, pearson=True, plan=plan, **k).orderBy("col_idx").collect()
    assert one([1e20, 2e20, 3e20], [1e20, 2e20, 3e20])[0].corr == pytest.approx(1)
    flat = one([1e-8, 2e-8, 3e-8], [1e-8, 2e-8, 3e-8])[0]
    assert math.isnan(flat.corr) and flat.row_idx == -1
    mixed = one([1.0, 2, 3, 4, 1e38], [1.0, 2, 3, 4, 1e38])
    assert [r.row_idx for r in mixed] == [0, 0, 2] and all(r.corr == pytest.approx(1) for r in mixed)
    assert one([1.0, 2, 4], [-1.0, -2, -4])[0].corr == pytest.approx(-1)
    high = 1e7 + np.random.default_rng(1).integers(-32, 33, 40)
    close([(r.corr, r.row_idx) for r in one(high, high[::-1])], O.best(O.pairs(high - 1e7, high[::-1] - 1e7, 3)), 1e-6)
    low = np.random.default_rng(2).integers(-32, 33, 40) * 2.0
    close([(r.corr, r.row_idx) for r in one(low + 1e16, low[::-1] + 1e16)], O.best(O.pairs(low, low[::-1], 3)), 1e-9)
    assert math.isnan(one([1e8, 1e8 + 1, 1e8 + 2, 1e8 + 4], [1.0, 2, 3], precision="single")[0].corr)
    assert one([1e8, 1e8 + 1, 1e8 + 2, 1e8 + 4], [1.0, 2, 3])[0].corr == pytest.approx(1)


@pytest.mark.parametrize("plan", PLANS)
def test_short_self_join_has_no_match(spark, plan):
    r = T.selfjoin([0.0, 1, -1], 3, plan=plan).first()
    assert math.isnan(r.dist) and r.row_idx == -1
    assert T.selfjoin_sum([0.0, 1, -1], 3, plan=plan).first().corr_sum == 0
    assert T.selfjoin_knn([0.0, 1, -1], 3, 2, plan=plan).count() == 0
    assert math.isnan(T.selfjoin_matrix([0.0, 1, -1], 3, mheight=1, mwidth=1, plan=plan).first().dist)


@pytest.mark.parametrize("plan", PLANS)
def test_thresholds_are_strict_except_for_the_matrix(spark, plan):
    a, b = [1.0, 0, -1, 0], [0.0, 1, 0, -1]
    assert T.abjoin_knn(a, b, 4, 1, plan=plan).count() == 0
    assert T.abjoin_matrix(a, b, 4, mheight=1, mwidth=1, pearson=True, plan=plan).first().corr == pytest.approx(0, abs=1e-12)
    assert T.selfjoin_sum(np.arange(32.0), 8, threshold=1.0, plan=plan).agg(F.sum("corr_sum")).first()[0] == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("length", [5, 16, 37, 1000])
def test_results_do_not_depend_on_tiles(spark, series, length):
    (a, b), m = series, 8
    A, B = T.Series.of(spark, a).rows, T.Series.of(spark, b).rows
    p = O.pairs(a, a, m, 2)
    found = tiles.profile(A, A, JoinParams.of("1nn_index", m, True, {}), length, 3)
    close(col(found, "corr", "row_idx"), [(v, None if r < 0 else r) for v, r in O.best(p)])
    found = tiles.profile(A, A, JoinParams.of("sum", m, True, {"threshold": 0.2}), length, 3)
    close(col(found, "corr_sum"), [(x,) for x in O.sums(p, 0.2)])
    found = tiles.profile(A, A, JoinParams.of("knn", m, True, {"threshold": -1}, 3), length, 3)
    close(col(found, "col_idx", "row_idx", "rank", "corr", order=["col_idx", "rank"]), O.nearest(p, 3, -1))
    p = O.pairs(a, b, m)
    found = tiles.profile(A, B, JoinParams.of("matrix", m, False, {"mheight": 4, "mwidth": 5, "threshold": -1.0}), length, 3)
    cells = {(r.bin_row, r.bin_col): r.corr for r in found.collect()}
    close([(cells[k],) for k in cells], [(O.grid(p, 4, 5, -1.0)[k],) for k in cells])


def test_many_series(spark):
    rng = np.random.default_rng(2)
    data = {s: rng.normal(size=n) for s, n in (("x", 30), ("y", 44), ("z", 25))}
    rows = spark.createDataFrame([(s, i * 10, float(v)) for s, x in data.items() for i, v in enumerate(x)], "name string, t long, value double")
    found = T.selfjoin(T.Series.from_rows(rows, series="name"), 6, pearson=True, plan="tiles")
    for s, x in data.items():
        close(col(found.filter(f"series_id = '{s}'"), "corr", "row_idx"), O.best(O.pairs(x, x, 6, 2)))
    arrays = spark.createDataFrame([(s, x.tolist()) for s, x in data.items()], "name string, v array<double>")
    again = T.selfjoin(T.Series.from_arrays(arrays, "v", "name"), 6, pearson=True, plan="catalyst")
    close(col(again, "corr", "row_idx", order=["series_id", "col_idx"]), col(found, "corr", "row_idx", order=["series_id", "col_idx"]))


def test_inputs(spark):
    expected = [r.dist for r in T.selfjoin_1nn(list(range(12)), 4).orderBy("col_idx").collect()]
    for values in (range(12), np.arange(24)[::2] / 2, [str(i) for i in range(12)], np.arange(12).astype(object)):
        assert [r.dist for r in T.selfjoin_1nn(values, 4).orderBy("col_idx").collect()] == pytest.approx(expected)
    with pytest.raises(ValueError):
        T.selfjoin(np.zeros((3, 4)), 3)


def test_long_series_are_numbered_in_ranges(spark, monkeypatch):
    import tessera.sources.series as S

    rows = spark.createDataFrame([((i * 7919) % 5003 // 2, (i * 7919) % 5003, float(i)) for i in range(5003)], "t long, u long, value double").repartition(6)
    one = T.Series.from_rows(rows, order_by=["t", "u"]).rows.orderBy("idx").collect()
    monkeypatch.setattr(S, "ONE_TASK_ROWS", 100)
    many = T.Series.from_rows(rows, order_by=["t", "u"]).rows.orderBy("idx").collect()
    assert one == many and [r.idx for r in many] == list(range(5003))


@pytest.mark.parametrize("order", ["t", "d"])
def test_a_long_series_among_others_is_numbered_by_ranges(spark, monkeypatch, order):
    from tessera.sources import series as S

    rows = spark.range(4000).selectExpr("if(id % 10 < 7, 'long', if(id % 10 = 9, null, concat('s', id % 50))) AS series_id", "(id * 7919) % 4001 AS t", "CAST(id AS double) AS value")
    rows = rows.selectExpr("*", "date_add(DATE'2020-01-01', CAST(t AS int)) AS d").repartition(5)
    read = lambda: sorted(map(str, T.Series.from_rows(rows, order_by=order, series="series_id").rows.select("series_id", "idx", "value").collect()))
    one = read()
    monkeypatch.setattr(S, "ONE_TASK_ROWS", 100)
    assert read() == one and len(one) == 4000


def test_merging_slices(spark):
    rows = lambda x: spark.createDataFrame(x, "col_idx long, corr double, row_idx long")
    merged = T.merge_slices(rows([(0, 0.5, 3), (1, float("nan"), -1), (2, 0.1, 9)]), rows([(0, 0.5, 2), (1, 0.2, 4), (3, float("nan"), -1)]))
    assert [(r.row_idx, None if math.isnan(r.corr) else r.corr) for r in merged.orderBy("col_idx").collect()] == [(2, 0.5), (4, 0.2), (9, 0.1), (-1, None)]


def test_tile_plan(spark):
    plan = T.plan_tiles(spark, 697, 697, 128, True).collect()
    assert len(plan) == 21 and all(r.c >= r.r for r in plan) and sum(r.pairs for r in plan if r.c == r.r) + 2 * sum(r.pairs for r in plan if r.c > r.r) == 697 * 697
    assert T.plan_tiles(spark, 300, 697, 128, False).count() == 18
    assert T.working_set_bytes(10, 20, 5) == 20 * 200 + 16 * 30 * 5 + 32 * 30


def test_kernel_excludes_by_global_places():
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    z, ok = normalise(x, 5)
    full = O.pairs(x, x, 5, 2)
    p = JoinParams.of("1nn_index", 5, True, {})
    for r0, c0 in ((0, 0), (10, 3), (3, 10), (30, 0)):
        t = Tile(z[c0 : c0 + 7], ok[c0 : c0 + 7], z[r0 : r0 + 5], ok[r0 : r0 + 5], c0, r0, p)
        found = np.concatenate([c for _, c in t.chunks()])
        assert np.allclose(found, full[r0 : r0 + 5, c0 : c0 + 7])


def test_sql_functions(spark, series):
    from tessera.functions.sql import register

    register(spark)
    T.Series.of(spark, series[0]).rows.createOrReplaceTempView("one_series")
    call = "TABLE(one_series) PARTITION BY (series_id) ORDER BY (idx)"
    p = O.pairs(series[0], series[0], 8, 2)
    close(col(spark.sql(f"SELECT * FROM self_profile({call}, 8)"), "corr", "row_idx"), O.best(p))
    close(col(spark.sql(f"SELECT * FROM self_sums({call}, 8, 0.2)"), "corr_sum"), [(x,) for x in O.sums(p, 0.2)])
    assert spark.sql(f"SELECT * FROM self_neighbours({call}, 8, 2, 0.1)").count() == len(O.nearest(p, 2, 0.1))


@pytest.mark.parametrize("kind, options", [("1nn_index", {}), ("1nn", {}), ("sum", {"threshold": 0.2})])
@pytest.mark.parametrize("self_join", [True, False])
def test_wide_blocks_give_the_same_and_few_partial_rows(spark, kind, options, self_join):
    m, length, n = 8, 16, 150
    rng = np.random.default_rng(4)
    a, b = (Series.from_values(spark, np.round(rng.normal(size=n + m - 1), 1)).rows for _ in range(2))
    p = JoinParams.of(kind, m, self_join, options)
    p = p if self_join or kind == "sum" else p.with_(both_axes=True)
    rows = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)
    assert rows(tiles.profile(a, b, p, length, 3, 4)) == rows(tiles.profile(a, b, p, length, 3))
    own, other = tiles.blocks(a, 4 * length, m), None if self_join else tiles.blocks(b, 4 * length, m)
    partial = tiles.evaluate(tiles.tile_pairs(own, other, 4 * length, 3), p, length, 4)
    assert partial.count() == 3 * n * (2 if p.both_axes else 1)  # three wide blocks, and not ten


def test_wide_blocks_follow_the_cores_and_not_the_length():
    for cores in (1, 6, 64):
        for windows in (2_000_000, 6_000_000):
            wide = 8192 * tiles.group_length(windows, 8192, cores)
            assert -(-windows // wide) <= max(2 * math.isqrt(16 * cores), windows // tiles.WIDEST + 2)
    assert tiles.group_length(100_000, 8192, 8) == 1 and tiles.group_length(10, 256, 8) == 1


def test_sums_of_wide_blocks_equal_the_definition(spark, series):
    a, m = series[0], 8
    A = T.Series.of(spark, a).rows
    found = tiles.profile(A, A, JoinParams.of("sum", m, True, {"threshold": 0.2}), 7, 3, 3)
    close(col(found, "corr_sum"), [(x,) for x in O.sums(O.pairs(a, a, m, 2), 0.2)])
