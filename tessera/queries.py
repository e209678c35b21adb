"""Registered queries over the driver's tables, and the DuckDB SQL for each.

Series are integer totals (cents), so that sums do not depend on their order; correlations are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bins import bin_bounds
from .functions.sql import register
from .functions.windows import normalised
from .operators import profiles as P
from .plans import tiles
from .sources.series import Series

M = 24
_CENTS = "cast(sum(cast(round(value * 100) AS long)) AS double) AS value"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hourly(spark: SparkSession, d: str, kind: str | None = None) -> Series:
    events = _read(spark, d, "events").select("ts", "value", "event_type")
    events = events if kind is None else events.filter(F.col("event_type") == kind)
    return Series.from_rows(events.groupBy(F.date_trunc("hour", "ts").alias("t")).agg(F.expr(_CENTS)))


def gapped(spark: SparkSession, d: str) -> Series:
    """Clicks by hour on the complete grid of hours; hours without any are missing samples."""
    events = _read(spark, d, "events").select("ts", "value", "event_type")
    hour = F.date_trunc("hour", "ts")
    ends = events.agg(F.min(hour).alias("a"), F.max(hour).alias("b"))
    every = ends.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("t"))
    clicks = events.filter("event_type = 'click'").groupBy(hour.alias("t")).agg(F.expr(_CENTS))
    return Series.from_rows(every.join(clicks, "t", "left"))


def by_type(spark: SparkSession, d: str) -> Series:
    events = _read(spark, d, "events").select("ts", "value", "event_type")
    return Series.from_rows(events.groupBy("event_type", F.date_trunc("hour", "ts").alias("t")).agg(F.expr(_CENTS)), series="event_type")


def daily(spark: SparkSession, d: str) -> Series:
    items = _read(spark, d, "lineitem").select("l_shipdate", (F.col("l_extendedprice") * 1).alias("value"))
    return Series.from_rows(items.groupBy(F.date_trunc("day", "l_shipdate").alias("t")).agg(F.expr(_CENTS)))


def clicks(spark: SparkSession, d: str) -> Series:
    return hourly(spark, d, "click")


def views(spark: SparkSession, d: str) -> Series:
    return hourly(spark, d, "view")


def _tidy(df: DataFrame) -> DataFrame:
    """Values rounded, NaN as null."""
    return df.select(*(F.when(~F.isnan(c), F.round(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def raw(spark: SparkSession, d: str) -> Series:
    """The values of all events in order: the long series of the benchmark."""
    return Series.from_rows(_read(spark, d, "events").select("ts", "event_id", "value"), order_by=["ts", "event_id"])


def _udtf(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    hourly(spark, d).rows.createOrReplaceTempView("tessera_hourly")
    return _tidy(spark.sql(f"SELECT col_idx, corr, row_idx FROM self_profile(TABLE(tessera_hourly) PARTITION BY (series_id) ORDER BY (idx), {M})"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    found = normalised(hourly(spark, d).rows, M)
    return found.select("i", F.round("mean", 4).alias("mean"), F.round("norm", 4).alias("norm"), "valid")


def _top(spark: SparkSession, d: str, motif: bool) -> DataFrame:
    found = P.selfjoin(hourly(spark, d), M, pearson=True).filter("row_idx >= 0").withColumn("r", F.round("corr", 6))
    order = [F.desc("r") if motif else F.asc("r"), F.asc("col_idx")]
    return found.orderBy(*order).limit(1).select("col_idx", F.col("r").alias("corr"))


def _count(spark: SparkSession, d: str) -> DataFrame:
    """n, the windows of the hourly series."""
    return hourly(spark, d).rows.agg((F.max("idx") + 2 - M).alias("n"))


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return bin_bounds(_count(spark, d), 7)


def _plan(spark: SparkSession, d: str) -> DataFrame:
    n = _count(spark, d).first().n
    return tiles.plan_tiles(spark, n, n, 128, True).select("r", "c", "row_start", "rows", "col_start", "cols", "pairs")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of A against the two halves of B, merged."""
    b = views(spark, d).rows
    half = 300
    low = P.abjoin(clicks(spark, d), Series(b.filter(F.col("idx") < half + M - 1)), M, pearson=True)
    high = P.abjoin(clicks(spark, d), Series(b.filter(F.col("idx") >= half).withColumn("idx", F.col("idx") - half)), M, pearson=True)
    high = high.withColumn("row_idx", F.when(F.col("row_idx") >= 0, F.col("row_idx") + half).otherwise(-1))
    return _tidy(P.merge_slices(low, high))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = lambda f: lambda s, d: _tidy(f(s, d))
    pearson = {"pearson": True}
    found = {
        "selfjoin_1nn_index": lambda s, d: P.selfjoin(hourly(s, d), M, **pearson),
        "selfjoin_1nn_index_catalyst": lambda s, d: P.selfjoin(hourly(s, d), M, plan="catalyst", **pearson),
        "selfjoin_1nn_index_euclid": lambda s, d: P.selfjoin(hourly(s, d), M),
        "selfjoin_1nn": lambda s, d: P.selfjoin_1nn(hourly(s, d), M, **pearson),
        "selfjoin_exclusion_zone": lambda s, d: P.selfjoin(hourly(s, d), M, exclusion_zone=48, **pearson),
        "abjoin_1nn_index": lambda s, d: P.abjoin(clicks(s, d), views(s, d), M, **pearson),
        "abjoin_1nn": lambda s, d: P.abjoin_1nn(clicks(s, d), views(s, d), M, **pearson),
        "abjoin_aligned": lambda s, d: P.abjoin(clicks(s, d), views(s, d), M, allow_trivial_match=False, **pearson),
        "abjoin_offset_aligned": lambda s, d: P.abjoin(clicks(s, d), views(s, d), M, allow_trivial_match=False, col_offset=3, row_offset=1, **pearson),
        "abjoin_bidirectional": lambda s, d: P.abjoin_bidirectional(clicks(s, d), views(s, d), M, **pearson),
        "selfjoin_sum": lambda s, d: P.selfjoin_sum(hourly(s, d), M, threshold=0.3),
        "abjoin_sum": lambda s, d: P.abjoin_sum(clicks(s, d), views(s, d), M, threshold=0.3),
        "abjoin_sum_aligned": lambda s, d: P.abjoin_sum(clicks(s, d), views(s, d), M, threshold=0.3, allow_trivial_match=False),
        "selfjoin_knn": lambda s, d: P.selfjoin_knn(hourly(s, d), M, 3, threshold=0.3, **pearson),
        "abjoin_knn": lambda s, d: P.abjoin_knn(clicks(s, d), views(s, d), M, 3, threshold=0.3, **pearson),
        "abjoin_knn_aligned": lambda s, d: P.abjoin_knn(clicks(s, d), views(s, d), M, 3, threshold=0.3, allow_trivial_match=False, **pearson),
        "abjoin_knn_keep_rows": lambda s, d: P.abjoin_knn(views(s, d), clicks(s, d), M, 3, threshold=0.3, **pearson),
        "selfjoin_matrix": lambda s, d: P.selfjoin_matrix(hourly(s, d), M, mheight=4, mwidth=5, threshold=-1.0, **pearson),
        "abjoin_matrix": lambda s, d: P.abjoin_matrix(clicks(s, d), views(s, d), M, mheight=4, mwidth=5, threshold=0.3, **pearson),
        "abjoin_matrix_aligned": lambda s, d: P.abjoin_matrix(clicks(s, d), views(s, d), M, mheight=4, mwidth=5, threshold=0.3, allow_trivial_match=False, **pearson),
        "selfjoin_small_window": lambda s, d: P.selfjoin_1nn(hourly(s, d), 3, **pearson),
        "selfjoin_odd_window": lambda s, d: P.selfjoin_1nn(hourly(s, d), 5, **pearson),
        "selfjoin_invalid_windows": lambda s, d: P.selfjoin_1nn(gapped(s, d), 8, **pearson),
        "selfjoin_multi_series": lambda s, d: P.selfjoin(by_type(s, d), M, **pearson),
        "embedding_selfjoin": lambda s, d: P.selfjoin_1nn(Series.from_arrays(_read(s, d, "embeddings"), "embedding", "vec_id"), 8, **pearson),
        "selfjoin_daily_revenue": lambda s, d: P.selfjoin(daily(s, d), 28, **pearson),
        "selfjoin_raw": lambda s, d: P.selfjoin(raw(s, d), 128, **pearson),
        "selfjoin_sum_raw": lambda s, d: P.selfjoin_sum(raw(s, d), 128, threshold=0.3),
    }
    out = {k: q(f) for k, f in found.items()}
    out |= {
        "sql_table_function": _udtf,
        "merge_slices": _merged,
        "window_stats": _stats,
        "tile_plan": _plan,
        "matrix_bins": _bins,
        "motif_top1": lambda s, d: _top(s, d, True),
        "discord_top1": lambda s, d: _top(s, d, False),
    }
    return out


_HOURS = "select {k}date_trunc('hour', ts) as t, cast(sum(cast(round(value * 100) as bigint)) as double) as v from events {w} group by all"
_H = _HOURS.format(k="'0' as k, ", w="")
_C, _V = (_HOURS.format(k="'0' as k, ", w=f"where event_type = '{x}'") for x in ("click", "view"))
_TYPES = _HOURS.format(k="event_type as k, ", w="")
_DAYS = "select '0' as k, date_trunc('day', l_shipdate) as t, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) as v from lineitem group by all"
_GAPS = f"select '0' as k, t, v from (select unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), interval 1 hour)) as t from events) left join ({_C}) using (t)"


def _windows(name: str, rows: str, m: int) -> str:
    """CTEs {name}w (k, i, complete windows) and {name}z (k, i, unit windows)."""
    return f"""
{name}r as (select k, row_number() over (partition by k order by t) - 1 as i, v from ({rows})),
{name}w as (select k, i, w from (select k, i, list(v) over (partition by k order by i rows between current row and {m - 1} following) as w from {name}r) where len(w) = {m}),
{name}c as (select k, i, list_transform(w, lambda x: x - list_sum(w) / {m}) as c from {name}w where len(list_filter(w, lambda x: x is not null)) = {m}),
{name}z as (select k, i, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) as z from {name}c where list_inner_product(c, c) > 1e-13)"""


def _pairs(a: str, b: str | None, m: int, exclusion: int, shift: int = 0, extra: str = "") -> str:
    both = _windows("a", a, m) + ("" if b is None else "," + _windows("b", b, m))
    other = "a" if b is None else "b"
    return f"with {both}, p as (select a.k as k, a.i as col_idx, b.i as row_idx, greatest(-1.0, least(1.0, list_inner_product(a.z, b.z))) as corr from az a join {other}z b on a.k = b.k where abs(a.i - b.i + {shift}) >= {exclusion} {extra})"


def _index(pairs: str, value: str = "round(max(corr), 6) as corr", more: str = "", windows: str = "aw") -> str:
    return f"{pairs} select {more}w.i as col_idx, {value}, coalesce(arg_max(row_idx, (round(corr, 10), -row_idx)), -1) as row_idx from {windows} w left join p on w.k = p.k and w.i = p.col_idx group by w.k, w.i"


def _value_only(pairs: str, more: str = "") -> str:
    return f"{pairs} select {more}w.i as col_idx, round(max(corr), 6) as corr from aw w left join p on w.k = p.k and w.i = p.col_idx group by w.k, w.i"


def _sums(pairs: str) -> str:
    return f"{pairs} select w.i as col_idx, round(coalesce(sum(case when corr > 0.3 then corr else 0 end), 0), 6) as corr_sum from aw w left join p on w.i = p.col_idx group by w.i"


def _nearest(pairs: str) -> str:
    return f"{pairs} select col_idx, row_idx, rank, round(corr, 6) as corr from (select *, row_number() over (partition by col_idx order by round(corr, 10) desc, row_idx) as rank from p) where rank <= 3 and corr > 0.3"


def _cells(pairs: str, threshold: float, b: str) -> str:
    return f"""{pairs}, n as (select (select count(*) from aw) as na, (select count(*) from {b}w) as nb),
c as (select (row_idx * 4) // nb as bin_row, (col_idx * 5) // na as bin_col, max(corr) as corr from p, n group by all)
select g.bin_row, g.bin_col, case when corr >= {threshold} then round(corr, 6) end as corr
from (select r.range as bin_row, c.range as bin_col from range(4) r, range(5) c) g left join c on g.bin_row = c.bin_row and g.bin_col = c.bin_col"""


#: The windows of the hourly series; the pairs of the long one, with windows as arrays of fixed length.
_N = f"select count(distinct date_trunc('hour', ts)) - {M - 1} as n from events"
_LONG = """with r as materialized (select row_number() over (order by ts, event_id) - 1 as i, value as v from events),
w as materialized (select i, list(v) over (order by i rows between current row and 127 following) as w from r),
c as materialized (select i, list_transform(w, lambda x: x - list_sum(w) / 128) as c from w where len(w) = 128),
z as materialized (select i, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c)))::double[128] as z from c),
p as (select a.i as col_idx, b.i as row_idx, array_inner_product(a.z, b.z) as corr from z a join z b on abs(a.i - b.i) >= 32)
"""


def oracle_sql() -> dict[str, str]:
    h, ab, al = _pairs(_H, None, M, 6), _pairs(_C, _V, M, 0), _pairs(_C, _V, M, 6)
    both = ab + ", " + "q as (select k, row_idx as col_idx, col_idx as row_idx, corr from p)"
    return {
        "selfjoin_1nn_index": _index(h),
        "selfjoin_1nn_index_catalyst": _index(h),
        "selfjoin_1nn_index_euclid": _index(h, f"round(sqrt(greatest({2 * M} * (1 - max(corr)), 0)), 6) as dist"),
        "selfjoin_1nn": _value_only(h),
        "selfjoin_exclusion_zone": _index(_pairs(_H, None, M, 48)),
        "abjoin_1nn_index": _index(ab),
        "abjoin_1nn": _value_only(ab),
        "abjoin_aligned": _index(al),
        "abjoin_offset_aligned": _index(_pairs(_C, _V, M, 6, 2)),
        "abjoin_bidirectional": f"""{both} select 'a' as axis, w.i as idx, round(max(corr), 6) as corr, coalesce(arg_max(row_idx, (round(corr, 10), -row_idx)), -1) as match_idx from aw w left join p on w.i = p.col_idx group by w.i
union all select 'b', w.i, round(max(corr), 6), coalesce(arg_max(row_idx, (round(corr, 10), -row_idx)), -1) from bw w left join q on w.i = q.col_idx group by w.i""",
        "selfjoin_sum": _sums(h),
        "abjoin_sum": _sums(ab),
        "abjoin_sum_aligned": _sums(al),
        "selfjoin_knn": _nearest(h),
        "abjoin_knn": _nearest(ab),
        "abjoin_knn_aligned": _nearest(al),
        "abjoin_knn_keep_rows": _nearest(_pairs(_V, _C, M, 0)),
        "selfjoin_matrix": _cells(_pairs(_H, None, M, 6, 0, "and b.i <= a.i"), -1, "a"),
        "abjoin_matrix": _cells(ab, 0.3, "b"),
        "abjoin_matrix_aligned": _cells(al, 0.3, "b"),
        "selfjoin_small_window": _value_only(_pairs(_H, None, 3, 1)),
        "selfjoin_odd_window": _value_only(_pairs(_H, None, 5, 2)),
        "selfjoin_invalid_windows": _value_only(_pairs(_GAPS, None, 8, 2)),
        "selfjoin_multi_series": _index(_pairs(_TYPES, None, M, 6), more="w.k as series_id, "),
        "embedding_selfjoin": _value_only(_pairs("select cast(vec_id as varchar) as k, unnest(embedding) as v, generate_subscripts(embedding, 1) as t from embeddings", None, 8, 2), "w.k as series_id, "),
        "selfjoin_daily_revenue": _index(_pairs(_DAYS, None, 28, 7)),
        "sql_table_function": _index(h),
        "merge_slices": _index(ab),
        "window_stats": f"""with {_windows("a", _H, M)} select w.i as i, round(list_sum(w.w) / {M}, 4) as mean, round(sqrt(list_inner_product(c.c, c.c)), 4) as norm, list_inner_product(c.c, c.c) > 1e-13 as valid from aw w join ac c on w.i = c.i""",
        "tile_plan": f"with n as ({_N}), e as (select n, unnest(range((n + 127) // 128)) as i from n) select r.i as r, c.i as c, r.i * 128 as row_start, least(128, r.n - r.i * 128) as rows, c.i * 128 as col_start, least(128, c.n - c.i * 128) as cols, least(128, r.n - r.i * 128) * least(128, c.n - c.i * 128) as pairs from e r, e c where c.i >= r.i",
        "matrix_bins": f"select (i * 7) // n as bin, min(i) as start, max(i) + 1 as stop from (select n, unnest(range(n)) as i from ({_N})) group by 1",
        "selfjoin_raw": _LONG + "select col_idx, round(max(corr), 6) as corr, arg_max(row_idx, (round(corr, 10), -row_idx)) as row_idx from p group by col_idx",
        "selfjoin_sum_raw": _LONG + "select col_idx, round(sum(case when corr > 0.3 then corr else 0 end), 6) as corr_sum from p group by col_idx",
        "motif_top1": f"with x as ({_index(h)}) select col_idx, corr from x where row_idx >= 0 order by corr desc, col_idx limit 1",
        "discord_top1": f"with x as ({_index(h)}) select col_idx, corr from x where row_idx >= 0 order by corr, col_idx limit 1",
    }
