import numpy as np

import tessera as T
from tessera.functions.sql import register


def same(a, b, keys):
    read = lambda df: sorted((tuple(r[k] for k in keys), None if r[-1] is None or r[-1] != r[-1] else round(r[-1], 9)) for r in df.select(*keys, df.columns[-1]).collect())
    x, y = read(a), read(b)
    assert x == y and x


def test_every_form(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=90).cumsum(), rng.normal(size=70).cumsum()
    register(spark)
    rows = [("p", "a", i, float(v)) for i, v in enumerate(a)] + [("p", "b", i, float(v)) for i, v in enumerate(b)]
    spark.createDataFrame(rows, "pair string, side string, idx long, value double").repartition(3).createOrReplaceTempView("two_sides")
    spark.sql("SELECT pair AS series_id, idx, value FROM two_sides WHERE side = 'a'").createOrReplaceTempView("one_side")
    one = lambda f, *x: spark.sql(f"SELECT * FROM self_{f}(TABLE(one_side) PARTITION BY (series_id) ORDER BY (idx), 9{''.join(f', {v}' for v in x)})")
    two = lambda f, *x: spark.sql(f"SELECT * FROM ab_{f}(TABLE(two_sides) PARTITION BY (pair) ORDER BY (side, idx), 9{''.join(f', {v}' for v in x)})")
    last = lambda df, c: df.select(*[x for x in df.columns if x != c], c)
    for run, self_join, args in ((one, True, (a,)), (two, False, (a, b))):
        f = lambda name: getattr(T, f"{'self' if self_join else 'ab'}join{name}")
        same(last(run("profile"), "corr"), last(f("")(*args, 9, pearson=True), "corr"), ["col_idx", "row_idx"])
        same(run("values"), f("_1nn")(*args, 9, pearson=True), ["col_idx"])
        same(run("sums", 0.3), f("_sum")(*args, 9, threshold=0.3), ["col_idx"])
        same(run("neighbours", 2, 0.3), f("_knn")(*args, 9, 2, threshold=0.3, pearson=True), ["col_idx", "row_idx"])
        same(run("matrix", 3, 4, 0.2), f("_matrix")(*args, 9, mheight=3, mwidth=4, threshold=0.2, pearson=True), ["bin_row", "bin_col"])
    same(last(two("both"), "corr"), last(T.abjoin_bidirectional(a, b, 9, pearson=True), "corr"), ["axis", "idx", "match_idx"])
    assert spark.sql("SELECT * FROM ab_sums(TABLE(SELECT * FROM two_sides WHERE side = 'a') PARTITION BY (pair) ORDER BY (side, idx), 9, 0.1)").count() == 0
