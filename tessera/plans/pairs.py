"""The join as a Catalyst plan: a relation of window pairs and an aggregate. For short series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import bin_column
from ..functions.windows import normalised
from ..params import JoinParams


def pairs(a: DataFrame, b: DataFrame, p: JoinParams) -> DataFrame:
    """series_id, col_idx (windows of a), row_idx (windows of b), corr of every valid pair outside the exclusion."""
    za = normalised(a, p.m).filter("valid").select("series_id", F.col("i").alias("col_idx"), F.col("z").alias("za"))
    zb = normalised(b, p.m).filter("valid").select("series_id", F.col("i").alias("row_idx"), F.col("z").alias("zb"))
    apart = F.abs(F.col("col_idx") + p.col_offset - F.col("row_idx") - p.row_offset) >= p.exclusion
    if p.kind == "matrix" and p.self_join:
        apart &= F.col("row_idx") <= F.col("col_idx")
    dot = F.expr("aggregate(zip_with(za, zb, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    joined = za.join(zb, "series_id").filter(apart)
    return joined.select("series_id", "col_idx", "row_idx", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)).alias("corr"))


def profile(a: DataFrame, b: DataFrame, p: JoinParams) -> DataFrame:
    """The reduced profile in the form of ``tiles.profile``."""
    found, keys = pairs(a, b, p), ["series_id", "col_idx"]
    windows = lambda s: s.groupBy("series_id").agg((F.count("*") - p.m + 1).alias("n")).filter("n > 0")
    columns = lambda s: windows(s).select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("col_idx"))
    best = F.max(F.struct(F.round("corr", 10).alias("r"), (-F.col("row_idx")).alias("minus"), F.col("corr").alias("corr"))).alias("best")
    if p.kind in ("1nn_index", "1nn"):
        def side(pairs_: DataFrame, s: DataFrame, axis: str) -> DataFrame:
            agg = pairs_.groupBy(*keys).agg(best if p.kind == "1nn_index" else F.max("corr").alias("corr"))
            if p.kind == "1nn_index":
                agg = agg.select(*keys, F.col("best.corr").alias("corr"), (-F.col("best.minus")).alias("row_idx"))
            else:
                agg = agg.withColumn("row_idx", F.lit(None).cast("long"))
            return columns(s).join(agg, keys, "left").select("series_id", F.lit(axis).alias("axis"), "col_idx", "corr", "row_idx")

        out = side(found, a, "a")
        if p.both_axes:
            turned = found.select("series_id", F.col("row_idx").alias("col_idx"), F.col("col_idx").alias("row_idx"), "corr")
            out = out.union(side(turned, b, "b"))
        return out
    if p.kind == "sum":
        total = found.groupBy(*keys).agg(F.sum(F.when(F.col("corr") > p.threshold, F.col("corr")).otherwise(0.0)).alias("corr_sum"))
        return columns(a).join(total, keys, "left").select(*keys, F.coalesce("corr_sum", F.lit(0.0)).alias("corr_sum"))
    if p.kind == "knn":
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("corr", 10)), "row_idx"))
        return found.withColumn("rank", rank.cast("long")).filter((F.col("rank") <= p.k) & (F.col("corr") > p.threshold)).select(*keys, "row_idx", "rank", "corr")
    na, nb = windows(a).select("series_id", F.col("n").alias("na")), windows(b).select("series_id", F.col("n").alias("nb"))
    binned = found.join(na, "series_id").join(nb, "series_id")
    cells = binned.groupBy("series_id", bin_column("row_idx", p.mheight, "nb").alias("bin_row"), bin_column("col_idx", p.mwidth, "na").alias("bin_col")).agg(F.max("corr").alias("corr"))
    return grid(na, p).join(cells, ["series_id", "bin_row", "bin_col"], "left").select("series_id", "bin_row", "bin_col", F.expr(f"if(corr >= {p.threshold!r}D, corr, NULL)").alias("corr"))


def grid(series: DataFrame, p: JoinParams) -> DataFrame:
    """All cells of the matrix of every series."""
    rows = series.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.mheight - 1).cast("long"))).alias("bin_row"))
    return rows.withColumn("bin_col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.mwidth - 1).cast("long"))))
