"""Windows of a series in Catalyst: sliding frames, validity, z-normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import FLAT


def is_sample(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def sliding(rows: DataFrame, m: int) -> DataFrame:
    """series_id, i, w: every window of m samples; missing samples are 0 and make ``complete`` false."""
    frame = Window.partitionBy("series_id").orderBy("idx").rowsBetween(0, m - 1)
    ok = is_sample(F.col("value"))
    held = rows.select("series_id", "idx", F.when(ok, F.col("value")).otherwise(0.0).alias("v"), ok.cast("int").alias("ok"))
    out = held.select("series_id", F.col("idx").alias("i"), F.collect_list("v").over(frame).alias("w"), F.sum("ok").over(frame).alias("n_ok"), F.count("*").over(frame).alias("n"))
    return out.filter(F.col("n") == m).select("series_id", "i", "w", (F.col("n_ok") == m).alias("complete"))


def normalised(rows: DataFrame, m: int) -> DataFrame:
    """series_id, i, mean, norm, valid, z: windows less their mean, over the root of their sum of squares.

    Windows are taken relative to their first sample, so a large common offset costs no digits, and scaled by their
    largest deviation, so that squares neither overflow nor vanish; flatness is tested in the original units. Quarters
    keep differences finite.
    """
    w = sliding(rows, m)
    moved = w.withColumn("q", F.expr("transform(w, x -> x / 4 - w[0] / 4)"))
    scaled = moved.withColumn("scale", F.expr("greatest(array_max(transform(q, x -> abs(x))), 1e-300D)"))
    scaled = scaled.withColumn("u", F.expr("transform(q, x -> x / scale)")).withColumn("mean_u", F.expr(f"aggregate(u, 0D, (s, x) -> s + x) / {m}"))
    centred = scaled.withColumn("c", F.expr("transform(u, x -> x - mean_u)")).withColumn("norm_u", F.expr("sqrt(aggregate(c, 0D, (s, x) -> s + x * x))"))
    valid = F.col("complete") & (F.col("norm_u") > F.sqrt(F.lit(FLAT)) / 4 / F.col("scale"))
    return centred.select(
        "series_id", "i", (F.col("mean_u") * F.col("scale") * 4 + F.col("w")[0]).alias("mean"), (F.col("norm_u") * F.col("scale") * 4).alias("norm"), valid.alias("valid"), F.expr("transform(c, x -> x / norm_u)").alias("z")
    )
