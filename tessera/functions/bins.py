"""Bins of a pooled matrix: window i of n belongs to bin i * bins // n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(index, bins: int, n: int):
    """Of a number or an array of numbers."""
    return index * bins // n


def bin_column(index: str, bins: int, n: str) -> Column:
    return F.expr(f"({index} * {bins}) div {n}")


def bin_bounds(sizes: DataFrame, bins: int) -> DataFrame:
    """bin, start, stop (exclusive) of every bin that holds a window, for each row's ``n``."""
    every = sizes.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    edge = lambda i: F.expr(f"({i} * n + {bins - 1}) div {bins}")  # noqa: E731  rounded up
    return every.select("bin", edge("bin").alias("start"), edge("(bin + 1)").alias("stop")).filter("start < stop")
