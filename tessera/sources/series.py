"""Series as DataFrames: series_id (string), idx (long, gapless from 0), value (double; null, NaN and infinities are
missing samples)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ONE = "0"
#: Up to so many rows one task numbers a series; beyond, ranges of the ordering column are numbered apart.
ONE_TASK_ROWS = 1_000_000


@dataclass(frozen=True)
class Series:
    rows: DataFrame
    single: bool = True

    @staticmethod
    def from_rows(rows: DataFrame, value: str | Column = "value", order_by: str | list[str] = "t", series: str | None = None, idx: str | None = None) -> Series:
        """A series for each value of ``series`` (or one). ``idx`` names a column that numbers the samples already."""
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        value = F.col(value) if isinstance(value, str) else value
        key = F.col(series).cast("string") if series else F.lit(ONE)
        cols = [key.alias("series_id"), value.cast("double").alias("value")]
        if idx:
            return Series(rows.select(*cols, F.col(idx).cast("long").alias("idx")), series is None)
        given = rows.select(*cols, *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
        by = [f"o{i}" for i in range(len(order))]
        numbered = _numbered(given, by, ["series_id"] if series else [])
        return Series(numbered.select("series_id", F.col("idx").cast("long").alias("idx"), "value"), series is None)

    @staticmethod
    def from_values(spark: SparkSession, values: Any, precision: str = "double") -> Series:
        """A series of a sequence of numbers (or of strings that are numbers)."""
        array = np.asarray(values if not isinstance(values, range) else list(values))
        if array.ndim != 1:
            raise ValueError("a series must have one dimension")
        array = array.astype(np.float64)
        if precision == "single":
            with np.errstate(over="ignore"):
                array = array.astype(np.float32).astype(np.float64)
        import pandas as pd

        frame = pd.DataFrame({"series_id": ONE, "idx": np.arange(len(array), dtype=np.int64), "value": array})
        return Series(spark.createDataFrame(frame, "series_id string, idx long, value double"))

    @staticmethod
    def from_arrays(rows: DataFrame, array: str, series: str) -> Series:
        """A series for each row: an array column, named by ``series``."""
        cast = rows.select(F.col(series).cast("string").alias("series_id"), F.posexplode(F.col(array).cast("array<double>")).alias("pos", "value"))
        return Series(cast.select("series_id", F.col("pos").cast("long").alias("idx"), "value"), False)

    @staticmethod
    def of(spark: SparkSession | None, data: Any, precision: str = "double") -> Series:
        """From a Series, a DataFrame (idx, value), (t, value), with or without series_id, or a sequence of numbers."""
        if isinstance(data, DataFrame):
            names = set(data.columns)
            series = "series_id" if "series_id" in names else None
            data = Series.from_rows(data, "value", "t", series, "idx" if "idx" in names else None)
        elif not isinstance(data, Series):
            spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
            return Series.from_values(spark, data, precision)
        if precision == "single":
            return Series(data.rows.withColumn("value", F.col("value").cast("float").cast("double")), data.single)
        return data


def _numbered(rows: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Numbers the rows of each of ``keys`` in the order of ``by``. Many rows are cut at quantiles of the first column:
    each range of each series is numbered by a task of its own, after the counts of those before it, so neither one
    series nor a very long one among others gathers in one task."""
    kind = dict(rows.dtypes)[by[0]]
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz") or kind.startswith("decimal")
    if not numeric or (total := rows.count()) <= ONE_TASK_ROWS:
        return rows.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1)
    ranges = min(4096, 4 * -(-total // ONE_TASK_ROWS))
    timed = kind == "date" or kind.startswith("timestamp")
    first = F.col(by[0]).cast("timestamp").cast("double") if timed else F.col(by[0]).cast("double")
    cuts = rows.select(first.alias("x")).agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 100_000)).first()[0]
    cuts = sorted(set(cuts))
    bounds = rows.sparkSession.createDataFrame([(cuts,)], "cuts array<double>")
    # a binary search among the cuts, as conditions of logarithmic depth
    dealt = rows.withColumn("x", first).join(F.broadcast(bounds)).withColumn("bucket", F.expr(_search("cuts", 0, len(cuts))))
    dealt = dealt.drop("cuts", "x")
    counts = dealt.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(f"own_{k}") for k in keys), F.col("bucket").alias("own_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = dealt.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*by)))
    same = [placed[k].eqNullSafe(starts[f"own_{k}"]) for k in (*keys, "bucket")]
    joined = placed.join(starts if keys else F.broadcast(starts), same)  # one series has at most 4,096 ranges
    return joined.withColumn("idx", F.col("start") + F.col("r") - 1).select(*rows.columns, "idx")


def _search(name: str, low: int, high: int) -> str:
    """SQL for the number of elements below x."""
    if low == high:
        return str(low)
    middle = (low + high) // 2
    return f"if({name}[{middle}] < x, {_search(name, middle + 1, high)}, {_search(name, low, middle)})"
