"""Series as text: numbers between white space, over any number of lines. Results as text: a line for each entry."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable
from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import Series

_NUMBER = r"^[+-]?((([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)|nan|NaN|NAN|inf|Inf|INF|infinity|Infinity|INFINITY)$"


def read_series(spark: SparkSession, path: str, precision: str = "double") -> Series:
    """The series in a text file; a token that is no number (or that overflows) raises a ValueError with its line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    tokens = lines.select("block", "line", F.posexplode(F.expr("filter(split(value, '\\\\s+'), t -> t <> '')")).alias("place", "token"))
    lower = F.lower("token")
    special = F.regexp_replace(lower, "^[+-]", "")
    value = (
        F.when(special == "nan", F.lit(float("nan")))
        .when(special.isin("inf", "infinity"), F.when(lower.startswith("-"), float("-inf")).otherwise(float("inf")))
        .when(F.expr(f"token rlike '{_NUMBER}'"), F.expr("try_cast(token AS double)"))
    )
    parsed = tokens.withColumn("number", value).withColumn("special", special.isin("nan", "inf", "infinity"))
    bad = parsed.filter("number IS NULL OR (NOT special AND abs(number) = double('inf'))").orderBy("block", "line", "place").limit(1).collect()
    if bad:
        at = lines.filter((F.col("block") < bad[0].block) | ((F.col("block") == bad[0].block) & (F.col("line") <= bad[0].line))).count()
        raise ValueError(f"{path}: line {at}: {bad[0].token!r} is no number")
    series = Series.from_rows(parsed, "number", ["block", "line", "place"])
    if precision == "single":
        return Series(series.rows.withColumn("value", F.col("value").cast("float").cast("double")))
    return series


def number(x: float | None) -> str:
    return format(float("nan") if x is None else x, ".10g")


def values(df: DataFrame, column: str, order: str = "col_idx") -> Iterable[str]:
    """A value on each line. Rows come to the driver one partition at a time."""
    for row in df.select(order, column).orderBy(order).toLocalIterator():
        yield number(row[column]) if isinstance(row[column], float) or row[column] is None else str(row[column])


def matches(df: DataFrame, value: str) -> Iterable[str]:
    """column row value."""
    for row in df.orderBy("col_idx", "rank").toLocalIterator():
        yield f"{row.col_idx} {row.row_idx} {number(row[value])}"


def matrix(df: DataFrame, value: str) -> Iterable[str]:
    """A line for each row of the grid."""
    line, at = [], 0
    for row in df.orderBy("bin_row", "bin_col").toLocalIterator():
        if row.bin_row != at:
            yield " ".join(line)
            line, at = [], row.bin_row
        line.append(number(row[value]))
    yield " ".join(line)


def write_all(outputs: dict[str, Iterable[str]]) -> None:
    """Writes all files or none: each is staged beside its place and they are put in place together; if that fails,
    those that were there before come back."""
    staged: list[tuple[str, str]] = []
    saved: list[tuple[str, str | None]] = []
    with ExitStack() as clean:
        for path, lines in outputs.items():
            folder = os.path.dirname(os.path.abspath(path))
            handle, name = tempfile.mkstemp(prefix=".tessera-", dir=folder)
            clean.callback(lambda n=name: os.path.exists(n) and os.unlink(n))
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.writelines(f"{x}\n" for x in lines)
                f.flush()
                os.fsync(f.fileno())
            staged.append((name, path))
        try:
            for name, path in staged:
                old = None
                if os.path.lexists(path):
                    handle, old = tempfile.mkstemp(prefix=".tessera-", dir=os.path.dirname(os.path.abspath(path)))
                    os.close(handle)
                    os.replace(path, old)
                saved.append((path, old))
                os.replace(name, path)
        except OSError:
            for path, old in reversed(saved):
                if old is not None:
                    os.replace(old, path)
                elif os.path.lexists(path):
                    os.unlink(path)
            raise
        for _, old in saved:
            if old is not None:
                os.unlink(old)
