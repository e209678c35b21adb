"""The joins. A is the columns, B the rows: a profile has an entry for every window of A.

Series are given as a ``Series``, a DataFrame (t or idx, value, optionally series_id) or a sequence of numbers. Results
are DataFrames: series_id comes first if the series have one, then
  selfjoin, abjoin             col_idx, corr | dist, row_idx      NaN and -1 without a match
  selfjoin_1nn, abjoin_1nn     col_idx, corr | dist
  abjoin_bidirectional         axis (a, b), idx, corr | dist, match_idx
  selfjoin_sum, abjoin_sum     col_idx, corr_sum
  selfjoin_knn, abjoin_knn     col_idx, row_idx, rank, corr | dist
  selfjoin_matrix, abjoin_matrix   bin_row, bin_col, corr | dist  NaN below the threshold
``pearson`` chooses corr; otherwise distances sqrt(2 m (1 - corr)). Results are lazy, unless ``verbose`` asks for reports
on standard output or ``progress`` for calls with the tasks done and known: then they are computed at once and kept.
"""

from __future__ import annotations

import itertools
import logging
import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import JoinParams
from ..plans import pairs, tiles
from ..sources.series import Series
from ..tuning import lookup
from .progress import evaluated

log = logging.getLogger("tessera")
_operation = itertools.count(1)
#: Up to so many pairs of windows the Catalyst plan serves; beyond, tiles.
CATALYST_PAIRS = 20_000


def gpu_supported() -> bool:
    """Whether joins can run on a GPU. They run on Spark executors' CPUs."""
    return False


def _sizes(s: Series, m: int, name: str) -> tuple[int, int]:
    """Largest number of windows of a series, and of all series together; every series must hold a window."""
    n = s.rows.groupBy("series_id").agg((F.max("idx") + 1).alias("n"))
    most, least, total = n.agg(F.max("n"), F.min("n"), F.sum(F.col("n") - m + 1)).first()
    if most is None:
        raise ValueError(f"series {name} is empty")
    if least < m:
        raise ValueError(f"m must not exceed the length of series {name}")
    return most - m + 1, total


def _run(a: Any, b: Any, p: JoinParams) -> tuple[DataFrame, bool]:
    a = Series.of(None, a, p.precision)
    b = a if p.self_join else Series.of(a.rows.sparkSession, b, p.precision)
    number, began = next(_operation), time.perf_counter()
    name = f"tessera op={number} {'self' if p.self_join else 'ab'}/{p.kind}"
    say = (lambda text: print(f"{name} {text}", flush=True)) if p.verbose else (lambda text: log.debug("%s %s", name, text))
    say(f"start: m={p.m}")
    try:
        out = _planned(a, b, p, say)
        say(f"planned: {time.perf_counter() - began:.3f} s")
        if p.verbose or p.progress:
            out = evaluated(out, p.progress)
            say(f"completed: {time.perf_counter() - began:.3f} s")
    except Exception as e:
        say(f"error: {type(e).__name__} after {time.perf_counter() - began:.3f} s")
        raise
    return out, a.single


def _planned(a: Series, b: Series, p: JoinParams, say) -> DataFrame:
    spark = a.rows.sparkSession
    (na, all_a), (nb, all_b) = _sizes(a, p.m, "a"), (0, 0)
    nb, all_b = (na, all_a) if p.self_join else _sizes(b, p.m, "b")
    if p.kind == "matrix" and (p.mheight > nb or p.mwidth > na):
        raise ValueError("mheight and mwidth must not exceed the number of windows")
    cores = spark.sparkContext.defaultParallelism
    plan = p.plan if p.plan != "auto" else ("catalyst" if min(na, nb) * max(all_a, all_b) <= CATALYST_PAIRS else "tiles")
    say(f"plan={plan} columns={na} rows={nb}")
    if plan == "catalyst":
        return pairs.profile(a.rows, b.rows, p)
    tuned = lookup(spark, p.kind, max(na, nb), p.m) if p.max_tile_size is None else None
    length = tuned or tiles.tile_length(max(na, nb), p.m, cores, p.max_tile_size)
    group = tiles.group_length(max(na, nb), length, cores)
    wide = length * group
    count = -(-na // wide) * -(-nb // wide) * max(1, all_a // na)
    # pairs of wide blocks are long, so more partitions than pairs keep two of them out of one task
    parts = min(max(cores * 4, count // 64), max(1, count)) if group == 1 else 4 * count
    return tiles.profile(a.rows, b.rows, p, length, int(min(parts, 100_000)), group)


def _value(p: JoinParams, missing: bool = True):
    corr = F.col("corr")
    if p.precision == "single":
        corr = corr.cast("float").cast("double")
    value = corr if p.pearson else F.when(corr.isNotNull(), F.sqrt(F.greatest(2.0 * p.m * (1.0 - corr), F.lit(0.0))))
    return (F.coalesce(value, F.lit(float("nan"))) if missing else value).alias("corr" if p.pearson else "dist")


def _shaped(out: DataFrame, single: bool, *columns) -> DataFrame:
    return out.select(*([] if single else ["series_id"]), *columns)


def _nearest(a: Any, b: Any, p: JoinParams) -> DataFrame:
    out, single = _run(a, b, p)
    if p.both_axes:
        return _shaped(out, single, "axis", F.col("col_idx").alias("idx"), _value(p), F.coalesce("row_idx", F.lit(-1)).cast("long").alias("match_idx"))
    index = [F.coalesce("row_idx", F.lit(-1)).cast("long").alias("row_idx")] if p.kind == "1nn_index" else []
    return _shaped(out, single, "col_idx", _value(p), *index)


def selfjoin(a: Any, m: int, **options: Any) -> DataFrame:
    """For every window the most similar one, further away than the exclusion radius."""
    return _nearest(a, None, JoinParams.of("1nn_index", m, True, options))


def abjoin(a: Any, b: Any, m: int, **options: Any) -> DataFrame:
    """For every window of A the most similar window of B. ``allow_trivial_match=False`` aligns the series and
    excludes pairs as a self join does, at ``col_offset`` and ``row_offset``."""
    return _nearest(a, b, JoinParams.of("1nn_index", m, False, options))


def abjoin_bidirectional(a: Any, b: Any, m: int, **options: Any) -> DataFrame:
    """``abjoin`` both ways from one pass over the pairs."""
    return _nearest(a, b, JoinParams.of("1nn_index", m, False, options).with_(both_axes=True))


def selfjoin_1nn(a: Any, m: int, **options: Any) -> DataFrame:
    """``selfjoin`` without the matches' indices."""
    return _nearest(a, None, JoinParams.of("1nn", m, True, options))


def abjoin_1nn(a: Any, b: Any, m: int, **options: Any) -> DataFrame:
    """``abjoin`` without the matches' indices."""
    return _nearest(a, b, JoinParams.of("1nn", m, False, options))


def _sum(a: Any, b: Any, p: JoinParams) -> DataFrame:
    out, single = _run(a, b, p)
    return _shaped(out, single, "col_idx", "corr_sum")


def selfjoin_sum(a: Any, m: int, **options: Any) -> DataFrame:
    """For every window the sum of its correlations above ``threshold``."""
    return _sum(a, None, JoinParams.of("sum", m, True, options))


def abjoin_sum(a: Any, b: Any, m: int, **options: Any) -> DataFrame:
    return _sum(a, b, JoinParams.of("sum", m, False, options))


def _knn(a: Any, b: Any, p: JoinParams) -> DataFrame:
    out, single = _run(a, b, p)
    return _shaped(out, single, "col_idx", "row_idx", "rank", _value(p, False))


def selfjoin_knn(a: Any, m: int, k: int, **options: Any) -> DataFrame:
    """For every window its k best matches (ties: the smaller index), of those with a correlation above ``threshold``."""
    return _knn(a, None, JoinParams.of("knn", m, True, options, k))


def abjoin_knn(a: Any, b: Any, m: int, k: int, **options: Any) -> DataFrame:
    return _knn(a, b, JoinParams.of("knn", m, False, options, k))


def _matrix(a: Any, b: Any, p: JoinParams) -> DataFrame:
    out, single = _run(a, b, p)
    return _shaped(out, single, "bin_row", "bin_col", _value(p))


def selfjoin_matrix(a: Any, m: int, **options: Any) -> DataFrame:
    """The largest correlation of each cell of an mheight by mwidth grid over the pairs with row <= column."""
    return _matrix(a, None, JoinParams.of("matrix", m, True, options))


def abjoin_matrix(a: Any, b: Any, m: int, **options: Any) -> DataFrame:
    return _matrix(a, b, JoinParams.of("matrix", m, False, options))


def merge_slices(*slices: DataFrame) -> DataFrame:
    """Partial 1NN profiles (col_idx, corr, row_idx) as one: the larger correlation wins, then the smaller row."""
    every = slices[0]
    for s in slices[1:]:
        every = every.unionByName(s)
    valid = every.filter("row_idx >= 0 AND corr IS NOT NULL AND NOT isnan(corr)")
    best = valid.groupBy("col_idx").agg(F.max(F.struct("corr", (-F.col("row_idx")).alias("minus"))).alias("x"))
    merged = every.select("col_idx").distinct().join(best, "col_idx", "left")
    return merged.select("col_idx", F.coalesce("x.corr", F.lit(float("nan"))).alias("corr"), F.coalesce(-F.col("x.minus"), F.lit(-1)).cast("long").alias("row_idx"))
