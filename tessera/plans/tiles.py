"""The join as a grid of tiles: blocks of windows with a halo, joined in pairs, evaluated by an Arrow kernel, merged by
ordinary aggregation.

A block is one row with the samples of its windows (``tile`` windows and m - 1 samples more). A self join evaluates
tiles on and above the diagonal and uses the others' symmetry. Tiles are dealt by their place in the grid, so that no
block or series gathers in one task; a task holds one tile's samples, windows and a bounded chunk of its pairs.

Of a long series a wide block (``group`` blocks) is shipped instead, and a task goes through the tiles of two wide
blocks and merges nearest neighbours and sums before they leave it. So samples and results on disk grow with the number
of wide blocks, which follows the cores, and not with the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.kernel import CHUNK, EXCLUDED, Recurrence, Tile, normalise
from ..params import JoinParams
from .pairs import grid

LEAST, MOST = 256, 8192
WORKING_SET = 256 << 20
WIDEST = 1 << 20  # windows of a wide block


def working_set_bytes(rows: int, cols: int, m: int) -> int:
    """Estimated memory of a dense tile: pairs, windows, and results."""
    if min(rows, cols, m) <= 0:
        raise ValueError("rows, cols and m must be greater than 0")
    return 20 * rows * cols + 16 * (rows + cols) * m + 32 * (rows + cols)


def tile_length(windows: int, m: int, cores: int, max_tile_size: int | None = None, budget: int = WORKING_SET) -> int:
    """Windows of a block: enough tiles for every core several times, windows within the memory budget."""
    length = max(LEAST, min(-(-windows // max(1, isqrt(8 * cores))), MOST))
    # a task holds the windows of two blocks and a chunk of their pairs
    while length > LEAST and working_set_bytes(max(1, CHUNK // length), length, m) + 16 * length * m > budget:
        length = max(LEAST, length // 2)
    if max_tile_size is not None:
        length = min(length, max_tile_size - m + 1)
    return length


def group_length(windows: int, tile: int, cores: int) -> int:
    """Blocks of a wide block: few wide blocks, but pairs of them for every core several times."""
    return max(1, min(windows // (tile * max(1, isqrt(16 * cores))), WIDEST // tile))


def plan_tiles(spark: SparkSession, windows_a: int, windows_b: int, tile: int, self_join: bool) -> DataFrame:
    """The grid: r, c, row_start, rows, col_start, cols, pairs (c >= r for a self join)."""
    gc, gr = -(-windows_a // tile), -(-windows_b // tile)
    cells = spark.range(gr).select(F.col("id").alias("r")).withColumn("c", F.explode(F.sequence(F.col("r") if self_join else F.lit(0).cast("long"), F.lit(gc - 1).cast("long"))))
    return cells.select(
        "r", "c", (F.col("r") * tile).alias("row_start"), F.least(F.lit(tile), F.lit(windows_b) - F.col("r") * tile).cast("long").alias("rows"),
        (F.col("c") * tile).alias("col_start"), F.least(F.lit(tile), F.lit(windows_a) - F.col("c") * tile).cast("long").alias("cols"),
    ).withColumn("pairs", F.col("rows") * F.col("cols"))


def blocks(rows: DataFrame, tile: int, m: int) -> DataFrame:
    """series_id, block, samples, n (windows of the series), from (series_id, idx, value)."""
    own = F.floor(F.col("idx") / tile).cast("int")
    # A sample belongs to its block and, as halo, to earlier ones that end less than m - 1 samples before it.
    reach = F.expr(f"cast(floor((idx - {m - 1}) / {tile}) AS int)")
    spread = rows.select("series_id", "idx", "value", F.explode(F.sequence(F.greatest(reach, F.lit(0)), own)).alias("block"))
    held = spread.groupBy("series_id", "block").agg(F.sort_array(F.collect_list(F.struct("idx", F.coalesce("value", F.lit(float("nan"))).alias("value")))).alias("s"))
    sizes = rows.groupBy("series_id").agg((F.max("idx") + 2 - m).alias("n"))
    return held.join(sizes, "series_id").filter(F.col("block") * F.lit(tile) < F.col("n")).select("series_id", "block", F.expr("transform(s, x -> x.value)").alias("samples"), "n")


def tile_pairs(a: DataFrame, b: DataFrame | None, tile: int, parts: int) -> DataFrame:
    """series_id, c, r, cols, rows, na, nb: every tile with the samples of its two blocks."""
    first = lambda df, c, s, n: df.select("series_id", F.col("block").alias(c), F.col("samples").alias(s), F.col("n").alias(n))
    last = lambda n: F.greatest(F.ceil(F.col(n) / tile).cast("int") - 1, F.lit(0))
    cols, rows = first(a, "c", "cols", "na"), first(b if b is not None else a, "r", "rows", "nb")
    if b is None:
        cols = cols.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("c"))))
        rows = rows.withColumn("c", F.explode(F.sequence(F.col("r"), last("nb"))))
    else:
        size = lambda df, n: df.groupBy("series_id").agg(F.max("n").alias(n))
        cols = cols.join(size(b, "other"), "series_id").withColumn("r", F.explode(F.sequence(F.lit(0), last("other")))).drop("other")
        rows = rows.join(size(a, "other"), "series_id").withColumn("c", F.explode(F.sequence(F.lit(0), last("other")))).drop("other")
    keys = ["series_id", "c", "r"]  # dealt before the join, so that samples are shuffled once
    return cols.repartition(parts, *keys).join(rows.repartition(parts, *keys), keys)


class _Side:
    """What is known so far of the windows of a wide block: nearest neighbours or sums."""

    def __init__(self, first: int, n: int, kind: str):
        self.first, self.kind = first, kind
        self.value, self.at = np.full(n, 0.0 if kind == "sum" else EXCLUDED), np.full(n, -1, np.int64)

    def add(self, first: int, value: np.ndarray, at: np.ndarray | None = None) -> None:
        here = slice(first - self.first, first - self.first + len(value))
        if self.kind == "sum":
            self.value[here] += value
            return
        old, new = (self.value[here], value) if self.kind == "1nn" else (np.round(self.value[here], 10), np.round(value, 10))
        better = (new > old) | ((new == old) & (at < self.at[here]))
        self.value[here][better], self.at[here][better] = value[better], at[better]

    def columns(self, axis: str) -> tuple:
        ids = np.arange(len(self.value)) + self.first
        return (ids, self.value) if self.kind == "sum" else ([axis] * len(ids), ids, self.value, self.at)


_FIELDS = {
    "1nn_index": "series_id string, axis string, col_idx long, corr double, row_idx long",
    "1nn": "series_id string, axis string, col_idx long, corr double, row_idx long",
    "sum": "series_id string, col_idx long, corr_sum double",
    "knn": "series_id string, col_idx long, row_idx long, corr double",
    "matrix": "series_id string, bin_row long, bin_col long, corr double",
}


def evaluate(tile_rows: DataFrame, p: JoinParams, tile: int, group: int = 1) -> DataFrame:
    """Partial results of every pair of wide blocks, in the columns of its kind."""
    names, types = zip(*(x.split() for x in _FIELDS[p.kind].split(", ")), strict=True)
    names, kinds = list(names), [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t] for t in types[1:]]
    wide = tile * group

    def parts(c: int, r: int, na: int, nb: int, cols: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        whole = p.self_join and c == r
        merged, turned = p.kind in ("1nn_index", "1nn", "sum"), p.self_join or p.both_axes
        col_side = _Side(c * wide, len(cols) - p.m + 1, p.kind) if merged else None
        row_side = col_side if whole or not merged else _Side(r * wide, len(rows) - p.m + 1, p.kind)
        for i in range(0, len(cols) - p.m + 1, tile):
            some = cols[i : i + tile + p.m - 1]
            zc, oc = normalise(some, p.m)
            sc = Recurrence.of(some, p.m)
            for j in range(0, min(len(rows) - p.m + 1, i + 1) if whole else len(rows) - p.m + 1, tile):
                same, other = whole and i == j, rows[j : j + tile + p.m - 1]
                zr, orow = (zc, oc) if same else normalise(other, p.m)
                sr = sc if same else Recurrence.of(other, p.m)
                t = Tile(zc, oc, zr, orow, c * wide + i, r * wide + j, p, na, nb, p.kind == "matrix" and p.self_join, sc, sr)
                mirror = p.self_join and not same
                if p.kind == "sum":
                    total, row_total = t.sums(mirror)
                    col_side.add(t.col0, total)
                    if mirror:
                        row_side.add(t.row0, row_total)
                elif merged:
                    best, row_best = t.best(mirror or p.both_axes, p.kind == "1nn_index")
                    col_side.add(t.col0, *best)
                    if mirror or p.both_axes:
                        row_side.add(t.row0, *row_best)
                elif p.kind == "knn":
                    yield from t.nearest(mirror)[: 1 + mirror]
                else:
                    cells = t.cells()
                    yield [a for a, _ in cells], [b for _, b in cells], list(cells.values())
        if merged:
            yield col_side.columns("a")
            if turned and not whole:
                yield row_side.columns("a" if p.self_join else "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                name, c, r, na, nb = (row.column(k)[0].as_py() for k in ("series_id", "c", "r", "na", "nb"))
                cols, rows = (np.asarray(row.column(k).flatten().to_numpy(zero_copy_only=False), float)[: wide + p.m - 1] for k in ("cols", "rows"))
                for part in parts(c, r, na, nb, cols, rows):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part[0]), pa.string()), *(pa.array(x, k) for x, k in zip(part, kinds, strict=True))], names=names)

    return tile_rows.mapInArrow(run, _FIELDS[p.kind])


def profile(a: DataFrame, b: DataFrame, p: JoinParams, tile: int, parts: int, group: int = 1) -> DataFrame:
    """1NN kinds: series_id, axis, col_idx, corr (null without a match), row_idx; sum: series_id, col_idx, corr_sum;
    knn: series_id, col_idx, row_idx, rank, corr; matrix: series_id, bin_row, bin_col, corr (null below threshold)."""
    wide = tile * group
    own = blocks(a, wide, p.m)
    other = None if p.self_join else blocks(b, wide, p.m)
    found = evaluate(tile_pairs(own, other, wide, parts), p, tile, group)
    keys = ["series_id", "col_idx"]
    if p.kind == "1nn_index":
        best = F.max(F.struct(F.round("corr", 10).alias("r"), (-F.col("row_idx")).alias("minus"), F.col("corr").alias("corr"))).alias("x")
        out = found.groupBy("series_id", "axis", "col_idx").agg(best)
        none = F.col("x.corr") == EXCLUDED
        return out.select("series_id", "axis", "col_idx", F.when(~none, F.col("x.corr")).alias("corr"), F.when(~none, -F.col("x.minus")).alias("row_idx"))
    if p.kind == "1nn":
        out = found.groupBy("series_id", "axis", "col_idx").agg(F.max("corr").alias("corr"))
        return out.select("series_id", "axis", "col_idx", F.when(F.col("corr") != EXCLUDED, F.col("corr")).alias("corr"), F.lit(None).cast("long").alias("row_idx"))
    if p.kind == "sum":
        return found.groupBy(*keys).agg(F.sum("corr_sum").alias("corr_sum"))
    if p.kind == "knn":
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("corr", 10)), "row_idx"))
        return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= p.k).select(*keys, "row_idx", "rank", "corr")
    cells = found.groupBy("series_id", "bin_row", "bin_col").agg(F.max("corr").alias("corr"))
    series = a.groupBy("series_id").agg((F.max("idx") + 2 - p.m).alias("n")).filter("n > 0").select("series_id")
    return grid(series, p).join(cells, ["series_id", "bin_row", "bin_col"], "left").select("series_id", "bin_row", "bin_col", F.expr(f"if(corr >= {p.threshold!r}D AND corr > {EXCLUDED}D, corr, NULL)").alias("corr"))
