"""Removal of repeated 400-byte strings by suffix arrays, built one bucket of suffixes at a time.

Suffixes are dealt into buckets by content: a window (the first ``LENGTH`` bytes of a suffix) belongs to the bucket of
its anchor, the 32-byte string in it with the smallest hash (ties: the leftmost). Equal windows have equal anchors at
equal offsets, so they share a bucket, and the windows of one anchor follow each other. So a bucket's entries are
*contexts*: an anchor's place and the run of windows that it stands for.

1. Every task turns texts into anchors (one in 185 bytes) with a hash of their context. Equal contexts are counted,
   with partial counts before the shuffle, so a group of copies is a few rows: all their windows are repeated. An
   anchor that occurs once has no repeated window. This needs no text.
2. Where one anchor has several different contexts, one of each is fetched, and the bucket's suffix array decides.
   Contexts are laid out with their anchors at one residue modulo 31, and the suffixes that start at places in a
   difference cover modulo 31 are ranked first, by doubling (31, 62, ... 496 bytes). Suffixes of a bucket are then
   sorted by their offset, the few bytes up to the next cover place, and the rank there, which resolves long ties.
   Neighbours that agree in ``LENGTH`` bytes mark each other. Blocks of small buckets are sorted together. A bucket
   with very many different contexts (a common passage in different surroundings) is split first, by ranges of
   offsets and the bytes that all windows of a range share. Contexts of a part that is still too large for one task
   are cut into single windows, counted by their hashes as rows, so no bucket has to fit into memory.
3. Marked runs are gathered per document and cut out.

Rows are told apart by doc_id and a hash of the text, so many rows without doc_id are as cheap as others.

Edge cases: a null text is empty; texts shorter than ``LENGTH`` keep everything; a null doc_id is a document like any
other; repeated rows repeat each other; an empty table gives an empty result; texts of any length are taken in
overlapping segments; other columns are ignored; a doc_id must be a whole number or a string of one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, mix64, released, table
from .jaccard_join import _powers

LENGTH, GRAM = 400, 32
PERIOD = 31
#: A difference cover modulo 31: every residue is a difference of two of its members.
COVER = (0, 1, 3, 8, 12, 18)
SEGMENT = 400_000  # bytes taken at once; bounds memory, not results
BLOCK = 400_000  # suffixes sorted at once
#: Buckets with more different contexts than this are split, by ranges of so many offsets; and the most contexts of
#: a part that is sorted in one task.
SPLIT, RANGE, LARGE = 256, 64, 2048
_U = np.uint64


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences, times the inverse power of the start, are hashes of substrings."""
    powers, _, value = _powers(1 << 19)
    return np.concatenate([np.zeros(1, _U), np.cumsum(value[data] * powers[: len(data)], dtype=_U)])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor place, first and last window, anchor hash and context hash, for texts laid end to end.

    The smallest of each window is the smaller of a suffix minimum of one block and a prefix minimum of the next
    (van Herk), of hashes whose low bits are replaced by the place.
    """
    n, inside = len(data), length - GRAM + 1
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    s, inverse = sums(data), _powers(1 << 19)[1]
    grams = mix64((s[GRAM:] - s[:-GRAM]) * inverse[: n - GRAM + 1])
    low = _U((1 << 21) - 1)
    ranked = (grams & ~low) | np.arange(len(grams), dtype=_U)
    blocks = -(-len(ranked) // inside)
    padded = np.full(blocks * inside, ~_U(0), _U)
    padded[: len(ranked)] = ranked
    padded = padded.reshape(blocks, inside)
    before = np.minimum.accumulate(padded, 1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - length + 1
    at = (np.minimum(after[:windows], before[inside - 1 : inside - 1 + windows]) & low).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(windows), side="right")
    whole = np.arange(windows) + length <= ends[doc]
    change = np.flatnonzero((at[1:] != at[:-1]) | (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [windows]]) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    place = at[first]
    context = mix64((s[last + length] - s[first]) * inverse[first] + (place - first).astype(_U) * _U(1 << 32) + (last - first).astype(_U))
    return place, first, last, grams[place], context


def _segments(ids: list, texts: list[bytes]) -> Iterator[list[tuple[object, int, bytes]]]:
    """Groups of (id, start, bytes): whole texts, or overlapping segments of long ones."""
    held, n = [], 0
    for one, text in zip(ids, texts, strict=True):
        if len(text) < LENGTH:
            continue
        for start in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
            part = text[start : start + SEGMENT + LENGTH - 1]
            if n + len(part) > SEGMENT + LENGTH and held:
                yield held
                held, n = [], 0
            held.append((one, start, part))
            n += len(part)
    if held:
        yield held


def anchor_records(docs: DataFrame) -> DataFrame:
    """doc_id, k, h (of the anchor), c (of the context), at (the anchor's place), lo and hi (offsets of its windows)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _segments(range(batch.num_rows), batch.column(2).to_pylist()):
                row, start, size = np.array([g[0] for g in group]), np.array([g[1] for g in group]), np.array([len(g[2]) for g in group])
                ends = np.cumsum(size)
                place, first, last, h, c = anchors(np.frombuffer(b"".join(g[2] for g in group), np.uint8), ends)
                own = np.searchsorted(ends, place, side="right")
                taken = pa.array(row[own])
                numbers = (h.view(np.int64), c.view(np.int64), place + (start - ends + size)[own], (place - last).astype(np.int32), (place - first).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *map(pa.array, numbers)], names=["doc_id", "k", "h", "c", "at", "lo", "hi"])

    return docs.select("doc_id", "k", "bytes").mapInArrow(run, "doc_id long, k long, h long, c long, at long, lo int, hi int")


def meet(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Repeated runs doc_id, k, start, stop of contexts that occur again; and one of each of the contexts (doc_id, k,
    bucket, at, lo, hi, kinds) whose anchor has ``kinds`` different ones, which a suffix array must judge."""
    contexts = records.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k", "at", "lo", "hi")).alias("r"))
    contexts = scratch.table(contexts, "contexts")
    again = records.join(contexts.filter("n > 1").select("h", "c"), ["h", "c"]).select("doc_id", "k", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + LENGTH).alias("stop"))
    kinds = contexts.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    return again.distinct(), contexts.join(kinds, "h").select("r.doc_id", "r.k", F.col("h").alias("bucket"), "r.at", "r.lo", "r.hi", "kinds")


_STEP = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])  # to the next cover place
_PLACE = np.full(PERIOD, -1)
_PLACE[list(COVER)] = range(len(COVER))


class SuffixBlock:
    """The suffixes of the contexts of some buckets: each context is its bytes and the offset of its anchor."""

    def __init__(self, contexts: list[bytes], anchor: list[int]):
        base, at = [], 0
        for text, a in zip(contexts, anchor, strict=True):
            at += -(at + a) % PERIOD
            base.append(at)
            at += len(text)
        rows = at // PERIOD + 2
        data = np.full(rows * PERIOD + 64, 255, np.uint8)  # no byte of UTF-8 is 255
        for b, text in zip(base, contexts, strict=True):
            data[b : b + len(text)] = np.frombuffer(text, np.uint8)
        self.base, self.data = np.array(base), data
        #: The eight bytes from each place on, as a number that sorts as they do.
        self.word = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(">u8").ravel().astype(_U)
        places = (np.arange(rows)[:, None] * PERIOD + np.array(COVER)).ravel()
        self.rank = self._ranks(places, rows)

    def _ranks(self, places: np.ndarray, rows: int) -> np.ndarray:
        w = self.word
        keys = (w[places + PERIOD - 8], w[places + 16], w[places + 8], w[places])
        order = np.lexsort(keys)
        new = np.zeros(len(places), bool)
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        rank = np.empty(len(places), np.int64)
        rank[order] = np.cumsum(new) + 1
        rank, depth = rank.reshape(rows, len(COVER)), 1
        while depth * PERIOD < LENGTH:
            later = np.zeros_like(rank)
            later[:-depth] = rank[depth:]
            _, rank = np.unique((rank << 32) | later, return_inverse=True)
            rank, depth = rank.reshape(rows, len(COVER)) + 1, 2 * depth
        return rank

    def repeated(self, group: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which suffixes agree in LENGTH bytes with another of their group. All of a group have one residue."""
        step = _STEP[start % PERIOD]
        cover = start + step
        rank = self.rank[cover // PERIOD, _PLACE[cover % PERIOD]]
        none, full = _U(0), ~_U(0)
        head = self.word[start] & np.where(step == 0, none, full << (_U(8) * (_U(8) - np.clip(step, 1, 8).astype(_U))))
        more = self.word[start + 8] & np.where(step <= 8, none, full << (_U(8) * (_U(8) - np.clip(step - 8, 1, 8).astype(_U))))
        order = np.lexsort((rank, more, head, group))
        a, b = order[:-1], order[1:]
        pair = np.flatnonzero(group[a] == group[b])
        for k in range(0, LENGTH, 8):
            pair = pair[self.word[start[a[pair]] + k] == self.word[start[b[pair]] + k]]
        found = np.zeros(len(start), bool)
        found[a[pair]] = found[b[pair]] = True
        return found


def bucket_marks(buckets: list[int], contexts: list[bytes], lo: list[int], hi: list[int]) -> list[tuple[int, int, int]]:
    """Runs (context, first window, last window) of repeated windows; windows count from a context's start."""
    block = SuffixBlock(contexts, hi)
    number = np.unique(np.array(buckets), return_inverse=True)[1]
    lows, highs = np.array(lo), np.array(hi)
    out: list[tuple[int, int, int]] = []
    total, step = int((highs - lows + 1).sum()), LENGTH
    if total > BLOCK:
        step = max(1, LENGTH * BLOCK // total)
    for o in range(0, LENGTH, step):
        first, last = np.maximum(lows, o), np.minimum(highs, o + step - 1)
        some = np.flatnonzero(first <= last)
        if len(some) < 2:
            continue
        count = last[some] - first[some] + 1
        context = np.repeat(some, count)
        offset = np.repeat(last[some], count) - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        window = highs[context] - offset
        found = block.repeated(number[context] * LENGTH + offset, block.base[context] + window)
        context, window = context[found], window[found]
        if len(context):
            cut = np.flatnonzero((np.diff(context) != 0) | (np.diff(window) != 1))
            starts, stops = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(context) - 1]])
            out += zip(context[starts].tolist(), window[starts].tolist(), window[stops].tolist(), strict=True)
    return out


MARKS = "doc_id long, k long, start long, stop long"


def judge_buckets(contexts: DataFrame) -> DataFrame:
    """Repeated bytes doc_id, k, start, stop of contexts (bucket, doc_id, k, start, lo, hi, bytes)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def emit() -> pa.RecordBatch:
            bucket, doc, k, start, lo, hi, text = zip(*held, strict=True)
            marks = bucket_marks(bucket, text, lo, hi)
            columns = [doc[c] for c, _, _ in marks], [k[c] for c, _, _ in marks], [start[c] + a for c, a, _ in marks], [start[c] + b + LENGTH for c, _, b in marks]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "k", "start", "stop"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n > BLOCK and row[0] != held[-1][0]:
                    yield emit()
                    held, n = [], 0
                held.append(row)
                n += row[5] - row[4] + 1
        if held:
            yield emit()

    return contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, MARKS)


def count_windows(contexts: DataFrame) -> DataFrame:
    """The same, window by window, from hashes of 64 and 32 bits of the windows of a bucket and offset."""
    window = F.expr(f"substring(bytes, i + 1, {LENGTH})")
    each = contexts.select("*", F.explode(F.sequence(F.lit(0), F.col("hi") - F.col("lo"))).alias("i"))
    each = each.select("bucket", "doc_id", "k", (F.col("start") + F.col("i")).alias("start"), (F.col("hi") - F.col("i")).alias("o"), F.xxhash64(window).alias("x"), F.crc32(window).alias("y"))
    again = each.groupBy("bucket", "o", "x", "y").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return each.join(again, ["bucket", "o", "x", "y"]).select("doc_id", "k", "start", (F.col("start") + LENGTH).alias("stop"))


def split_bucket(text: bytes, w) -> Iterator[tuple[int, int, int]]:
    """A context of a large bucket as (bucket, lo, hi) of smaller ones: for each range of offsets that it reaches, the
    bytes that all windows of that range have in common name the bucket. Equal windows agree in them."""
    for r in range(w["lo"] // RANGE, w["hi"] // RANGE + 1):
        first = w["at"] - r * RANGE
        common = text[first : first + LENGTH - RANGE + 1]
        named = hashlib.blake2b(common, digest_size=8, salt=w["bucket"].to_bytes(8, "little", signed=True), person=r.to_bytes(8, "little")).digest()
        yield int.from_bytes(named, "little", signed=True), max(w["lo"], r * RANGE), min(w["hi"], r * RANGE + RANGE - 1)


def _beside(docs: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """``docs`` with the list ``name`` of each row; Spark may split large parts of either side."""
    lists = lists.withColumnRenamed("doc_id", "own_id").withColumnRenamed("k", "own_k").hint("shuffle_hash")
    return docs.join(lists, docs["doc_id"].eqNullSafe(lists["own_id"]) & (docs["k"] == lists["own_k"]), how).select("doc_id", "k", "bytes", name)


def repeated_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The repeated runs doc_id, k, start, stop of ``docs`` (doc_id, k, bytes), as lists ``marks`` of each doc_id and k."""
    records = scratch.table(anchor_records(docs), "anchors")
    again, judged = meet(records, scratch)
    again = scratch.table(again, "again")
    wanted = judged.groupBy("doc_id", "k").agg(F.collect_list(F.struct("bucket", "at", "lo", "hi", "kinds")).alias("wanted"))
    held = _beside(docs, wanted, "wanted", "inner")

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, k, text, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w in want:
                    split = w["kinds"] > SPLIT
                    for bucket, lo, hi in split_bucket(text, w) if split else [(w["bucket"], w["lo"], w["hi"])]:
                        start, stop = w["at"] - hi, w["at"] - lo + LENGTH
                        for column, x in zip(out, (bucket, doc_id, k, start, lo, hi, text[start:stop], split), strict=True):
                            column.append(x)
            kinds = (*(pa.int64(),) * 4, pa.int32(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=["bucket", "doc_id", "k", "start", "lo", "hi", "bytes", "split"])

    windows = scratch.table(held.mapInArrow(cut, "bucket long, doc_id long, k long, start long, lo int, hi int, bytes binary, split boolean"), "windows")
    scratch.drop("anchors", "contexts")
    large = scratch.table(windows.filter("split").groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("bucket"), "large")
    windows = windows.drop("split")
    runs = again.union(judge_buckets(windows.join(large, "bucket", "left_anti").select("bucket", "doc_id", "k", "start", "lo", "hi", "bytes")))
    if large.take(1):
        runs = runs.union(count_windows(windows.join(large, "bucket")))
    marks = scratch.table(runs.groupBy("doc_id", "k").agg(F.collect_set(F.struct("start", "stop")).alias("marks")), "marks")
    scratch.drop("again", "windows", "large")
    return marks


def remove_repeats(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes: start, stop) and kept (the remaining bytes) of every document."""
    scratch = scratch or Scratch(docs.sparkSession)
    given = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"))
    given = given.withColumn("k", F.xxhash64("bytes")).select("doc_id", "k", "bytes")
    both = _beside(given, repeated_runs(given, scratch), "marks", "left").select("doc_id", "bytes", "marks")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            spans, kept, size = [], [], []
            for text, marked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((m["start"], m["stop"]) for m in marked or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *(x for s in merged for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
