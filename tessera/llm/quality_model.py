"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model (words, order 3) is trained on the whole texts of a fixed share of the documents that ``labels`` calls good:
half of them at every size, by a hash of doc_id. The other half sets the thresholds. A caller may ask for less by
``train_docs`` and ``train_chars``; nothing is left out unless it does.

N-grams are counted, discounted and joined with their contexts' counts in Spark. A word's log probability is a sum of
parts that each belong to one n-gram and are 0 for an n-gram that training has not seen::

    log P(w|uv) = log uniform + L1(w) + B2(v) + D2(vw) + B3(uv) + D3(uvw)

with L1 = log(P1 / uniform), B the log of the weight that a context leaves to the lower order, and D = log(1 + own
share / (that weight * probability of the lower order)). So a document is scored by joining its n-grams, counted block
by block, with the table of parts and summing: both sides are dealt into shards of keys, and a task holds the table of
one shard and what the blocks ask of it. The table is written in buckets of shards, so that it lies still while the
blocks' n-grams come to it. Words and n-grams are known by 64-bit hashes (a triple is the pair of its pairs);
neither a vocabulary nor a table is gathered in one place.

Counting and scoring run in slices (of the words that contexts end with, of documents), one after the other, each ending in a written table, so
that the shuffle files of only one slice lie on disk at a time. Slices change no result.

A document's score is its perplexity, smoothed by ``PRIOR`` words at its language's mean so that short texts are not
judged by a few words. The threshold is a quantile of the score, per language, of trusted documents that were not
trained on; a document is kept up to it. Statistics and thresholds use all such documents.

Words are runs without white space, without . , ; : ? ( ) and quotes; case counts.

Edge cases: a null or empty text, or one without words, has no perplexity and is not kept; a null lang is a language
of its own; a language without trusted documents takes the threshold of all; without any trusted document
everything with a word is kept, with the perplexity of a uniform model; repeated rows are judged each (labels count
once per doc_id); an empty table gives an empty result; other columns are ignored; a doc_id
must be a whole number or a string of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, mix64, released, table
from .jaccard_join import word_hashes

#: Millionths of the trusted documents that are trained on.
TRAIN_SHARE = 500_000
QUANTILE, PRIOR = 0.995, 30
#: Words and documents of a block; keys that a shard's table has about, and the least number of shards.
BLOCK_WORDS, BLOCK_DOCS, SHARD_KEYS, LEAST_SHARDS = 400_000, 30_000, 1_000_000, 64
#: Slices of words (the last of contexts) and of documents, where the texts have at least so many bytes a slice.
TRAIN_SLICES, SCORE_SLICES, SLICE_BYTES = 10, 8, 16 << 20
_STRIP = b".,;:?()\"'"
_BEGIN, _NONE = 1, np.uint64((1 << 64) - 1)  # the mark before texts; a key of nothing
_PIECE = 400_000  # bytes hashed at once; bounds memory, not results


def words(text: bytes) -> list[bytes]:
    return text.translate(None, _STRIP).split()


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, in order, and the number of words of each."""
    hashes, numbers, held, of, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [], 0

    def emit() -> None:
        h, own = word_hashes(held)
        hashes.append(h.view(np.int64))
        numbers.append(np.array(of)[own])

    for i, text in enumerate(texts):
        text, start = text.translate(None, _STRIP), 0
        while start < len(text):
            stop = len(text)
            if stop - start > _PIECE:  # cut at white space
                stop = next((at + 1 for at in range(start + _PIECE, len(text)) if text[at] in b" \t\n\x0b\x0c\r"), len(text))
            held.append(text[start:stop])
            of.append(i)
            size, start = size + stop - start, stop
            if size >= _PIECE:
                emit()
                held, of, size = [], [], 0
    if held:
        emit()
    return np.concatenate(hashes), np.bincount(np.concatenate(numbers), minlength=len(texts))


def _key(*parts: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the hashes of their words."""
    key = mix64(parts[0].astype(np.int64).view(np.uint64))
    for p in parts[1:]:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.int64).view(np.uint64))
    return key


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    """Rises with the key."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _marked(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts of ``n`` words, each text after two beginning marks; their texts; and where texts
    begin."""
    starts = np.cumsum(n + 2) - n - 2
    ids = np.full(int((n + 2).sum()), _BEGIN, np.int64)
    own = np.ones(len(ids), bool)
    own[starts] = own[starts + 1] = False
    ids[own] = hashes
    return ids, np.repeat(np.arange(len(n)), n + 2), starts


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Of this process: making one takes longer than most of what it compresses."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _bytes(x: np.ndarray) -> bytes:
    """Compressed, the first bytes of all numbers first."""
    return _zstd()[0].compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes())


def _numbers(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(_zstd()[1].decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@dataclass
class Model:
    """``parts``: packed rows, in buckets by shard, of which one shard may have several: keys (rising, as differences), a
    (as the end of what is predicted), b (as its context; empty where it is 0 for all). Those of equal keys add up."""

    parts: DataFrame
    shards: int
    uniform: float
    texts: DataFrame
    scratch: Scratch

    @property
    def vocabulary(self) -> list[bytes]:
        """The distinct words, gathered; for tests and small samples only."""

        @released
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(0).to_pylist() for w in words(t or b"")}), pa.binary())], names=["w"])

        return sorted(self.texts.mapInArrow(split, "w binary").distinct().toArrow().column(0).to_pylist())


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney, for counts 1, 2 and more."""
    found = dict(counts.filter("c <= 4").groupBy("c").count().collect())
    n1, n2, n3, n4 = (found.get(k, 0) for k in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), k + 0.9) for k, d in enumerate(raw)]


def _cut_off(d: list[float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def _left(counts: DataFrame, context: list[str], d: list[float]) -> tuple[DataFrame, DataFrame]:
    """From counts with c: p, the discounted count; and by ``context`` total and g, the weight left for the lower order."""
    cut = _cut_off(d)
    sums = counts.groupBy(*context).agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("g"))
    return counts.withColumn("p", F.col("c") - cut), sums


def _slices(docs: DataFrame, most: int) -> int:
    return int(min(most, 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES))


def _packed(keyed: DataFrame, shards: int) -> DataFrame:
    """Packed rows of the model from key, a, b."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n > 1_000_000:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    def pack(held: list) -> pa.RecordBatch:
        key, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        key = key.view(np.uint64)
        order = np.argsort(key)
        key, a, b = key[order], a[order], b[order]
        shard = _shard(key, shards)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        ends = [*cuts[1:], len(key)]
        rows = [(int(shard[i]), _bytes(np.diff(key[i:j], prepend=np.uint64(0))), _bytes(a[i:j]), _bytes(b[i:j]) if b[i:j].any() else b"") for i, j in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *(pa.binary(),) * 3), strict=True)], names=["shard", "keys", "a", "b"])

    return keyed.mapInArrow(run, "shard int, keys binary, a binary, b binary")


def train(texts: DataFrame, scratch: Scratch) -> Model:
    """A model of the column ``text``."""
    texts = bounded_batches(texts).select(F.col("text").cast("string").cast("binary").alias("text"))
    slices = _slices(texts, TRAIN_SLICES)

    @released
    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, n = hashed([t or b"" for t in batch.column(0).to_pylist()])
            n = n[n > 0]
            ends = np.cumsum(n)
            for i, j in _cut(n):
                yield pa.RecordBatch.from_arrays([pa.array([_marked(hashes[ends[i] - n[i] : ends[j - 1]], n[i:j])[0].tobytes()], pa.binary())], names=["ids"])

    ids_table = scratch.table(texts.mapInArrow(marked, "ids binary"), "ids")

    def each(j: int, make, ddl: str) -> DataFrame:
        """Columns from the ids and the places of words that follow a word of slice ``j``."""
        names = [x.split(" ")[0] for x in ddl.split(", ")]

        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    ids = np.frombuffer(block, np.int64)
                    at = np.flatnonzero(ids != _BEGIN)
                    at = at[_shard(_key(ids[at - 1]), slices) == j]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in make(ids, at)], names=names)

        return ids_table.mapInArrow(run, ddl)

    def triples(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        h, k = _key(ids[at - 2], ids[at - 1]), _key(ids[at - 1], ids[at])
        _, first, n = np.unique(_key(h, k), return_index=True, return_counts=True)
        return h[first], k[first], n

    def pairs(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        k, first = np.unique(_key(ids[at - 1], ids[at]), return_index=True)
        return k, ids[at - 1][first], ids[at][first]

    def together(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, tables)

    of_h, c3, c2 = Window.partitionBy("h"), [], []
    for j in range(slices):
        counted = each(j, triples, "h long, k long, n long").repartition("h").groupBy("h", "k").agg(F.sum("n").alias("c"))
        whole = {"total": F.sum("c"), "n1": F.count_if(F.col("c") == 1), "n2": F.count_if(F.col("c") == 2), "n": F.count("*"), "least": F.min("k")}
        whole = counted.select("h", "k", "c", *(x.over(of_h).alias(name) for name, x in whole.items()))
        c3.append(scratch.table(whole.withColumn("first", F.col("k") == F.col("least")).drop("least"), f"c3-{j}"))
        known = each(j, pairs, "k long, v long, w long").groupBy("k").agg(F.first("v").alias("v"), F.first("w").alias("w"))
        c2.append(scratch.table(c3[j].groupBy("k").agg(F.count("*").alias("c")).join(known, "k"), f"c2-{j}"))
    scratch.drop("ids")
    c1 = scratch.table(together(c2).groupBy("w").agg(F.count("*").alias("c")), "c1")
    n1, d1, d2, d3 = c1.count(), discounts(c1), discounts(together(c2)), discounts(together(c3))
    shards = max(LEAST_SHARDS, (together(c3).count() + together(c2).count() + n1) // SHARD_KEYS)
    r1, s1 = _left(c1, [], d1)
    top = s1.first()
    uniform = (top.g if n1 else 1.0) / (n1 + 1)  # every word and the unknown one
    p1 = r1.select("w", (F.col("p") / F.lit(top.total or 1) + F.lit(uniform)).alias("p1"))

    def parts(df: DataFrame, key: Column, a: Column, b: Column) -> DataFrame:
        return df.select(key.cast("long").alias("key"), a.cast("float").alias("a"), b.cast("float").alias("b"))

    def keyed(df: DataFrame, *names: str) -> DataFrame:
        """``df`` with key, made of the columns ``names`` as scoring makes it."""

        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = _key(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns[len(names) :]], names=["key", "a", "b"])

        return df.select(*names, "a", "b").mapInArrow(run, "key long, a float, b float")

    zero = F.lit(0.0).cast("float")

    def made() -> Iterator[DataFrame]:
        """key, a, b of words, then of each slice; a slice's counts go when it is written."""
        yield keyed(p1.select("w", F.log(F.col("p1") / F.lit(uniform)).cast("float").alias("a"), zero.alias("b")), "w")
        for j in range(slices):
            r2, s2 = _left(c2[j], ["v"], d2)
            r3 = c3[j].withColumn("g", (d3[0] * F.col("n1") + d3[1] * F.col("n2") + d3[2] * (F.col("n") - F.col("n1") - F.col("n2"))) / F.col("total"))
            low = r2.join(s2, "v").join(p1, "w").select("k", (F.col("p") / F.col("total")).alias("own"), (F.col("g") * F.col("p1")).alias("low"))
            p2 = scratch.table(low.select("k", (F.col("own") + F.col("low")).alias("p2"), F.log1p(F.col("own") / F.col("low")).cast("float").alias("d2")), f"p2-{j}")
            odds = r3.select("h", "k", ((F.col("c") - _cut_off(d3)) / F.col("total") / F.col("g")).alias("odds"))  # few columns for the shuffle
            own = odds.join(p2, "k").select("h", "k", F.log1p(F.col("odds") / F.col("p2")).cast("float").alias("a"), zero.alias("b"))
            contexts = keyed(s2.select("v", zero.alias("a"), F.log("g").cast("float").alias("b")), "v").union(parts(r3.filter("first"), F.col("h"), zero, F.log("g")))
            yield keyed(own, "h", "k").union(contexts).union(parts(p2, F.col("k"), F.col("d2"), zero))
            scratch.drop(f"c3-{j}", f"c2-{j}", f"p2-{j}")

    model = scratch.bucketed((_merged(_packed(df, shards)) for df in made()), "model", "shard", shards)
    return Model(model, shards, uniform, texts, scratch)


def _merged(parts: DataFrame) -> DataFrame:
    """One packed row for each shard, with the sums of equal keys."""

    def joined(shard: int, held: list) -> pa.RecordBatch:
        keys, a, b = _added(held)
        a, b = a.astype(np.float32), b.astype(np.float32)
        row = shard, _bytes(np.diff(keys, prepend=np.uint64(0))), _bytes(a), _bytes(b) if b.any() else b""
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), *(pa.binary(),) * 3), strict=True)], names=["shard", "keys", "a", "b"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for shard, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and shard != at:
                    yield joined(at, held)
                    held = []
                at = shard
                held.append(_unpacked(*packed))
        if held:
            yield joined(at, held)

    return parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, keys binary, a binary, b binary")


def _added(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, each once and rising, and the sums of their a and b, from tables of keys that rise and differ."""
    keys = np.sort(np.concatenate([k for k, _, _ in held]))
    keys = keys[np.diff(keys, prepend=~keys[:1]) != 0]
    sums = np.zeros(len(keys)), np.zeros(len(keys))
    for key, *values in held:
        at = np.searchsorted(keys, key)
        for x, v in zip(sums, values, strict=True):
            x[at] += v
    return keys, *sums


def _unpacked(keys: bytes, a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.cumsum(_numbers(keys, np.uint64), dtype=np.uint64)
    return keys, _numbers(a, np.float32), _numbers(b, np.float32) if b else np.zeros(len(keys), np.float32)


_ROWS = "shard int, block long, docs binary, counts binary, keys binary, ids array<long>, langs array<string>, n_words array<long>"
_SUMS = "block long, shard int, docs binary, sums binary, ids array<long>, langs array<string>, n_words array<long>"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[dict], ddl: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in fields], names=[n for n, _ in fields])


def _cut(size: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of texts with about ``BLOCK_WORDS`` words and at most ``BLOCK_DOCS`` texts."""
    out, a, total = [], 0, 0
    for i, n in enumerate(size):
        if i > a and (total + n > BLOCK_WORDS or i - a >= BLOCK_DOCS):
            out.append((a, i))
            a, total = i, 0
        total += n
    return [*out, (a, len(size))] if len(size) else out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_words, nll (negative log probability of all words); written, slice by slice."""
    slices, scored = _slices(docs.select(F.col("text").cast("string").alias("text")), SCORE_SLICES), None
    given = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string").cast("binary"))
    for j in range(slices):
        own = given.filter(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(slices)) == j) if slices > 1 else given
        part = model.scratch.table(_score(own, model), f"scores-{j}")
        scored = scored.union(part) if scored else part
    return scored


def _score(given: DataFrame, model: Model) -> DataFrame:
    shards, uniform = model.shards, float(np.log(model.uniform))

    @released
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            hashes, n = hashed([t or b"" for t in batch.column(2).to_pylist()])
            ends = np.cumsum(n)
            for i, j in _cut(n):
                meta = {"shard": block % shards, "block": block, "ids": batch.column(0)[i:j].to_pylist(), "langs": batch.column(1)[i:j].to_pylist(), "n_words": n[i:j].tolist()}
                yield _batch([meta, *({"block": block, **r} for r in asked(hashes[ends[i] - n[i] : ends[j - 1]], n[i:j]))], _ROWS)
                block += 1

    def asked(hashes: np.ndarray, n: np.ndarray) -> Iterator[dict]:
        """By shard: the distinct keys of the texts' n-grams, how often each occurs, and where (2 * text, + 1 for a
        text's last word or pair, which is no context)."""
        ids, doc, starts = _marked(hashes, n)
        keep = n[doc] > 0
        last = np.zeros(len(ids), np.int64)
        last[np.append(starts[1:], len(ids)) - 1] = 1
        second, third = keep.copy(), keep.copy()
        second[starts] = third[starts] = third[starts + 1] = False
        one = np.flatnonzero(second)  # the second mark and the words
        three = np.flatnonzero(third)
        pair = _key(ids[:-1], ids[1:])
        key = np.concatenate([_key(ids[one]), pair[one - 1], _key(pair[three - 2], pair[three - 1])])
        where = np.concatenate([2 * doc[one] + last[one], 2 * doc[one] + last[one], 2 * doc[three]]).astype(np.uint16)
        order = np.argsort(key)
        key, where = key[order], where[order]
        if not len(key):
            return
        first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        counts, key = np.diff(first, append=len(key)).astype(np.uint32), key[first]
        shard = _shard(key, shards)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(key)], strict=True):
            a, b = first[i], first[j] if j < len(key) else len(where)
            yield {"shard": int(shard[i]), "keys": _bytes(np.diff(key[i:j], prepend=np.uint64(0))), "counts": _bytes(counts[i:j]), "docs": _bytes(where[a:b])}

    def look_up(model: pa.Table, asked: pa.Table) -> pa.Table:
        """For each block the sums of its texts in one shard."""
        known, a, b = np.full(1, _NONE), np.zeros(1), np.zeros(1)
        if len(model) and len(asked):
            held = [_unpacked(*(model.column(n)[i].as_py() for n in ("keys", "a", "b"))) for i in range(len(model))]
            known, a, b = (np.append(x, end) for x, end in zip(_added(held), (_NONE, 0, 0), strict=True))
        out = []
        for batch in asked.to_batches():
            for r in batch.to_pylist():
                if r["keys"] is None:
                    out.append(r)
                    continue
                keys, where = np.cumsum(_numbers(r["keys"], np.uint64), dtype=np.uint64), _numbers(r["docs"], np.uint16)
                place = np.searchsorted(known, keys)
                place[known[place] != keys] = len(known) - 1  # nothing
                place = np.repeat(place, _numbers(r["counts"], np.uint32))
                sums = np.bincount(where >> 1, weights=a[place] + b[place] * (1 - (where & 1).astype(np.int64)))
                some = np.flatnonzero(sums)
                out.append({"block": r["block"], "shard": r["shard"], "docs": some.astype(np.uint16).tobytes(), "sums": sums[some].tobytes()})
        return pa.Table.from_batches([_batch(out, _SUMS)])

    def total(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["shard"])
        meta = next(r for r in rows if r["ids"] is not None)
        n = np.array(meta["n_words"], np.int64)
        logs = n * uniform
        for r in rows:
            if r["sums"] is not None:
                logs[np.frombuffer(r["docs"], np.uint16)] += np.frombuffer(r["sums"], np.float64)
        return pa.table({"doc_id": pa.array(meta["ids"], pa.int64()), "lang": pa.array(meta["langs"], pa.string()), "n_words": n, "nll": np.round(0.0 - logs, 6)})

    asked_of = given.mapInArrow(blocks, _ROWS).groupBy("shard")
    summed = model.parts.groupBy("shard").cogroup(asked_of).applyInArrow(look_up, _SUMS)
    return summed.groupBy("block").applyInArrow(total, "doc_id long, lang string, n_words long, nll double")


def quantiles(rows: DataFrame, q: float) -> DataFrame:
    """lang_key and the exact quantile ``threshold`` of perplexity (between two values, in proportion), and a row for
    all with lang_key null. Values are counted in classes of a ten-thousandth of their logarithm, a bounded number;
    then only those of the one or two classes that hold the quantile are counted one by one."""
    rows = rows.select("lang_key", "perplexity", F.floor(F.log("perplexity") * 10_000).alias("class"))
    both = lambda df: df.union(df.withColumn("lang_key", F.lit(None).cast("string")))
    counted = rows.groupBy("lang_key", "class").agg(F.count("*").alias("n"))
    counted = both(counted).groupBy("lang_key", "class").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("lang_key").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("at", q * (F.sum("n").over(Window.partitionBy("lang_key")) - 1))
    chosen = placed.filter((F.col("upto") > F.floor("at")) & (F.col("upto") - F.col("n") <= F.ceil("at"))).select(F.col("lang_key").alias("key"), F.col("class").alias("of"), (F.col("upto") - F.col("n")).alias("before"), "at")
    inside = rows.join(F.broadcast(chosen), F.col("class") == F.col("of"))  # two rows for each language
    inside = inside.filter(F.col("key").isNull() | (F.col("key") == F.col("lang_key"))).groupBy("key", "of", "before", "at", "perplexity").agg(F.count("*").alias("n"))
    within = Window.partitionBy("key", "of").orderBy("perplexity").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(within))
    low, high = (F.min(F.when(F.col("upto") > f("at"), F.col("perplexity"))) for f in (F.floor, F.ceil))
    ends = inside.groupBy("key", "at").agg(low.alias("low"), high.alias("high"))
    return ends.select(F.col("key").alias("lang_key"), (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, train_docs: int | None = None, train_chars: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, kept of every document."""
    scratch = Scratch(docs.sparkSession)
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = TRAIN_SHARE
    if train_docs is not None:
        share = int(min(share, 1_000_000 * train_docs / max(1, good.count())))
    chosen = good.filter(part < share)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(part < share).join(chosen, "doc_id", "left_semi")
    if train_chars is not None:
        sample = sample.filter(F.length("text") <= train_chars)
    model = train(sample.select("text"), scratch)
    scored = score(docs, model)
    lang = F.coalesce("lang", F.lit("")).alias("lang_key")
    tested = scored.filter("n_words > 0").join(good.filter(part >= share), "doc_id", "left_semi").select(lang, "n_words", "nll")
    mean = tested.rollup("lang_key").agg((F.sum("nll") / F.sum("n_words")).alias("mean"))
    mean = scratch.table(mean.select("lang_key", "mean"), "means")
    overall = mean.filter("lang_key IS NULL").select(F.col("mean").alias("all_mean"))
    own = mean.filter("lang_key IS NOT NULL")

    def smoothed(rows: DataFrame) -> DataFrame:
        joined = rows.join(own, "lang_key", "left").join(F.broadcast(overall), F.lit(True), "left")
        at = F.coalesce("mean", "all_mean", F.col("nll") / F.greatest(F.col("n_words"), F.lit(1)))
        return joined.withColumn("perplexity", F.when(F.col("n_words") > 0, F.round(F.exp((F.col("nll") + PRIOR * at) / (F.col("n_words") + PRIOR)), 4))).drop("mean", "all_mean")

    ends = scratch.table(quantiles(smoothed(tested), quantile), "thresholds")
    every = ends.filter("lang_key IS NULL").select(F.col("threshold").alias("all_threshold"))
    out = smoothed(scored.withColumn("lang_key", lang)).join(ends.filter("lang_key IS NOT NULL"), "lang_key", "left").join(F.broadcast(every), F.lit(True), "left")
    out = out.withColumn("threshold", F.coalesce("threshold", "all_threshold", F.lit(float("inf"))))
    scratch.drop("model", "c1")
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", ((F.col("n_words") > 0) & (F.col("perplexity") <= F.col("threshold"))).alias("kept"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
