"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

Two documents link when den * |intersection| >= num * |union| of their sets of word n-grams. The result is exact
(n-grams are compared as 64-bit hashes). ``jaccard_join`` gives each document's class of linked documents;
``jaccard_links`` lists every link between different sets, and which documents have them.

1. Documents with equal sets are one class (two 64-bit sums over the set and its size), represented by its smallest
   doc_id.
2. Size bands: group b of signatures serves the pairs whose smaller set has a size in band b, so a set joins its own
   band and those below that can reach it. Within group b linked sets differ in at most H_b n-grams. n-grams are
   dealt by hash into H_b + r parts, so at least r parts of two linked sets are equal. Each part's sum is a
   signature. Parts that are empty or nearly so say little and are left out. Where all equal parts are such, both sets
   have r of them, so a set with r or more of them is dealt anew by another hash, up to ``DEALS`` times, and signs those
   parts too; only a set for which no deal suffices signs pairs of nearly empty parts (two linked sets that agree in no
   other part of any deal agree in such a pair).
3. Signatures are shuffled as packed blocks and sorted per shard. The sets that share one meet in the tile of the
   smallest among them; a tile with more than ``tile`` sets is split into blocks.
4. In a tile, one set is compared with all sets not linked yet: bitmap x AND NOT y has at most |x - y| bits, which
   bounds the overlap from above; only sets within the bound are intersected, as sorted arrays. A set once linked is
   not compared again with those it is linked to, so a group of near copies costs one round and its rows are linear.
   Blocks are compared first with themselves and about ``HUBS`` sets of the whole tile. Sets that this joins need no
   comparison among each other; those that are then outside the tile's largest class are compared with all blocks. So a
   large group of near copies sends each text a bounded number of times. ``jaccard_links`` compares all blocks.
5. Links become components by large-star/small-star.

Edge cases: a null or empty text has no set and is alone; a text with fewer words than n is one n-gram; a null
doc_id links with nothing (component null); rows with one doc_id are one document; an empty table gives an empty
result; other columns are ignored; a doc_id must be a whole number or a string of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, mix64, released, table, utf8, without_ids
from .components import connected_components

TILE, HUBS, DEALS = 1024, 16, 8
SHARD_BYTES = 32 << 20  # of text, for each shard of signatures
_U = np.uint64
_BATCH = 400_000  # bytes hashed at once; bounds memory, not results


@dataclass(frozen=True)
class Rule:
    """Links at den * |intersection| >= num * |union|."""

    n: int = 3
    num: int = 90
    den: int = 100

    def linked(self, overlap, x, y):
        return self.den * overlap >= self.num * (x + y - overlap)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number, of its inverse modulo 2**64, and a random number for each byte."""
    base = 0x9E3779B97F4A7C15
    powers, inverse = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
    powers[0] = inverse[0] = 1
    rng = np.random.Generator(np.random.PCG64(8))
    return np.multiply.accumulate(powers), np.multiply.accumulate(inverse), rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word and the number of its text, in order.

    Sums of byte values times powers give the hash of each word from one running sum over all texts.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    powers, inverse, value = _powers(1 << max(19, int(len(data)).bit_length()))
    space = _SPACE[data]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(value[data] * powers[: len(data)], dtype=_U)])
    hashes = mix64((total[last] - total[first]) * inverse[first] + (last - first).astype(_U))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(ends, first, side="right")


def ngram_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; A-Z are lower-cased."""
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        held.append(text.encode("utf-8", "surrogatepass").lower())
        size += len(held[-1])
        if size > _BATCH or i == len(texts) - 1:
            words, doc = word_hashes(held)
            grams = words
            for k in range(1, n):
                grams = mix64(grams[: len(words) - k] * _U(0xD6E8FEB86659FD93) + words[k:]) if len(words) > k else grams[:0]
            bounds = np.searchsorted(doc, np.arange(len(held) + 1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a >= n:
                    found = np.sort(grams[a : b - n + 1])
                    yield found[np.concatenate([[True], found[1:] != found[:-1]])]
                elif b > a:
                    one = words[a : a + 1]
                    for k in range(1, b - a):
                        one = mix64(one * _U(0xD6E8FEB86659FD93) + words[a + k : a + k + 1])
                    yield mix64(one + _U(b - a))
                else:
                    yield words[:0]
            held, size = [], 0


def set_hash(grams: np.ndarray) -> tuple[int, int]:
    a, b = mix64(grams + _U(0x5851F42D4C957F2D)).sum(dtype=_U), mix64(grams ^ _U(0xA0761D6478BD642F)).sum(dtype=_U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int  # sizes low..high
    differ: int  # the most n-grams in which linked sets of this group differ
    spare: int
    light: int  # parts with at most so many n-grams are light


@cache
def bands(rule: Rule, upto: int) -> tuple[Band, ...]:
    found, low = [], 1
    while low <= upto:
        high = max(low, low * 6 // 5 - 1)
        differ = (high + high * rule.den // rule.num) * (rule.den - rule.num) // (rule.den + rule.num)
        light = 1 if high >= 6 * (differ + 2) else 0
        found.append(Band(len(found), low, high, differ, 2 + differ * (2 if light else 6) // 100, light))
        low = high + 1
    return tuple(found)


class _Deals(dict):
    """31 bits of each n-gram for each deal, made when asked for."""

    def __init__(self, mixed: np.ndarray):
        self.mixed = mixed

    def __missing__(self, deal: int) -> np.ndarray:
        self[deal] = (mix64(self.mixed + _U(deal)) if deal else self.mixed) >> _U(33)
        return self[deal]


def signatures(grams: np.ndarray, rule: Rule) -> np.ndarray:
    """All signatures of a set: two linked, unequal sets share at least one."""
    size = len(grams)
    top = 1024
    while top < size:
        top *= 4
    out = []
    every = bands(rule, top)
    own = next(b for b in every if b.low <= size <= b.high)
    mixed = mix64(grams)
    place = _Deals(mixed)
    for band in reversed(every[: own.number + 1]):
        if size * rule.num > band.high * rule.den:
            break
        if band.differ == 0:
            continue
        parts = band.differ + band.spare
        for deal in range(DEALS):
            part = ((place[deal] * _U(parts)) >> _U(31)).astype(np.int64)
            sums, count = np.zeros(parts, _U), np.bincount(part, minlength=parts)
            np.add.at(sums, part, mixed)
            sums = mix64(sums + count.astype(_U) + mix64(np.arange(parts, dtype=_U) + _U((band.number << 32) + (deal << 48))))
            out.append(sums[count > band.light])
            light = sums[count <= band.light]
            if len(light) < band.spare:
                break
        else:
            i, j = np.triu_indices(len(light), 1)
            out.append(mix64(light[i] * _U(0xD6E8FEB86659FD93) + light[j]))
    return np.concatenate(out) if out else grams[:0]


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, h1, h2 of every document."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(g), *(set_hash(g) if len(g) else (0, 0))) for g in ngram_sets(utf8(batch.column(1)), rule.n)]
            n, h1, h2 = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, h1, h2))], names=["doc_id", "n_shingles", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long")


def candidates(docs: DataFrame, rule: Rule, shards: int) -> DataFrame:
    """h1, center: each class (its first hash) with the tiles it belongs to, named by their smallest class."""
    kind = np.dtype([("s", "<u8"), ("c", "<i8")])

    @released
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # equal sets of a task sign once

        def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(held) if held else np.zeros(0, kind)
            shard = (rows["s"] % _U(shards)).astype(np.int64)
            rows = rows[np.argsort(shard, kind="stable")]
            at = np.searchsorted(np.sort(shard), np.arange(shards + 1))
            full = [k for k in range(shards) if at[k + 1] > at[k]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())], names=["shard", "block"])

        held, n = [], 0
        for batch in batches:
            for grams in ngram_sets(utf8(batch.column(0)), rule.n):
                if not len(grams):
                    continue
                h = set_hash(grams)
                if h in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(h)
                s = signatures(grams, rule)
                rows = np.empty(len(s), kind)
                rows["s"], rows["c"] = s, h[0]
                held.append(rows)
                n += len(s)
                if n > 500_000:
                    yield blocks(held)
                    held, n = [], 0
        yield blocks(held)

    @released
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards follow each other in a partition; each is sorted on its own."""

        def tiles(held: list[bytes]) -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(held), kind)
            rows = rows[np.argsort(rows["s"], kind="stable")]
            starts = np.flatnonzero(np.concatenate([[True], rows["s"][1:] != rows["s"][:-1]])) if len(rows) else np.zeros(0, int)
            least = np.minimum.reduceat(rows["c"], starts) if len(rows) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(rows["c"], starts) if len(rows) else least
            center = np.repeat(least, np.diff(np.append(starts, len(rows))))
            shared = np.repeat(least != most, np.diff(np.append(starts, len(rows))))
            pairs = np.unique(np.stack([rows["c"][shared], center[shared]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["h1", "center"])

        shard, held = None, []
        for batch in batches:
            for k, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != shard:
                    if held:
                        yield tiles(held)
                    shard, held = k, []
                held.append(block)
        yield tiles(held)

    signed = docs.filter("doc_id IS NOT NULL").select(F.col("text").cast("string")).mapInArrow(sign, "shard int, block binary")
    return signed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(meet, "h1 long, center long").distinct()


def link_tile(ids: list[int], sets: list[np.ndarray], rule: Rule, every: bool = False) -> list[tuple[int, int]]:
    """Links that connect whatever is connected within a tile, or ``every`` link."""
    size = np.array([len(s) for s in sets])
    bits = 256
    while bits < 2 * size.max():
        bits *= 2
    bitmap = np.zeros((len(sets), bits // 64), _U)
    for row, s in zip(bitmap, sets, strict=True):
        at = s & _U(bits - 1)
        np.bitwise_or.at(row, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
    links: list[tuple[int, int]] = []
    left = np.argsort(size, kind="stable")
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = left[(size[left] * rule.num <= size[x] * rule.den) & (size[x] * rule.num <= size[left] * rule.den)]
            only_x = np.bitwise_count(bitmap[x] & ~bitmap[near]).sum(1, dtype=np.int64)
            only_y = np.bitwise_count(bitmap[near] & ~bitmap[x]).sum(1, dtype=np.int64)
            near = near[rule.linked(np.minimum(size[x] - only_x, size[near] - only_y), size[x], size[near])]
            found = []
            for y in near:
                short, long = (sets[x], sets[y]) if size[x] < size[y] else (sets[y], sets[x])
                at = np.searchsorted(long, short)
                at[at == len(long)] = 0
                if rule.linked(int((long[at] == short).sum()), int(size[x]), int(size[y])):
                    found.append(y)
            links += [(ids[x], ids[y]) for y in found]
            if found and not every:
                queue += found
                left = left[~np.isin(left, found)]
    return links


def link_tiles(rows: DataFrame, rule: Rule, every: bool = False) -> DataFrame:
    """Links (a, b) among rows (center, tile, h1, doc_id, text), one tile at a time."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, links = None, [], [], []

        def emit() -> pa.RecordBatch:
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            c, t, h, d = (batch.column(i).to_pylist() for i in range(4))
            for *now, h1, doc_id, grams in zip(c, t, h, d, ngram_sets(utf8(batch.column(4)), rule.n), strict=True):
                if now != key:
                    if len(ids) > 1:
                        links += link_tile(ids, sets, rule, every)
                    key, ids, sets = now, [], []
                if len(grams) and set_hash(grams)[0] == h1:  # another text of the same doc_id is not this class
                    ids.append(doc_id)
                    sets.append(grams)
            if len(links) > 50_000:
                yield emit()
                links = []
        if len(ids) > 1:
            links += link_tile(ids, sets, rule, every)
        yield emit()

    dealt = rows.repartition("center", "tile").sortWithinPartitions("center", "tile")
    return dealt.select("center", "tile", "h1", "doc_id", "text").mapInArrow(run, "a long, b long")


@dataclass
class _Tiles:
    """``every``: doc_id and class of every document; ``reps``: each class with its smallest doc_id; ``members``: h1,
    center, k (blocks of the tile), block, m (sets of the tile)."""

    texts: DataFrame
    every: DataFrame
    reps: DataFrame
    members: DataFrame

    def links(self, tiles: DataFrame, rule: Rule, every: bool = False) -> DataFrame:
        """Links found among ``tiles`` (h1, center, tile)."""
        wanted = tiles.join(self.reps.select("h1", F.col("rep").alias("doc_id")), "h1")
        return link_tiles(self.texts.join(wanted, "doc_id"), rule, every).distinct()


def _tiles(docs: DataFrame, rule: Rule, tile: int, scratch: Scratch) -> _Tiles:
    texts = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = scratch.table(classes(texts, rule), "classes")
    reps = every.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    members = scratch.table(candidates(texts, rule, shards), "members")
    blocks = members.groupBy("center").agg(F.count("*").alias("m")).withColumn("k", F.ceil(F.col("m") / tile).cast("int"))
    return _Tiles(texts, every, reps, members.join(blocks, "center").withColumn("block", F.pmod(F.xxhash64("h1"), F.col("k")).cast("int")))


def jaccard_join(docs: DataFrame, rule: Rule = Rule(), tile: int = TILE, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    scratch = scratch or Scratch(docs.sparkSession)
    t = _tiles(docs, rule, tile, scratch)
    hub = F.expr(f"k > 1 AND (h1 = center OR pmod(xxhash64(center, h1), greatest(m div {HUBS}, 1)) = 0)")
    first = t.members.select("h1", "center", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("block"))).alias("tile"))
    links = scratch.table(t.links(first, rule), "links")
    found = scratch.table(connected_components(links, scratch).select(F.col("node").alias("rep"), "component"), "found")
    rest = _outside(t, found, tile, scratch)
    if rest is not None:
        links = links.union(t.links(rest, rule))
        found = connected_components(links, scratch).select(F.col("node").alias("rep"), "component")
    linked = t.reps.join(found, "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = t.every.join(linked, ["h1", "h2", "n_shingles"], "left")
    alone = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = scratch.table(out.select("doc_id", "n_shingles", alone.cast("long").alias("component_id")), "result")
    scratch.drop(*[name for name in scratch.names if name != "result"])
    return out


def _outside(t: _Tiles, found: DataFrame, tile: int, scratch: Scratch) -> DataFrame | None:
    """Tiles (h1, center, tile) that bring the sets outside of a large tile's largest class together with all of its
    blocks; none if there are no such sets."""
    large = t.members.filter("k > 1").join(t.reps.select("h1", "rep"), "h1").join(found, "rep", "left")
    large = scratch.table(large.select("h1", "center", "k", "block", F.coalesce("component", "rep").alias("component")), "large")
    sizes = large.groupBy("center", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("center").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), (F.sum("n") - F.max("n")).alias("left"))
    some = scratch.table(largest.filter("left > 0").withColumn("chunks", F.ceil(F.col("left") / tile).cast("int")), "some")
    if not some.take(1):
        return None
    rows = large.join(some, "center").withColumn("chunk", F.expr("pmod(xxhash64(h1, center), chunks)").cast("int"))
    beside = F.expr("transform(sequence(0, chunks - 1), c -> block * chunks + c)")
    of_rest = F.expr("if(component = largest, array(), transform(sequence(0, k - 1), b -> b * chunks + chunk))")
    return rows.select("h1", "center", F.explode(F.array_distinct(F.concat(beside, of_rest))).alias("tile"))


def jaccard_links(docs: DataFrame, rule: Rule = Rule(), tile: int = TILE, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Every link (a < b) between different sets, each named by the smallest doc_id that has it; and rep, doc_id, n_links
    of every document with a doc_id and a set: the set's name and the number of links that it has."""
    scratch = scratch or Scratch(docs.sparkSession)
    t = _tiles(docs, rule, tile, scratch)
    pairs = F.expr("transform(sequence(0, k - 1), j -> least(j, block) * k + greatest(j, block))")
    links = t.links(t.members.select("h1", "center", F.explode(pairs).alias("tile")), rule, True)
    links = scratch.table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "all-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    members = t.every.filter("doc_id IS NOT NULL").join(t.reps, ["h1", "h2", "n_shingles"]).join(ends, "rep", "left")
    members = scratch.table(members.select("rep", "doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links")).distinct(), "holders")
    scratch.drop(*[name for name in scratch.names if name not in ("all-links", "holders")])
    return links, members


def one_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """The documents without those linked to one with a smaller doc_id."""
    return without_ids(docs, jaccard_join(docs, rule).filter("component_id <> doc_id"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
