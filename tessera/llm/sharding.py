"""Sharding by fixed virtual slots.

Records are hashed by doc_id into a fixed number of virtual slots (thousands, far more than shards), so equal texts are
spread like others: a text that holds a third of all rows could not stay in one shard under the law ``bytes``. Bytes and rows are
summed per slot (at most ``slots`` rows reach the driver, whatever the input), and a versioned slot-to-shard map
gives every slot a shard. Rebalancing edits the map: only slots that must move change their shard.

Edge cases: a null text has no bytes (size 1, CRC 0); a null doc_id hashes by its text; repeated rows each get
their own place, and rows with one doc_id share a slot; an empty table gives an empty result; other columns of the input are
ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_or_empty

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the map: ``shard_of[s]`` is the shard of virtual slot s."""

    shards: int
    shard_of: tuple[int, ...]
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    @staticmethod
    def build(slot_bytes: list[int], shards: int) -> SlotMap:
        """The largest slots first, each to the shard with the fewest bytes so far (ties: the lowest shard)."""
        shard_of = [0] * len(slot_bytes)
        heap = [(0, s) for s in range(shards)]
        for slot in sorted(range(len(slot_bytes)), key=lambda i: (-slot_bytes[i], i)):
            load, shard = heapq.heappop(heap)
            shard_of[slot] = shard
            heapq.heappush(heap, (load + slot_bytes[slot], shard))
        return SlotMap(shards, tuple(shard_of))

    def rebalance(self, slot_bytes: list[int], shards: int | None = None) -> SlotMap:
        """The next version, for new slot sizes or more shards: moves slots from the fullest to the emptiest
        shard while that narrows the gap between the two. With ``shards`` raised, slots move into new shards only."""
        shards = shards or self.shards
        if shards < self.shards:
            raise ValueError("a map can gain shards, not lose them")
        shard_of, load = list(self.shard_of), [0] * shards
        own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(shard_of):
            load[shard] += slot_bytes[slot]
            own[shard].append((slot_bytes[slot], slot))
        moved, into = [], range(self.shards if shards > self.shards else 0, shards)
        while True:
            full, free = max(range(shards), key=load.__getitem__), min(into, key=load.__getitem__)
            gap = load[full] - load[free]
            fits = [x for x in own[full] if 0 < x[0] < gap]
            if not fits:
                break
            size, slot = x = min(fits, key=lambda x: (abs(gap / 2 - x[0]), x[1]))
            own[full].remove(x)
            own[free].append(x)
            load[full] -= size
            load[free] += size
            shard_of[slot] = free
            moved.append(slot)
        return SlotMap(shards, tuple(shard_of), self.version + 1, tuple(dict.fromkeys(moved)))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes this version under ``path``; earlier versions stay."""
        rows = [(s, shard, self.shards) for s, shard in enumerate(self.shard_of)]
        spark.createDataFrame(rows, "virtual_slot int, shard int, shards int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version; without one, the newest."""
        found = spark.read.parquet(path)
        if version is None:
            version = found.agg(F.max("version")).first()[0]
        rows = sorted(found.filter(F.col("version") == version).select("virtual_slot", "shard", "shards").collect())
        return SlotMap(rows[0][2], tuple(r[1] for r in rows), version)


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot."""
    crc = F.crc32(F.encode(text_or_empty(), "UTF-8"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), crc.cast("string")))
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        (F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("long") % slots).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows by virtual slot: ``slots`` numbers each."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return size, count


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Every row with its virtual slot, its shard and its place there (gapless from 0), and the map.

    The map goes to the executors as a join with ``slots`` rows, a bound that does not grow with the input.
    Within a shard, slots follow each other, and rows within a slot are in the order of doc_id.
    """
    spark, rows = docs.sparkSession, slotted(docs, slots)
    size, count = slot_sizes(rows, slots)
    slot_map = SlotMap.build(size, shards)
    if map_path:
        slot_map.save(spark, map_path)
    start, base = [0] * shards, []
    for s, k in enumerate(slot_map.shard_of):
        base.append((s, k, start[k]))
        start[k] += count[s]
    places = spark.createDataFrame(base, "virtual_slot int, shard int, base long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("rank", rank).join(F.broadcast(places), "virtual_slot")
    return placed.withColumn("place", F.col("base") + F.col("rank") - 1).drop("base", "rank"), slot_map


def op9_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard(table(spark, sf_dir, "documents"), 16, SLOTS, f"{Scratch(spark).root}/slot-map")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
