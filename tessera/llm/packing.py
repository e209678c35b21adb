"""Best-fit packing of tokenised documents into sequences, by the sum-of-squares rule.

Documents are tokenised and cut into pieces; pieces are dealt into groups of a bounded number of documents and bytes,
and each group, a task of its own, is packed longest first. A piece goes to the open sequence whose choice makes the sum of squares of the
number of open sequences per residual gap smallest (ties: the smallest gap); only where none has room a new one is
opened (with new ones always allowed, this data took 1.8 % more sequences). The packer's state
is the open sequences by gap, so a group is streamed, not collected, and Spark sorts it with spilling.

Edge cases: a null or empty text is the end token alone; a null doc_id is packed like any other; repeated rows
are packed each; an empty table gives an empty result; other columns are ignored by ``tokenize`` and carried
through by ``pack`` (its own output names replace columns of those names); a doc_id must be a whole number or a string
of one.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, released, table, utf8

CAPACITY, END = 1024, 2
#: Of a group: bytes of text bound what its task sorts (four bytes of text are about one id of four bytes).
DOCS_PER_GROUP, BYTES_PER_GROUP = 65_536, 64 << 20
PIECES = "doc_id long, piece int, start long, length long, ids binary"


@cache
def encoder(json_path: str | None = None) -> Encoder:
    """One for each worker process."""
    return Encoder(json_path)


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary, equal to those of the tokenizers library.

    The same vocabulary as ranks is several times faster in tiktoken; only texts that hold a special token's string,
    which the tokenizers library takes as that token, go to the latter.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers as P
        import tiktoken

        with open(ranks_path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json_path, self.whole = json_path or P.path("byte_bpe_50k.json"), None
        self.encode = tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.SPECIAL not in text:
            return array("I", self.encode(text)).tobytes()
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json_path)
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


def tokenize(docs: DataFrame, capacity: int = CAPACITY, end: int = END, json_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every piece of every document.

    A document is its ids and ``end``. Only longer ones than ``capacity`` are cut, into pieces of that length; the
    first piece takes the remainder.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(json_path), array("I", [end]).tobytes()
        for batch in batches:
            for rows in _by_size(zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)):
                out: list[list] = [[], [], [], [], []]
                for doc_id, text in rows:
                    ids = encode(text) + last
                    n = len(ids) // 4
                    start, stop, piece = 0, n % capacity or capacity, 0
                    while start < n:
                        for column, value in zip(out, (doc_id, piece, start, stop - start, ids[4 * start : 4 * stop]), strict=True):
                            column.append(value)
                        start, stop, piece = stop, stop + capacity, piece + 1
                yield _pieces(out)

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _by_size(rows, most: int = 500_000) -> Iterator[list]:
    """Runs of rows whose texts together have about ``most`` characters."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1])
        if n > most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _pieces(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])


class SumOfSquares:
    """Online sum-of-squares packing into bins of ``capacity``."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset of an item. Moving a bin from gap g to g - size changes the sum of squares by
        2 (N[g - size] - N[g] + 1), filling one by 1 - 2 N[g]."""
        count, c = self.count, self.capacity
        have = np.flatnonzero(count[size:c])
        if size == c or not have.size:
            gap, chosen = c, self.bins
            self.bins += 1
        else:
            change = 2 * (count[have] - count[have + size] + 1)
            if have[0] == 0:
                change[0] = 1 - 2 * count[size]
            gap = int(have[change.argmin()]) + size
            chosen = self.open[gap].pop()
            count[gap] -= 1
        if gap > size:
            self.open[gap - size].append(chosen)
            count[gap - size] += 1
        return chosen, c - gap


def group_count(docs: DataFrame, docs_per_group: int = DOCS_PER_GROUP, bytes_per_group: int = BYTES_PER_GROUP) -> int:
    """The number of groups for these documents."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    return max(1, -(-n // docs_per_group), -(-(size or 0) // bytes_per_group))


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset, packed in ``groups`` groups.

    Groups are dealt by a hash of doc_id and piece, so neither a long document nor a repeated id fills one.
    """
    given = pieces.drop("sequence_id", "offset", "pack_group")
    order = ["doc_id", "piece", *(c for c in given.columns if c not in ("doc_id", "piece", "length") and dict(given.dtypes)[c] in ("int", "bigint"))]
    dealt = given.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    dealt = dealt.repartitionById(groups, "pack_group").sortWithinPartitions("pack_group", F.desc("length"), *order)
    schema = T.StructType([*given.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, SumOfSquares(capacity)
        for batch in batches:
            names = batch.schema.names
            sequence, offset = [], []
            for g, size in zip(batch.column(names.index("pack_group")).to_pylist(), batch.column(names.index("length")).to_pylist(), strict=True):
                if g != group:
                    group, packer = g, SumOfSquares(capacity)
                b, o = packer.place(size)
                sequence.append((g << 40) + b)
                offset.append(o)
            kept = [n for n in names if n != "pack_group"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in kept), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    return bounded_batches(dealt).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with their ids, packed."""
    return pack(tokenize(docs, capacity), group_count(docs), capacity)


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = tokenize(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, group_count(docs)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
