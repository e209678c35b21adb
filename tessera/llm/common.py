"""Shared pieces of the training-data operators: inputs, scratch tables, hashing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule used throughout: space and U+0009..U+000D, nothing else.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The same inside a SQL string, where a backslash is written twice.
WS_SQL = WS.replace("\\", "\\\\")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_sql(text: str) -> str:
    """SQL for the array of words of a text column; null text has none."""
    return f"filter(split(coalesce({text}, ''), '{WS_SQL}+'), w -> w <> '')"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and binds it to ``name`` in ``body``.

    A plain reference from inside a lambda would evaluate the expression for each element.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that cut lineage, in the folder that all executors share.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is unset (a local session, as in
    tests) a temporary folder stands in. A written table survives lost executors and is read back in columns.

    A table's shuffle files go as soon as it is written. The whole folder goes when the driver ends, as results are
    read lazily; ``drop`` takes tables away before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not conf:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            conf = f"{tempfile.gettempdir()}/checkpoints"
        self.root = f"{conf.rstrip('/')}/tessera-{uuid.uuid4().hex}"
        self._made: dict[str, str] = {}
        self._known: dict[str, str] = {}
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(path)
        self._files.deleteOnExit(path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read back."""
        self._made[name] = path = f"{self.root}/{name}-{len(self._made)}"
        schema, before = df.schema, self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    @property
    def names(self) -> list[str]:
        """The tables written and not dropped."""
        return list(self._made)

    def bucketed(self, parts: Iterable[DataFrame], name: str, by: str, number: int) -> DataFrame:
        """Writes all ``parts`` (at least one), each when the one before is written, as one table in ``number`` buckets of
        the column ``by``. What is grouped by ``by`` reads it where it lies, without a shuffle. The session's catalog
        knows the table until it is dropped; its files lie with the others."""
        self._made[name] = path = f"{self.root}/{name}-{len(self._made)}"
        self._known[name] = known = f"tessera_{uuid.uuid4().hex}"
        before = self.spark.conf.get(_CLEANUP, "false")
        for i, part in enumerate(parts):
            if not i:
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.schema)
                self.spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (`{by}`) INTO {number} BUCKETS LOCATION '{path}'")
            self.spark.conf.set(_CLEANUP, "true")
            try:
                part.write.insertInto(known)
            finally:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.table(known)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; without names, all of them."""
        for name in names or list(self._made):
            if name in self._known:
                self.spark.sql(f"DROP TABLE {self._known.pop(name)}")
            self._files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._made.pop(name)), True)


def bounded_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """``df``; from here on Arrow batches of its session have at most about ``most`` bytes, however long texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > most:
        df.sparkSession.conf.set(key, str(most))
    return df


def released(run):
    """``run`` over Arrow batches; at its end the worker, which Spark keeps for later tasks, gives free memory back."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # of glibc only
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def broadcast_up_to(df: DataFrame, size: int, most: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its measured ``size`` in bytes is at most ``most``; else as it is, and Spark joins
    by shuffling."""
    return F.broadcast(df) if size <= most else df


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is none of ``ids`` (a stored table); rows without doc_id stay."""
    gone = ids.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    return docs.join(broadcast_up_to(gone, 64 * gone.count()), "doc_id", "left_anti").select(*docs.columns)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads the bits of hashes that are to be summed or cut."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column) -> list[str]:
    """Python strings of an Arrow string column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
