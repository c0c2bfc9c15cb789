"""What the training-data operators share: scratch tables, Arrow slicing, hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Text bytes that a Python worker takes up at once.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset and all runs on this machine (tests),
    a local one; on a cluster an unset one is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = getattr(spark, "_citeplane_scratch", None) or tempfile.mkdtemp(prefix="citeplane-")
        spark._citeplane_scratch = found
    return found.rstrip("/")


#: Shuffle files go when the query that made them ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage; each can be dropped once nothing reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/citeplane/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df as Parquet and reads it again. Once the table is written nothing needs the shuffle files of its query
        any more, so Spark is told to remove them as the write ends."""
        path = f"{self.root}/{table}"
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Most ids that are broadcast, 8 bytes each; more are shuffled.
BROADCAST_IDS = 1 << 22


def narrow(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join of df with the kept table ids (one column, named as in df): the ids are counted and go to
    the rows where they are few, else both are shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), ids.columns, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Gives freed memory back to the system, where the C library can.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives back the memory that Arrow and the C library hold but no longer use: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in pieces of about `most` bytes of text, so that memory follows the piece and not the batch; after each
    batch unused memory is given back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        part = np.cumsum(size + 16) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
        release()


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, over a uint64 array."""
    t = x >> np.uint64(31)
    t ^= x
    t *= np.uint64(0x7FB5D329728EA185)
    u = t >> np.uint64(27)
    t ^= u
    t *= np.uint64(0x81DADEF4BC2DD44D)
    np.right_shift(t, np.uint64(33), out=u)
    t ^= u
    return t


def table_of(seed: int, n: int) -> np.ndarray:
    """n fixed random 64-bit values."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=np.uint64)


class Polynomial:
    """Hashes of substrings of a byte array from prefix sums, modulo 2^64: an odd base has an inverse."""

    base = 0x9E3779B97F4A7C15
    _bytes = table_of(5, 256)
    _tables: list[np.ndarray] = []

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, at least n of them."""
        if not cls._tables or len(cls._tables[0]) < n:
            cls._tables = []
            for x in (cls.base, pow(cls.base, -1, 1 << 64)):
                out = np.full(max(n, 1 << 16), x, np.uint64)
                out[0] = 1
                cls._tables.append(np.multiply.accumulate(out))
        return cls._tables[0], cls._tables[1]

    @classmethod
    def prefixes(cls, data: np.ndarray) -> np.ndarray:
        """S with S[i] the polynomial of the first i bytes; (S[b] - S[a]) * inverse^a is the hash of bytes a to b."""
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(cls._bytes[data] * cls.powers(len(data) + 1)[0][: len(data)], out=out[1:])
        return out
