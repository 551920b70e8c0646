"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

#: one word: a run of bytes that are not ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and register the shared checkpoint folder."""
    checkpoint_dir(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The written table cuts the lineage and survives lost executors. The
    shuffle files of the finished job are released at once, so that phases
    that follow each other do not add up on disk.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def temp(name: str) -> str:
    """A column name that cannot clash with one of the input."""
    return f"__{name}_{uuid.uuid4().hex[:12]}"


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of learning: crc32 of its id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows that a model may learn from: a known id that is not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def sampled(df: DataFrame, key: Column, share: float) -> DataFrame:
    """The rows whose hashed key falls into ``share`` of the hash range: the same rows in every run."""
    if share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(7919)), F.lit(1_000_000)) < int(share * 1_000_000))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back(*_) -> None:
    """Return freed memory to the system: Python workers live on and later stages need it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def giving_back(rows):
    """Pass rows on and give memory back when they end."""
    yield from rows
    give_back()


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string or binary array, without copying (nulls are empty)."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = 1 << 21):
    """Cut rows into runs of about ``most`` bytes (one long row makes a run of its own)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
