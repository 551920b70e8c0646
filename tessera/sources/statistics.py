"""Row counts and column ranges from statistics, without reading data.

Parquet footers hold the row count, null count and range of every column chunk. Spark's V2 reader answers
``count``, ``min`` and ``max`` from them when aggregate push-down is on, so the statistics of a table cost one footer per
file, read by tasks. What was measured is kept with the digest of the table's file listing (paths, lengths,
modification times); a later reader compares digests and marks statistics stale when the files have changed. Refreshing
reads the footers of the stale tables only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.versioned import VersionedState

#: types whose range a footer holds exactly
RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
STATISTICS = "table string, row_count bigint, files bigint, bytes bigint, digest bigint, as_of timestamp"


def footer_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose Parquet reader answers aggregates from footers; the caller's settings stay."""
    child = spark.newSession()
    child.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    v1 = [s for s in child.conf.get("spark.sql.sources.useV1SourceList").split(",") if s.strip() != "parquet"]
    child.conf.set("spark.sql.sources.useV1SourceList", ",".join(v1))
    return child


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def footer_row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, row_count) of every table from its footers."""
    child = footer_session(spark)
    return _union([child.read.parquet(p).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table"), "row_count")
                   for t, p in paths.items()])


def footer_column_ranges(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, column, row_count, null_count, lo, hi) of every integral column from the footers."""
    child, out = footer_session(spark), []
    for t, p in paths.items():
        df = child.read.parquet(p)
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, RANGED)]
        if not cols:
            continue
        got = df.agg(F.count(F.lit(1)).alias("_n"), *[x for i, c in enumerate(cols) for x in (
            F.count(c).alias(f"_k{i}"), F.min(c).alias(f"_l{i}"), F.max(c).alias(f"_h{i}"))])
        per = [F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(f"_k{i}")).alias("null_count"),
                        F.col(f"_l{i}").cast("bigint").alias("lo"), F.col(f"_h{i}").cast("bigint").alias("hi")) for i, c in enumerate(cols)]
        out.append(got.select(F.lit(t).alias("table"), F.col("_n").alias("row_count"), F.explode(F.array(*per)).alias("s"))
                   .select("table", "s.column", "row_count", "s.null_count", "s.lo", "s.hi"))
    if not out:
        return spark.createDataFrame([], "table string, column string, row_count bigint, null_count bigint, lo bigint, hi bigint")
    return _union(out)


def listings(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, files, bytes, digest) of the file listings; no file is opened."""
    each = [spark.read.format("binaryFile").load(p).select(F.lit(t).alias("table"), "path", "length", "modificationTime") for t, p in paths.items()]
    mark = F.xxhash64("path", "length", "modificationTime")
    # a sum modulo 2^64 takes no notice of the order
    return _union(each).groupBy("table").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
                                             F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), mark)).alias("y")) \
        .select("table", "files", "bytes", F.xxhash64("files", "bytes", "x", "y").alias("digest"))


class StatisticsStore:
    """Measured statistics of named tables, kept as a versioned table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.state = spark, VersionedState(spark, root)

    def read(self, paths: dict[str, str]) -> DataFrame:
        """Stored statistics of the tables (null where none) and whether they are stale: the files differ from those measured."""
        now = listings(self.spark, paths).select("table", F.col("digest").alias("now"))
        kept = self.state.read("statistics", STATISTICS)
        return now.join(kept, "table", "left").select(*kept.columns, (~F.col("now").eqNullSafe(F.col("digest"))).alias("stale"))

    def refresh(self, paths: dict[str, str]) -> list[str]:
        """Measure the tables whose statistics are missing or stale; returns their names."""
        stale = sorted(r["table"] for r in self.read(paths).where("stale").select("table").collect())  # names of tables
        if not stale:
            return []
        some = {t: paths[t] for t in stale}
        # listed before the footers are read: files that arrive between the two leave the entry stale, never falsely fresh
        files = self.spark.createDataFrame(listings(self.spark, some).collect(), "table string, files bigint, bytes bigint, digest bigint")
        new = files.join(footer_row_counts(self.spark, some), "table").withColumn("as_of", F.current_timestamp())
        kept = self.state.read("statistics", STATISTICS).where(~F.col("table").isin(stale))
        names = [c.split()[0] for c in STATISTICS.split(", ")]
        self.state.commit({"statistics": kept.select(*names).unionByName(new.select(*names))})
        return stale
