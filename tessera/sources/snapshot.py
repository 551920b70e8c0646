"""Catalog snapshots as parquet with a time-to-live.

Each record type (tables, columns, queries, relationships) is one parquet
folder carrying an ``extracted_at`` column. A read is a hit only when every
record type exists, is newer than the TTL and newer than the last
invalidation marker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TTL_HOURS = 336
RECORD_TYPES = ("tables", "columns", "queries", "relationships")


def write_snapshot(spark: SparkSession, path: str, frames: dict[str, DataFrame]) -> None:
    """Overwrite each record type with the extraction time attached."""
    ts = F.current_timestamp()
    for name, df in frames.items():
        df.withColumn("extracted_at", ts).write.mode("overwrite").parquet(f"{path}/{name}")


def _try_read(spark: SparkSession, p: str) -> DataFrame | None:
    try:
        return spark.read.parquet(p)
    except Exception:  # missing folder = miss
        return None


def read_snapshot(spark: SparkSession, path: str, ttl_hours: float = DEFAULT_TTL_HOURS,
                  names: tuple[str, ...] = RECORD_TYPES) -> dict[str, DataFrame] | None:
    """The snapshot frames if valid, else None (miss)."""
    frames = {n: _try_read(spark, f"{path}/{n}") for n in names}
    if any(v is None for v in frames.values()):
        return None
    marker = _try_read(spark, f"{path}/_invalidated")
    # the validity test reads one aggregate row per record type
    bounds = [df.agg(F.min("extracted_at").alias("t")).withColumn("n", F.lit(n)) for n, df in frames.items()]
    oldest = bounds[0]
    for b in bounds[1:]:
        oldest = oldest.unionByName(b)
    row = oldest.agg(F.min("t").alias("t"),
                     (F.min("t") >= F.current_timestamp() - F.make_interval(hours=F.lit(int(ttl_hours))))
                     .alias("fresh")).first()
    if row is None or row["t"] is None or not row["fresh"]:
        return None
    if marker is not None:
        inv = marker.agg(F.max("invalidated_at")).first()[0]
        if inv is not None and inv >= row["t"]:
            return None
    return frames


def invalidate(spark: SparkSession, path: str) -> None:
    """Write an invalidation marker; the next read misses."""
    spark.range(1).select(F.current_timestamp().alias("invalidated_at")) \
        .write.mode("overwrite").parquet(f"{path}/_invalidated")


def load_or_extract(spark: SparkSession, path: str, extract: Callable[[], dict[str, DataFrame]],
                    ttl_hours: float = DEFAULT_TTL_HOURS, force: bool = False) -> dict[str, DataFrame]:
    """A valid snapshot unless forced; otherwise extract, save and re-read."""
    if not force:
        hit = read_snapshot(spark, path, ttl_hours)
        if hit is not None:
            return hit
    write_snapshot(spark, path, extract())
    return read_snapshot(spark, path, ttl_hours=float("inf") if ttl_hours is None else ttl_hours) or {}
