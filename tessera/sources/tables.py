"""Parquet table attachment (the driver's tables) and view registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_tables(spark: SparkSession, sf_dir: str,
                names: tuple[str, ...] | list[str] = TABLES) -> dict[str, DataFrame]:
    """Lazy readers; nothing is scanned until an action runs."""
    return {n: read_table(spark, sf_dir, n) for n in names}


def register_views(spark: SparkSession, sf_dir: str,
                   names: tuple[str, ...] | list[str] = TABLES) -> dict[str, DataFrame]:
    """Register each table as a temp view so generated SQL can name it."""
    frames = load_tables(spark, sf_dir, names)
    for n, df in frames.items():
        df.createOrReplaceTempView(n)
    return frames
