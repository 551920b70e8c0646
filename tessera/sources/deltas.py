"""Tables that grow by deltas: a batch writes the rows it brings, never the table.

Every batch is one version of a ``VersionedState`` that holds this batch's rows only, so what it writes depends on the batch
and not on the table; the marker that finishes it also names the stream's batch, so a replay is skipped. Readers get all
rows with the version that brought them and fold them (sum, or last one wins). ``compact`` folds what is there into one
version from which later reads start; it is a maintenance job of its own and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.versioned import VersionedState


_BASE = "_base"


class Deltas:
    def __init__(self, spark: SparkSession, root: str, schema: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.schema, self.partition_by = spark, schema, partition_by
        self.state = VersionedState(spark, root)

    def append(self, rows: DataFrame, stream: str | None = None, batch_id: int | None = None) -> bool:
        """Add a batch; false if the stream's batch is already there."""
        if stream is not None and batch_id <= self.state.applied(stream):
            return False
        self.state.commit({"delta": rows}, stream, batch_id, self.partition_by)
        return True

    def paths(self) -> dict[int, str]:
        """Folders that make up the table, by version: the last compacted one, if any, and the deltas after it."""
        base = self.state.applied(_BASE)
        found = {base: f"{self.state.root}/v={base}/base"} if base >= 0 else {}
        return found | {v: f"{self.state.root}/v={v}/delta" for v in sorted(self.state.versions()) if v > base}

    def read(self) -> DataFrame:
        """All rows, with the ``version`` that brought each."""
        out = self.spark.createDataFrame([], f"{self.schema}, version bigint")
        names = [c.split()[0] for c in self.schema.split(", ")]
        for v, path in self.paths().items():  # compaction keeps them few
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(path).select(*names, F.lit(v).cast("bigint").alias("version")))
        return out

    def compact(self, fold: Callable[[DataFrame], DataFrame]) -> None:
        """Replace everything up to now by its fold (rows without ``version``)."""
        if len(self.paths()) > 1:
            # the marker names the version, so a folder that an unfinished compaction left is never taken for it
            self.state.commit({"base": fold(self.read())}, _BASE, self.state.current() + 1, self.partition_by)
