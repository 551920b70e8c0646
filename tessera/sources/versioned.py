"""Versioned tables on plain parquet: new version folder, then an immutable marker.

Plain parquet cannot be updated in place; every change writes ``root/v=<n>/<name>`` and then the marker
``root/_done/<n>``, which is never changed again. The current version is the highest marker, so readers never see a
folder that is being written, and a writer that dies before its marker leaves the version before it current. Markers
also carry, per stream, the last batch that was applied; batch ids and versions are separate numbers.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class VersionedState:
    """Named DataFrames stored as ``root/v=<version>/<name>`` plus one marker per finished version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        """Finished versions; a missing folder has none, any other error is raised."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_done")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [f.getPath() for f in fs.listStatus(path)]
        return [int(p.getName()) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def current(self) -> int:
        return max(self.versions(), default=-1)

    def _applied(self) -> dict[str, int]:
        version = self.current()
        return json.loads(self.spark.read.text(f"{self.root}/_done/{version}").first()[0]) if version >= 0 else {}

    def applied(self, stream: str) -> int:
        """The last batch of a stream that a finished version holds, -1 if none."""
        return self._applied().get(stream, -1)

    def read(self, name: str, schema: str) -> DataFrame:
        v = self.current()
        if v < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/v={v}/{name}")

    def commit(self, frames: dict[str, DataFrame], stream: str | None = None, batch_id: int | None = None,
               partition_by: tuple[str, ...] = ()) -> None:
        version, applied = self.current() + 1, self._applied()
        for name, df in frames.items():  # an unfinished version's folder may be left from a writer that died
            df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.root}/v={version}/{name}")
        if stream is not None:
            applied[stream] = batch_id
        self.spark.createDataFrame([(json.dumps(applied),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/_done/{version}")
