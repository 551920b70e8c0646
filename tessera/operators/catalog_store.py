"""The catalog of a set of tables, extracted once and read by all.

What is extracted is kept in the shared folder under the digest of what it was extracted from: the tables' schemas, their
file listings (paths, lengths, modification times) and the declared constraints. A reader computes the digest from
metadata alone; the same digest means the same files, so verified constraints, row counts, value profiles and
enriched records are read back, and a change to any table leads to a folder that does not exist yet. Parts are made when they
are first asked for; a part that a dying writer left unfinished is not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import catalog as C
from tessera.operators import enrich as N
from tessera.session import checkpoint_dir
from tessera.sources.statistics import listings
from tessera.sources.versioned import VersionedState


class Catalog:
    def __init__(self, spark: SparkSession, paths: dict[str, str], declared: list[tuple] | None = None, root: str | None = None):
        self.spark = spark
        self.frames = {t: spark.read.parquet(p) for t, p in paths.items()}
        self.schema = C.schema_frame(spark, self.frames)
        self.declared = C.declared_constraints(spark, declared)
        files = sorted(tuple(r) for r in listings(spark, paths).collect())  # one row per table
        source = [files, sorted((t, df.schema.json()) for t, df in self.frames.items()), sorted(map(str, self.declared.collect()))]
        self.digest = hashlib.sha256(json.dumps(source, default=str).encode()).hexdigest()
        self.root = f"{root or checkpoint_dir(spark) + '/catalog'}/{self.digest}"

    def part(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored part, or ``build``'s rows, which are stored first."""
        state = VersionedState(self.spark, f"{self.root}/{name}")
        if state.current() < 0:
            state.commit({"rows": build()})
        return self.spark.read.parquet(f"{state.root}/v={state.current()}/rows")

    def constraints(self) -> DataFrame:
        """The declared keys and references that hold on the data."""
        return self.part("constraints", lambda: C.verified_constraints(self.spark, self.frames, self.declared))

    def counts(self) -> DataFrame:
        return self.part("counts", lambda: C.row_counts(self.frames))

    def profile(self) -> DataFrame:
        return self.part("profile", lambda: C.distinct_profile(self.frames))

    def tables(self) -> DataFrame:
        """B15."""
        return self.part("tables", lambda: C.tables_base(self.schema, self.constraints(), self.counts()))

    def columns(self) -> DataFrame:
        """B3, B10, B16."""
        return self.part("columns", lambda: C.catalog_columns(self.schema, self.constraints(), self.profile()))

    def enriched_tables(self, fn, model: str) -> DataFrame:
        """B15 + C7; ``model`` names the completion function: another one has records of its own."""
        return self.part(f"tables-{model}", lambda: N.enrich_tables(self.tables(), fn))

    def enriched_columns(self, fn, model: str) -> DataFrame:
        """B3 + C8."""
        return self.part(f"columns-{model}", lambda: N.enrich_columns(self.columns(), fn))
