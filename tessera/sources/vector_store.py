"""The vector index as a table of deltas.

Rows: id, type, vector array<float>, name, table, question, payload. Every write checks the dimension of the arriving
vectors before it starts and writes the rows that change, as a delta: new and replaced documents in full, deleted
ones as a mark. Readers take the last version of every id. Files are partitioned by ``type``.

Synchronising (D13, D14) is change data capture by content: the digests of a document's text and of its other fields
are stored with it; only new documents and those whose text digest differs are embedded, a document of which only other
fields changed keeps its vector, and untouched ones are neither embedded nor written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vectors as V
from tessera.schemas import VECTOR_INDEX
from tessera.session import materialize
from tessera.sources.deltas import Deltas

FIELDS = VECTOR_INDEX.names
CONTENT = [c for c in FIELDS if c not in ("id", "vector")]
STORED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VECTOR_INDEX.fields) + ", text_digest string, deleted boolean"


class VectorStore:
    def __init__(self, spark: SparkSession, root: str, dim: int):
        self.spark, self.dim = spark, dim
        self.table = Deltas(spark, root, STORED, ("type",))
        self.state = self.table.state

    def rows(self) -> DataFrame:
        """Current documents with their text digest: the last version of each id, without deleted ones."""
        return self._last(self.table.read())

    def _last(self, rows: DataFrame) -> DataFrame:
        names = [*FIELDS, "text_digest", "deleted"]
        if len(self.table.paths()) < 2:  # a version holds an id once
            return rows.select(*names).where("not deleted")
        first = rows.agg(F.min("version")).first()[0]
        later = rows.where(F.col("version") > first)
        newest = later.groupBy("id").agg(F.max("version").alias("version"))
        # the first version is the bulk of the table: it only loses ids, later ones are told apart by version
        kept = rows.where(F.col("version") == first).join(newest.select("id"), "id", "left_anti")
        return kept.select(*names).unionByName(later.join(newest, ["id", "version"]).select(*names)).where("not deleted")

    def read(self) -> DataFrame:
        return self.rows().select(*FIELDS)

    def is_empty(self) -> bool:
        """True when there is no document (an index that cannot be read raises)."""
        return self.read().isEmpty()

    def _check(self, vectors: DataFrame) -> None:
        bad = F.col("vector").isNull() | (F.size("vector") != self.dim)
        if vectors.where(bad).limit(1).count():
            raise ValueError(f"vector dimension differs from {self.dim}")

    def _append(self, rows: DataFrame, stream: str | None = None, batch_id: int | None = None) -> None:
        for name, kind in (("text_digest", "string"), ("deleted", "boolean")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None if name == "text_digest" else False).cast(kind))
        self.table.append(rows.select(*FIELDS, "text_digest", "deleted"), stream, batch_id)

    def upsert(self, batch: DataFrame, stream: str | None = None, batch_id: int | None = None) -> None:
        """D7-D9 (batch form): the batch's documents are written, one per id (the largest row)."""
        extra = [c for c in ("text_digest",) if c in batch.columns]
        batch = batch.select(*[F.col(f.name).cast(f.dataType) for f in VECTOR_INDEX.fields], *extra)
        self._check(batch)
        one = batch.groupBy(F.col("id").alias("_key")).agg(F.max(F.struct(*batch.columns)).alias("_row")).select("_row.*")
        self._append(one, stream, batch_id)

    def delete(self, ids: DataFrame) -> None:
        """Documents that are there get a mark."""
        gone = self.rows().join(ids.select("id").distinct(), "id", "left_semi")
        self._append(gone.withColumn("deleted", F.lit(True)))

    def update_vectors(self, new: DataFrame) -> None:
        """Documents that are there get the new vector; others are not added."""
        self._check(new)
        one = new.groupBy("id").agg(F.max("vector").alias("_new"))
        self._append(self.rows().join(one, "id").withColumn("vector", F.col("_new")).drop("_new"))

    def exists(self, probes: DataFrame, on: list[str]) -> DataFrame:
        """D16."""
        return V.exists_by(self.read(), probes, on)

    def written(self) -> DataFrame:
        """(version, n): rows that every version since the last compaction wrote."""
        return self.table.read().groupBy("version").agg(F.count(F.lit(1)).alias("n"))

    def compact(self) -> None:
        """Fold all versions into one."""
        self.table.compact(lambda rows: self._last(rows))


def changes(store: VectorStore, docs: DataFrame) -> DataFrame:
    """``docs`` (index fields without vector, plus ``text``) with ``text_digest``, ``status`` and the stored ``vector``.

    status: ``inserted`` (unknown id), ``changed`` (another text), ``payload`` (same text, other fields), ``untouched``.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    fields = F.sha2(F.to_json(F.struct(*CONTENT), {"ignoreNullFields": "false"}), 256)
    known = store.rows().select("id", F.col("text_digest").alias("_text"), fields.alias("_fields"), "vector")
    seen = docs.select("id", *CONTENT, "text").withColumn("text_digest", digest).withColumn("_now", fields).join(known, "id", "left")
    status = (F.when(F.col("_fields").isNull(), "inserted").when(~F.col("_text").eqNullSafe(F.col("text_digest")), "changed")
              .when(F.col("_fields") != F.col("_now"), "payload").otherwise("untouched"))
    return seen.withColumn("status", status).drop("_text", "_fields", "_now")


def synchronise(store: VectorStore, docs: DataFrame, embed: Callable[[DataFrame], DataFrame], remove: bool = False) -> DataFrame:
    """Bring the store to the state of ``docs`` (one row per id); returns (status, n).

    ``embed`` turns (id, text) into (id, vector) and sees new and changed documents only. With ``remove`` documents
    that ``docs`` does not hold are deleted (status ``removed``). Without a change nothing is written.
    """
    found = materialize(changes(store, docs), "sync")
    counts = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}  # four numbers
    todo = found.where("status in ('inserted', 'changed')")
    rows = []
    if counts.get("inserted") or counts.get("changed"):
        rows.append(todo.drop("vector").join(embed(todo.select("id", "text")).select("id", "vector"), "id"))
    if counts.get("payload"):
        rows.append(found.where("status = 'payload'"))
    parts = [r.select(*FIELDS, "text_digest", F.lit(False).alias("deleted")) for r in rows]
    if remove:
        gone = materialize(store.rows().join(docs.select("id"), "id", "left_anti").withColumn("deleted", F.lit(True)), "removed")
        counts["removed"] = gone.count()
        parts += [gone.select(*FIELDS, "text_digest", "deleted")] if counts["removed"] else []
    if parts:
        batch = parts[0]
        for more in parts[1:]:
            batch = batch.unionByName(more)
        batch = materialize(batch, "batch")  # embedded once, checked, then written
        store._check(batch)
        store._append(batch)
    return store.spark.createDataFrame(sorted(counts.items()), "status string, n bigint")


def sync(store: VectorStore, docs: DataFrame, embed: Callable[[DataFrame], DataFrame], sync_on_startup: bool = False) -> DataFrame | None:
    """Synchronise when the index is empty or when asked; None if it did neither."""
    return synchronise(store, docs, embed) if sync_on_startup or store.is_empty() else None


def refresh(store: VectorStore, docs: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Synchronise always, nothing is cleared."""
    return synchronise(store, docs, embed)


def apply_index_batch(store: VectorStore, stream: str = "index"):
    """K2: ``foreachBatch`` body that upserts arriving documents, once per batch of the stream."""
    def run(_state, batch: DataFrame, batch_id: int) -> None:
        if batch_id > store.state.applied(stream):
            store.upsert(batch, stream, batch_id)
    return run
