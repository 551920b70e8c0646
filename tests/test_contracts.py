"""Model contracts (D1/D2, C4, C6), parquet attach (A5) and the K2/K3 streams."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.operators import answer as A
from tessera.operators import enrich as N
from tessera.operators import vectors as V
from tessera.sources import jdbc
from tessera.sources.vector_store import VectorStore, apply_index_batch
from tessera.streaming.feedback_stream import run_upsert_stream, stream_questions


def test_embed_with_external_function(spark):
    calls = []

    def fake_model(texts):
        calls.append(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id int, t string")
    out = {r["id"]: list(r["vector"]) for r in V.embed_with(df, "t", fake_model, 2).collect()}
    assert out[3] == [3.0, 1.0] and len(out) == 10


def test_complete_dedupes_and_nulls_failures(spark):
    def flaky(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("provider down")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "boom")], "id int, p string").repartition(1)
    got = {r["id"]: r["ans"] for r in A.complete(df, "p", "ans", flaky, attempts=1).collect()}
    assert got == {1: "A", 2: "A", 3: None}


def test_model_keywords(spark):
    def kw_model(prompts):
        return ['```json\n{"keywords": ["alpha", "beta"]}\n```' if "good" in p else "not json" for p in prompts]

    df = spark.createDataFrame([(1, "good text"), (2, "bad text")], "id int, t string")
    got = {r["id"]: [(k["keyword"], k["score"]) for k in r["keywords"]]
           for r in N.model_keywords(df, "t", kw_model).collect()}
    assert got == {1: [("alpha", 1.0), ("beta", 1.0)], 2: []}


def test_attach_parquet_registers_views(spark):
    frames = jdbc.attach(spark, jdbc.SourceConfig(kind="parquet", path="/root/testdata/sf0.001"), ["nation"])
    assert spark.sql("SELECT count(*) AS n FROM nation").first()["n"] == 25 and "nation" in frames


def test_index_stream_upserts_each_batch_once(spark):
    src = tempfile.mkdtemp(prefix="tessera-docs-")
    rows = [("a", "table", [1.0, 0.0], "a", "a", None, "{}"), ("b", "column", [0.0, 1.0], "b", "a", None, "{}")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "id string, type string, vector array<float>, name string, table string, "
                                   "question string, payload string").toPandas() \
            .to_parquet(os.path.join(src, f"docs{i}.parquet"), index=False)
    store = VectorStore(spark, tempfile.mkdtemp(prefix="tessera-idx-"), dim=2)
    for name in ("x", "y", "z"):  # versions that no stream wrote
        store.upsert(spark.createDataFrame([(name, "query", [0.5, 0.5], name, None, "q", "{}")] * 2, store.read().schema))
    run_upsert_stream(spark, src, "docs*.parquet", apply_index_batch(store))
    assert sorted(r["id"] for r in store.read().collect()) == ["a", "b", "x", "y", "z"]
    assert store.state.current() == 4 and store.state.applied("index") == 1
    apply_index_batch(store)(None, store.read().limit(0), 1)  # a replayed batch
    assert store.state.current() == 4


def test_a_writer_that_dies_leaves_the_version_before_it(spark):
    from tessera.sources.versioned import VersionedState

    state = VersionedState(spark, tempfile.mkdtemp(prefix="tessera-state-"))
    assert state.current() == -1 and state.read("t", "id bigint").count() == 0
    state.commit({"t": spark.range(3)})
    spark.range(9).write.parquet(f"{state.root}/v=1/t")  # no marker
    assert state.current() == 0 and state.read("t", "id bigint").count() == 3
    state.commit({"t": spark.range(5)}, "s", 7)
    assert state.read("t", "id bigint").count() == 5 and state.applied("s") == 7


def test_wrong_or_missing_vectors_are_refused(spark):
    store = VectorStore(spark, tempfile.mkdtemp(prefix="tessera-idx-"), dim=2)
    for vector in ([1.0], None):
        with pytest.raises(ValueError, match="dimension"):
            store.upsert(spark.createDataFrame([("a", "table", vector, "a", "a", None, "{}")], store.read().schema))
    assert store.is_empty()


def test_question_stream_runs_recipe(spark):
    src = tempfile.mkdtemp(prefix="tessera-q-")
    spark.createDataFrame([(1, "How many click events are there?")], "question_id bigint, original_query string") \
        .toPandas().to_parquet(os.path.join(src, "q0.parquet"), index=False)
    qs = spark.readStream.schema("question_id bigint, original_query string").option("maxFilesPerTrigger", 1).parquet(src)
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.createOrReplaceTempView("events")

    def answer(batch):
        d = A.understand(batch).withColumn("final_prompt", F.concat(F.lit("Question: "), F.col("original_query")))
        d = A.parse_answer(A.complete(d, "final_prompt", "llm_response", models.write_sql))
        return A.assemble_response(A.execute_distinct(spark, d)).select("question_id", "success", "preview")

    for i in (2, 3):
        spark.createDataFrame([(i, "How many click events are there?")], "question_id bigint, original_query string") \
            .toPandas().to_parquet(os.path.join(src, f"q{i}.parquet"), index=False)
    out = {r["question_id"]: r for r in stream_questions(spark, qs, answer).collect()}
    n = ev.where("event_type = 'click'").count()
    assert sorted(out) == [1, 2, 3] and all(r["success"] and r["preview"] == [f'{{"n":{n}}}'] for r in out.values())
