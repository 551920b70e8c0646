"""Sources and sinks: JDBC options, chat-log JSON, templates, snapshots, vector store."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, jdbc, snapshot
from tessera.sources.deltas import Deltas
from tessera.sources.vector_store import VectorStore, refresh, sync, synchronise


def test_jdbc_options():
    for kind in ("postgres", "mysql", "snowflake", "vertica"):
        cfg = jdbc.SourceConfig(kind=kind, host="h", database="db", user="u", password="p", account="acc")
        o = jdbc.jdbc_options(cfg, "orders", partition_column="o_orderkey", lower=0, upper=100, num_partitions=4)
        assert o["driver"] == jdbc.DRIVERS[kind] and o["numPartitions"] == "4" and o["dbtable"].endswith("orders")
    assert "sessionInitStatement" in jdbc.jdbc_options(jdbc.SourceConfig(kind="mysql"), "t")
    with pytest.raises(ValueError):
        jdbc.jdbc_url(jdbc.SourceConfig(kind="oracle"))


def test_execute_sql_captures_errors(spark):
    df, err = jdbc.execute_sql(spark, "SELECT no_such_col FROM range(1)")
    assert df is None and "AnalysisException" in err
    df, err = jdbc.execute_sql(spark, "SELECT :x AS v", {"x": 5})
    assert err is None and df.first()["v"] == 5


def test_chat_log_roundtrip_and_corrupt_lines(spark):
    d = tempfile.mkdtemp(prefix="tessera-chat-")
    msgs = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "bot", '{"success": true}')],
                                 "conv_id bigint, turn bigint, type string, content string")
    files.write_chat_log(msgs, os.path.join(d, "log"))
    back = files.read_chat_log(spark, os.path.join(d, "log"))
    assert sorted(r["content"] for r in back.collect()) == ["hi", '{"success": true}']
    with open(os.path.join(d, "bad.json"), "w") as fh:
        fh.write('{"conv_id": 2, "turn": 0, "type": "user", "content": "ok"}\n{not json\n')
    bad = files.read_chat_log(spark, os.path.join(d, "bad.json"))
    assert [r["content"] for r in bad.collect()] == ["ok"]


def test_template_sources(spark):
    d = tempfile.mkdtemp(prefix="tessera-tpl-")
    p = os.path.join(d, "t.txt")
    with open(p, "w") as fh:
        fh.write("File ${query}\nline2")
    assert files.read_template(spark, p, "inline", "default") == "File ${query}\nline2"
    assert files.read_template(spark, os.path.join(d, "missing.txt"), "inline", "default") == "inline"
    assert files.read_template(spark, None, None, "default") == "default"


def test_snapshot_ttl_and_invalidation(spark):
    path = tempfile.mkdtemp(prefix="tessera-snap-") + "/s"
    frames = {n: spark.range(3).withColumn("n", F.lit(n)) for n in snapshot.RECORD_TYPES}
    assert snapshot.read_snapshot(spark, path) is None                      # missing -> miss
    snapshot.write_snapshot(spark, path, frames)
    assert snapshot.read_snapshot(spark, path, ttl_hours=336) is not None   # fresh -> hit
    assert snapshot.read_snapshot(spark, path, ttl_hours=0) is None         # expired -> miss
    snapshot.invalidate(spark, path)
    assert snapshot.read_snapshot(spark, path) is None                      # invalidated -> miss


DOC = "id string, type string, name string, `table` string, question string, payload string, text string"


def _embed_log(seen):
    """An embedder of two numbers that notes the texts it is asked for."""
    def embed(texts):
        seen.append(sorted(r["text"] for r in texts.collect()))
        return texts.select("id", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    return embed


def test_vector_store_versions(spark):
    root = tempfile.mkdtemp(prefix="tessera-index-")
    store = VectorStore(spark, root, dim=2)
    assert store.is_empty()
    docs = spark.createDataFrame([("a", "table", [1.0, 0.0], "a", "a", None, "{}")],
                                 "id string, type string, vector array<float>, name string, table string, "
                                 "question string, payload string")
    store.upsert(docs)
    store.upsert(docs.withColumn("id", F.lit("b")))
    assert {r["id"] for r in store.read().collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        store.upsert(docs.withColumn("vector", F.array(F.lit(1.0).cast("float"))))
    assert {r["id"] for r in store.read().collect()} == {"a", "b"}   # failed write left the version intact


def test_only_changed_documents_are_embedded_and_written(spark):
    store, seen = VectorStore(spark, tempfile.mkdtemp(prefix="tessera-index-"), dim=2), []
    rows = [("a", "table", "a", "t", None, "{}", "one"), ("b", "column", "b", "t", None, "{}", "three"), ("c", "column", "c", "t", None, "{}", None)]
    docs = spark.createDataFrame(rows, DOC)
    counts = lambda df: {r["status"]: r["n"] for r in df.collect()}
    assert counts(sync(store, docs, lambda t: _embed_log(seen)(t.fillna("")))) == {"inserted": 3}
    assert sync(store, docs, _embed_log(seen)) is None                           # D13: not empty, not asked
    assert counts(refresh(store, docs, _embed_log(seen))) == {"untouched": 3} and store.state.current() == 0
    edited = spark.createDataFrame([("a", "table", "a", "t", None, "{}", "seven!!"), ("b", "column", "b", "t", None, '{"x":1}', "three"),
                                    ("c", "column", "c", "t", None, "{}", None), ("d", "table", "d", "t", None, "{}", "dd")], DOC)
    assert counts(refresh(store, edited, _embed_log(seen))) == {"changed": 1, "inserted": 1, "payload": 1, "untouched": 1}
    assert seen == [["", "one", "three"], ["dd", "seven!!"]]                     # no text is embedded twice
    assert {r["version"]: r["n"] for r in store.written().collect()} == {0: 3, 1: 3}
    got = {r["id"]: (r["vector"][0], r["payload"]) for r in store.read().collect()}
    assert got == {"a": (7.0, "{}"), "b": (5.0, '{"x":1}'), "c": (0.0, "{}"), "d": (2.0, "{}")}
    assert counts(synchronise(store, edited.where("id <> 'a'"), _embed_log(seen), remove=True)) == {"untouched": 3, "removed": 1}
    assert {r["id"] for r in store.read().collect()} == {"b", "c", "d"}


def test_deletes_updates_and_compaction_of_the_store(spark):
    store, seen = VectorStore(spark, tempfile.mkdtemp(prefix="tessera-index-"), dim=2), []
    docs = spark.createDataFrame([(x, t, x, "t", None, "{}", x * 2) for x, t in zip("abcd", ("table", "column", "query", "query"))], DOC)
    synchronise(store, docs, _embed_log(seen))
    store.delete(spark.createDataFrame([("b",), ("zz",), ("b",)], "id string"))
    store.update_vectors(spark.createDataFrame([("c", [9.0, 9.0]), ("nope", [1.0, 1.0])], "id string, vector array<float>"))
    state = lambda: {r["id"]: r["vector"] for r in store.read().collect()}
    want = {"a": [2.0, 1.0], "c": [9.0, 9.0], "d": [2.0, 1.0]}
    assert state() == want and {r["version"]: r["n"] for r in store.written().collect()} == {0: 4, 1: 1, 2: 1}
    store.compact()
    assert state() == want and {r["version"]: r["n"] for r in store.written().collect()} == {3: 3}
    store.upsert(store.read().where("id = 'a'").withColumn("id", F.lit("b")))     # comes back after its deletion
    assert set(state()) == {"a", "b", "c", "d"}
    probes = spark.createDataFrame([("a",), ("x",)], "id string")
    assert {r["id"]: r["exists"] for r in store.exists(probes, ["id"]).collect()} == {"a": True, "x": False}


def test_unfinished_compaction_is_not_read(spark):
    table = Deltas(spark, tempfile.mkdtemp(prefix="tessera-delta-"), "k bigint, n bigint")
    fold = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    for i in range(3):
        assert table.append(spark.createDataFrame([(1, 1), (2, i)], "k long, n long"), "s", i)
    assert not table.append(spark.createDataFrame([(1, 100)], "k long, n long"), "s", 2)   # a replayed batch
    fold(table.read()).write.parquet(f"{table.state.root}/v=3/base")                       # dies before its marker
    table.append(spark.createDataFrame([(2, 5)], "k long, n long"), "s", 3)
    want = {1: 3, 2: 8}
    assert {r["k"]: r["n"] for r in fold(table.read()).collect()} == want
    table.compact(fold)
    assert len(table.paths()) == 1 and {r["k"]: r["n"] for r in fold(table.read()).collect()} == want
    assert table.append(spark.createDataFrame([(3, 1)], "k long, n long"), "s", 4)
    assert {r["k"]: r["n"] for r in fold(table.read()).collect()} == {**want, 3: 1}
