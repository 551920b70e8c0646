"""Statistics come from footers, and become stale when files change."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.sources import statistics as ST


def _tables(spark):
    root = tempfile.mkdtemp(prefix="tessera-stat-")
    paths = {t: os.path.join(root, t) for t in ("a", "b")}
    spark.range(100).repartition(3).selectExpr("id", "if(id % 10 = 0, null, cast(id AS int)) AS n", "'x' AS s").write.parquet(paths["a"])
    spark.range(7).write.parquet(paths["b"])
    return root, paths


def test_counts_and_ranges_from_footers(spark):
    _, paths = _tables(spark)
    assert {r["table"]: r["row_count"] for r in ST.footer_row_counts(spark, paths).collect()} == {"a": 100, "b": 7}
    got = {(r["table"], r["column"]): (r["row_count"], r["null_count"], r["lo"], r["hi"]) for r in ST.footer_column_ranges(spark, paths).collect()}
    assert got == {("a", "id"): (100, 0, 0, 99), ("a", "n"): (100, 10, 1, 99), ("b", "id"): (7, 0, 0, 6)}


def test_plan_reads_no_data_column(spark):
    _, paths = _tables(spark)
    for df, wanted in ((ST.footer_row_counts(spark, paths), "COUNT(*)"), (ST.footer_column_ranges(spark, {"a": paths["a"]}), "MIN(id)")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan" in plan and "FileScan" not in plan
        assert f"PushedAggregation: [{wanted}" in plan or wanted in plan.split("PushedAggregation", 1)[1]
    # the caller's own reader is as before
    assert "FileScan parquet" in spark.read.parquet(paths["a"]).groupBy().count()._jdf.queryExecution().executedPlan().toString()


def test_statistics_are_kept_and_marked_stale(spark):
    root, paths = _tables(spark)
    store = ST.StatisticsStore(spark, f"{root}/stats")
    assert {r["table"]: (r["row_count"], r["stale"]) for r in store.read(paths).collect()} == {} or all(
        r["stale"] and r["row_count"] is None for r in store.read(paths).collect())
    assert store.refresh(paths) == ["a", "b"] and store.refresh(paths) == []
    assert {r["table"]: (r["row_count"], r["stale"]) for r in store.read(paths).collect()} == {"a": (100, False), "b": (7, False)}
    spark.range(5).selectExpr("id", "1 AS n", "'y' AS s").write.mode("append").parquet(paths["a"])
    assert {r["table"]: (r["row_count"], r["stale"]) for r in store.read(paths).collect()} == {"a": (100, True), "b": (7, False)}
    before = store.state.read("statistics", ST.STATISTICS).where("table = 'b'").first()["as_of"]
    assert store.refresh(paths) == ["a"]  # only the stale table is measured again
    assert {r["table"]: (r["row_count"], r["stale"]) for r in store.read(paths).collect()} == {"a": (105, False), "b": (7, False)}
    assert store.state.read("statistics", ST.STATISTICS).where("table = 'b'").first()["as_of"] == before


def test_same_number_of_files_of_other_contents_is_noticed(spark):
    root, paths = _tables(spark)
    one = ST.listings(spark, {"b": paths["b"]}).first()
    spark.range(7).withColumn("id", F.col("id") + 1).write.mode("overwrite").parquet(paths["b"])
    two = ST.listings(spark, {"b": paths["b"]}).first()
    assert one["files"] == two["files"] and one["digest"] != two["digest"]
