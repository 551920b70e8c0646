"""The stored catalog, and enrichment with keywords and its fallbacks."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import enrich as N
from tessera.operators.catalog_store import Catalog

DECLARED = [("a", "a_pk", "pk", 1, "id", None, None), ("b", "b_pk", "pk", 1, "k", None, None), ("b", "b_a_fk", "fk", 1, "a_id", "a", "id"),
            ("a", "a_twice_pk", "pk", 1, "twice", None, None), ("a", "a_null_pk", "pk", 1, "n", None, None)]


def _tables(spark):
    root = tempfile.mkdtemp(prefix="tessera-cat-")
    paths = {t: os.path.join(root, t) for t in ("a", "b")}
    spark.range(20).selectExpr("id", "id div 2 AS twice", "if(id = 3, null, id) AS n").write.parquet(paths["a"])
    spark.range(30).selectExpr("id AS k", "id % 20 AS a_id").write.parquet(paths["b"])
    return root, paths


def test_catalog_is_extracted_once_and_again_when_files_change(spark):
    root, paths = _tables(spark)
    made = []

    def catalog():
        cat = Catalog(spark, paths, DECLARED, root=f"{root}/catalog")
        for name in ("constraints", "counts", "profile", "tables", "columns"):
            build = getattr(cat, name)
            assert build().count() > 0
        return cat

    one = catalog()
    names = {r["constraint_name"] for r in one.constraints().collect()}
    assert names == {"a_pk", "b_pk", "b_a_fk"}              # keys that repeat or hold a null are not verified
    two = catalog()
    assert one.digest == two.digest
    plan = two.tables()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and paths["a"] not in plan and paths["b"] not in plan   # no table is scanned again
    two.part("constraints", lambda: made.append(1))
    assert not made
    spark.range(20, 21).selectExpr("id", "id AS twice", "id AS n").write.mode("append").parquet(paths["a"])
    three = catalog()
    assert three.digest != one.digest
    assert {r["table"]: r["row_count"] for r in three.counts().collect()} == {"a": 21, "b": 30}


def test_unfinished_part_is_made_again(spark):
    root, paths = _tables(spark)
    cat = Catalog(spark, paths, DECLARED, root=f"{root}/catalog")
    spark.range(1).write.parquet(f"{cat.root}/counts/v=0/rows")  # a writer that died before its marker
    assert cat.counts().count() == 2


def test_enrichment_branches(spark, monkeypatch):
    monkeypatch.setattr("time.sleep", lambda s: None)

    def model(prompts):
        answers = {"silent": None, "blank": "  ", "stop": "of it"}
        if any("broken" in p for p in prompts):
            raise RuntimeError("no answer")
        return [next((a for n, a in answers.items() if n in p), "Customers place orders. Orders hold line items of customers.") for p in prompts]

    names = ["good", "silent", "blank", "stop", "broken"]
    t = spark.createDataFrame([(n, ["c"] * 3, ["c"], 5) for n in names], "name string, columns array<string>, primary_keys array<string>, row_count bigint")
    t = t.withColumn("foreign_keys", F.array().cast("array<struct<constrained_columns:array<string>,referred_table:string,referred_columns:array<string>>>"))
    got = {r["name"]: (r["description"], r["keywords"], r["importance_score"]) for r in N.enrich_tables(t, model).collect()}
    assert got["silent"] == got["blank"] == (N.NO_DESCRIPTION, [], 0.0)
    assert got["broken"] == (N.ENRICH_ERROR, [], 0.0)
    assert got["stop"] == ("of it", [], 0.6)                    # no keyword is a success: the score stays
    assert got["good"][2] == 0.6 and got["good"][1][:2] == ["customers place", "place orders"] and len(got["good"][1]) == 5
    none = N.enrich_tables(t, model, keywords_fn=lambda d: F.lit(None).cast("array<string>"))
    assert {r["name"]: (r["keywords"], r["importance_score"]) for r in none.collect()}["good"] == ([], 0.0)  # no keywords could be found
    c = spark.createDataFrame([("t", n, "int", 1, True, False, False, []) for n in names],
                              "table string, name string, data_type string, position int, nullable boolean, is_primary_key boolean, is_foreign_key boolean, distinct_values array<string>")
    cols = {r["name"]: (r["description"], r["ai_name"]) for r in N.enrich_columns(c, model).collect()}
    assert cols["broken"] == (N.ENRICH_COLUMN_ERROR, "placeholder") and cols["silent"][0] == N.NO_DESCRIPTION


def test_keywords_plan_has_no_exchange(spark):
    from tessera.operators import keywords as K

    spark.conf.set("spark.tessera.spread", "0")
    try:
        df = spark.createDataFrame([(1, "Some text. Some words.")], "doc_id bigint, text string")
        assert "Exchange" not in K.extract_keywords(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.tessera.spread", str(os.cpu_count()))
