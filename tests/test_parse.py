"""Answer parsing (E13-E16), guarded execution (E17, E18) and prompt templating."""

import string

from pyspark.sql import functions as F

from tessera.operators import answer as A

# answer text -> (query, explanation), written out by hand
CASES = [
    ('{"query": "SELECT 1", "explanation": "e"}', ("SELECT 1", "e")),
    ('Sure:\n```json\n{"query": "SELECT 2", "explanation": "two"}\n```\nbye', ("SELECT 2", "two")),
    ('```\n{"query": "SELECT 3"}\n```', ("SELECT 3", None)),
    ("[1]", (None, None)), ('"s"', (None, None)), ("5", (None, None)),
    ('{"query":"a"} x', (None, None)),
    ('{"explanation":"e"}', (None, None)), ('{"query": ""}', (None, None)),
    ("Here it is: ```sql\nSELECT * FROM t\n``` done", ("SELECT * FROM t", "Here it is:")),
    ("Try select a\nfrom b; ok", ("select a\nfrom b;", "Try")),
    ("select 1", (None, None)),
    ("", (None, None)), (None, (None, None)),
    ("DELETE FROM t;", ("DELETE FROM t;", None)),
]


def test_parse_gives_the_expected_parts(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, llm_response string")
    got = {r["i"]: (r["sql_query"], r["explanation"]) for r in A.parse_answer(df).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i] == want, text


def test_read_only_guard(spark, tmp_path):
    reads = ["SELECT 1", "with a as (select 1) select * from a;", "SELECT*FROM t", "SELECT ';' AS x", "(SELECT 1)", "-- a note\nSELECT 1", "VALUES (1)",
             "SELECT * FROM t WHERE x IN (SELECT y FROM u)", "FROM t SELECT a", "SELECT 'reflect (x)'", "SELECT a AS reflect FROM t", "TABLE t",
             "SELECT builtin.lower(a), system.builtin.upper(b) FROM t", "SELECT * FROM range(3)", "SELECT * FROM t LATERAL VIEW explode(x) y AS z",
             "SELECT a, count(*) FROM t GROUP BY a HAVING count(*) > 1 ORDER BY 2 DESC LIMIT 3 OFFSET 1", "SELECT * FROM t, LATERAL (SELECT a + 1) x",
             "SELECT sum(a) OVER w FROM t WINDOW w AS (PARTITION BY b)", "SELECT a FROM t UNION ALL SELECT b FROM u EXCEPT SELECT 1", "FROM t |> WHERE a > 1 |> SELECT b"]
    target = tmp_path / "out"
    writes = ["DELETE FROM t;", "SELECT 1; DROP TABLE x", "json\nSELECT 1", "", "SET a = 1", "CREATE TABLE t AS SELECT 1", "FROM a INSERT INTO t SELECT 1 INSERT INTO u SELECT 2",
              f"WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{target}' USING parquet SELECT * FROM a", "EXPLAIN SELECT 1",
              "SELECT TRANSFORM (a) USING 'cat' FROM t", "SELECT java_method('java.lang.System', 'exit', 0)",
              "SELECT `reflect`('java.util.UUID', 'randomUUID')", "SELECT reflect/**/('java.util.UUID', 'randomUUID')", "SELECT REFLECT  ('java.util.UUID', 'randomUUID')",
              "SELECT builtin.reflect('java.util.UUID', 'randomUUID')", "SELECT a FROM t WHERE b IN (SELECT try_reflect('java.util.UUID', 'randomUUID'))",
              "SELECT transform(array(1), x -> java_method('java.lang.Math', 'abs', x))", "EXECUTE IMMEDIATE 'CREATE TEMPORARY VIEW zz AS SELECT 1'", "CALL x.y()",
              "SELECT my_own_function(a) FROM t", "SELECT other.lower(a) FROM t", "SELECT * FROM my_table_function(1)", "SELECT * FROM IDENTIFIER('t')"]
    assert [s for s in reads if not A.is_read_only(spark, s)] == []
    assert [s for s in writes if A.is_read_only(spark, s)] == []
    assert not target.exists()


def test_each_statement_runs_alone(spark, tmp_path):
    target = tmp_path / "out"
    spark.range(25).createOrReplaceTempView("numbers")
    statements = ["SELECT id FROM numbers ORDER BY id DESC", "SELECT CAST('x' AS INT) AS y", "SELECT nothing FROM numbers", "SELECT 1 AS a, 2 AS a, null AS b",
                  f"WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{target}' USING parquet SELECT * FROM a", None, "SELECT id FROM numbers WHERE id < 0"]
    df = spark.createDataFrame([(i, s, s) for i, s in enumerate(statements)], "i int, sql_query string, llm_response string").withColumn("explanation", F.lit("e"))
    rows = {r["i"]: r for r in A.assemble_response(A.execute_distinct(spark, df)).collect()}
    assert [rows[i]["success"] for i in range(7)] == [True, False, False, True, False, False, True]
    assert rows[0]["row_count"] == 25 and rows[0]["preview"][0] == '{"id":24}' and len(rows[0]["preview"]) == 10
    assert [r["id"] for r in A.full_result(spark, rows[0]["result_path"]).collect()] == list(range(24, -1, -1))
    assert rows[1]["error"] == rows[2]["error"] == A.ERR_EXEC and rows[4]["error"] == A.ERR_READ_ONLY and not target.exists()
    assert rows[3]["row_count"] == 1 and rows[6]["row_count"] == 0 and rows[6]["preview"] == []


def test_statements_cannot_reach_the_caller(spark, tmp_path):
    from pyspark.sql import types as T

    spark.range(3).createOrReplaceTempView("numbers")
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "files"))
    spark.udf.register("leak", lambda x: x, T.LongType())
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW owned AS SELECT leak(id) AS id FROM numbers")
    statements = ["EXECUTE IMMEDIATE 'CREATE TEMPORARY VIEW zz AS SELECT 1'", "SELECT `reflect`('java.util.UUID', 'randomUUID') AS u", "SELECT leak(id) AS x FROM numbers",
                  f"SELECT * FROM parquet.`{tmp_path / 'files'}`", "SELECT IDENTIFIER('ref' || 'lect')('java.util.UUID', 'randomUUID') AS u",
                  "SELECT id FROM owned ORDER BY id", "SELECT 'reflect (x)' AS text", "SELECT id AS _position, id AS `_POSITION_` FROM numbers ORDER BY id DESC"]
    df = spark.createDataFrame(list(enumerate(statements)), "i int, sql_query string")
    rows = {r["i"]: r for r in A.execute_distinct(spark, df).collect()}
    assert [rows[i]["refused"] for i in range(8)] == [True, True, True, False, True, False, False, False]
    assert [rows[i]["executed"] for i in range(8)] == [False] * 5 + [True] * 3          # a path is no table: that one fails
    assert not spark.catalog.tableExists("zz")
    assert rows[5]["row_count"] == 3 and rows[6]["preview"] == ['{"text":"reflect (x)"}']  # an owner's view may call the owner's function
    assert rows[7]["preview"][0] == '{"_position":2,"_POSITION_":2}' or rows[7]["row_count"] == 3
    assert [r["_position"] for r in A.full_result(spark, rows[7]["result_path"]).collect()] == [2, 1, 0]


def test_many_statements_run_side_by_side(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    df = spark.range(40).selectExpr("id", "concat('SELECT count(*) AS n FROM numbers WHERE id < ', id % 13) AS sql_query")
    got = A.execute_distinct(spark, df, at_once=3).collect()
    assert len(got) == 40 and all(r["preview"] == [f'{{"n":{min(r["id"] % 13, 10)}}}'] and r["row_count"] == 1 for r in got)


def test_failed_stage_gives_failed_responses(spark):
    def broken(_df):
        raise RuntimeError("no model")

    out = A.run_recipe(spark.createDataFrame([(1, "q")], "question_id int, original_query string"), (A.understand, broken), strict=False).collect()
    assert [(r["question_id"], r["success"], r["error"]) for r in out] == [(1, False, "RuntimeError: no model")]


def test_lenient_json_keeps_objects_without_a_query(spark):
    df = spark.createDataFrame([('{"explanation": "why"}',), ('{"query": "SELECT 1"}',), ("nothing",), (None,)], "c string")
    got = [tuple(r["r"]) for r in df.select(A.lenient_json(F.col("c")).alias("r")).collect()]
    assert got == [("", "why"), ("SELECT 1", None), ("", "Error during JSON parsing"), ("", "Error during JSON parsing")]


def test_template_equals_safe_substitute(spark):
    templates = [A.DEFAULT_TEMPLATE, "a ${context} b $query c ${unknown} d $$ e $schema$", "$", "no placeholders"]
    q = "what about ${schema} and $context?"
    for tpl in templates:
        df = spark.createDataFrame([("CTX", q)], "context string, query string")
        got = df.select(A.build_prompt(tpl, {"context": F.col("context"), "query": F.col("query"),
                                             "schema": F.lit("main")})).first()[0]
        want = string.Template(tpl).safe_substitute(context="CTX", query=q, schema="main")
        assert got == want, tpl


def test_context_sections(spark):
    schema = ("tables array<struct<name:string,primary_keys:array<string>,description:string,columns:array<string>>>, "
              "columns array<struct<table:string,name:string,data_type:string,is_primary_key:boolean,"
              "is_foreign_key:boolean,nullable:boolean,description:string>>, "
              "queries array<struct<question:string,sql_query:string,explanation:string>>")
    t = [(f"t{i}", ["id"] if i == 0 else [], None if i == 1 else f"d{i}", ["id", "x"]) for i in range(7)]
    c = [("t0", f"c{i}", "int", i == 0, False, True, None) for i in range(12)]
    q = [(f"q{i}", f"SELECT {i}", None) for i in range(3)]
    df = spark.createDataFrame([([], [], []), (t, c, q)], schema)
    out = [r[0] for r in df.select(A.assemble_context(F.col("tables"), F.col("columns"), F.col("queries"))).collect()]
    assert out[0] == A.NO_CONTEXT
    full = out[1]
    assert full.startswith("RELEVANT TABLES:\nTable: t0\nPrimary Keys: id\nDescription: d0\nColumns: id, x")
    assert full.count("Table: ") == 5 and full.count("Column: ") == 10 and full.count("Question: ") == 2
    assert "Table: t1\nColumns: id, x" in full  # null description omitted
    assert "Column: t0.c0\nType: int\nAttributes: Primary Key, Nullable" in full
