"""Scalar functions against expected values."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import enrich as N
from tessera.operators import vectors as V

# text -> spaces normalised, sentences capitalised, spaced as SQL, words, looks like SQL, blank, control characters
TEXTS = [
    ("", "", "", "", 1, False, True, False),
    ("  ", "", "  ", "", 1, False, True, False),
    ("hello world", "hello world", "Hello world", "hello world", 2, False, False, False),
    ("a.  b. c", "a. b. c", "A.  B. C", "a. b. c", 3, False, False, False),
    ("x\tselect * from t", "x select * from t", "X\tselect * from t", "x select * from t", 5, True, False, False),
    ("Über café. über. ok", "Über café. über. ok", "Über café. über. Ok", "Über café. über. ok", 4, False, False, False),
    ("line1\nline2\n", "line1 line2", "Line1\nline2\n", "line1 line2", 2, False, False, False),
    ("a , b=c,d = e", "a , b=c,d = e", "A , b=c,d = e", "a, b = c, d = e", 5, False, False, False),
    ("  lead and trail  ", "lead and trail", "  lead and trail  ", "lead and trail", 3, False, False, False),
    ("no SELECTION here", "no SELECTION here", "No SELECTION here", "no SELECTION here", 3, False, False, False),
    ("ctrl\x01char", "ctrl\x01char", "Ctrl\x01char", "ctrl\x01char", 1, False, False, True),
    ("id_from_x join", "id_from_x join", "Id_from_x join", "id_from_x join", 2, True, False, False),
    ("end." + " " * 3000 + "next", "end. next", "End." + " " * 3000 + "Next", "end. next", 2, False, False, False),
]


def test_text_functions_give_the_expected_texts(spark):
    df = spark.createDataFrame([(r[0],) for r in TEXTS], "t string")
    rows = df.select("t", X.normalize_spaces("t").alias("n"), X.capitalize_sentences("t").alias("c"),
                     X.format_as_sql("t").alias("s"), X.text_stats("t")["words"].alias("w"),
                     X.looks_like_sql("t").alias("q"), X.is_blank("t").alias("b"),
                     X.has_control_chars("t").alias("ctl")).collect()
    assert sorted(tuple(r) for r in rows) == sorted(TEXTS)


def test_header_title_and_display(spark):
    df = spark.createDataFrame([("o_orderKEY",), ("name",), ("x" * 120,)], "h string")
    got = [r[0] for r in df.select(X.header_title("h")).collect()]
    assert got[:2] == ["O Orderkey", "Name"]
    disp = [r[0] for r in df.select(X.display_value("h")).collect()]
    assert disp[2] == "x" * 100 + "..."
    nul = spark.createDataFrame([(None,)], "h string").select(X.display_value("h")).first()[0]
    assert nul == "NULL"


def test_sql_layout_quirk(spark):
    df = spark.createDataFrame([("select a,b from t where x = 1 group by a order by b",)], "q string")
    out = df.select(X.sql_layout("q")).first()[0]
    assert out == ("\n    SELECT a,b\n    FROM t\n    WHERE x = 1\n    GROUP BY a\n    ORDER BY b")


def test_iso_timestamp_fraction_only_when_nonzero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),), (dt.datetime(2024, 1, 2, 3, 4, 5, 120),)],
                               "ts timestamp_ntz")
    got = [r[0] for r in df.select(X.iso_timestamp("ts")).collect()]
    assert got == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.000120"]


def test_uuid5_equals_python(spark):
    names = ["table_orders", "column_orders_o_custkey", "Ünïcödé question?", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(V.uuid5_dns("n")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    assert got[0] == "834d01f2-cde1-5e10-a7ba-742b316aced3"


def test_importance_fixtures(spark):
    rows = [(0, 0, False), (1, 2, True), (3, 9, True)]
    df = spark.createDataFrame(rows, "nfk int, ncol int, pk boolean").select(
        F.array_repeat(F.lit("f"), "nfk").alias("fks"), F.array_repeat(F.lit("c"), "ncol").alias("cols"),
        F.when(F.col("pk"), F.array(F.lit("id"))).otherwise(F.array().cast("array<string>")).alias("pks"))
    got = [r[0] for r in df.select(N.importance_score(F.col("fks"), F.col("cols"), F.col("pks"))).collect()]
    assert got == [0.0, 0.7, 1.0]
