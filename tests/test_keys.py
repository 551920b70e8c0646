"""Key discovery against brute force, and the plans it promises."""

import itertools
import random

import pytest

from tessera.operators import keys as K


def _minimal_keys(rows, names, most):
    keys = []
    for size in range(1, most + 1):
        for cols in itertools.combinations(range(len(names)), size):
            if any(set(k) <= set(cols) for k in keys):
                continue
            values = [tuple(r[i] for i in cols) for r in rows]
            if rows and all(None not in v for v in values) and len(set(values)) == len(rows):
                keys.append(cols)
    return {tuple(names[i] for i in k) for k in keys if len(k) > 1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_composite_keys_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = sorted({(rng.randint(0, 5), rng.randint(0, 5), rng.choice("abcd"), rng.choice(["x", "y", None]), 1) for _ in range(40)},
                  key=str)
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "a int, b bigint, c string, d string, e int")
    empty = spark.createDataFrame([], "p int, q int")
    got = K.composite_keys(spark, {"t": df, "none": empty}).collect()
    assert {tuple(r["columns"]) for r in got} == _minimal_keys(rows, names, 3)
    assert {(r["table"], r["row_count"]) for r in got} <= {("t", len(rows))}


def test_key_of_two_columns_among_many_rows(spark):
    df = spark.range(4000).selectExpr("id div 4 AS o", "cast(id % 4 AS int) AS l", "concat('t', id % 2) AS s", "id % 2 AS f")
    got = {tuple(r["columns"]) for r in K.composite_keys(spark, {"lines": df}).collect()}
    assert got == {("o", "l")}


def test_more_columns_than_one_mask_holds(spark):
    wide = spark.range(20).selectExpr(*[f"id % {i + 1} AS c{i}" for i in range(70)])
    keys = spark.range(200).selectExpr("id AS k")
    got = {(r["table"], r["column"], r["ref_table"], r["ref_column"]) for r in K.inclusions(spark, {"w": wide, "p": keys}).collect()}
    unique = [f"c{i}" for i in range(19, 70)]
    assert {x for x in got if x[2] == "p"} == {("w", f"c{i}", "p", "k") for i in range(70)}
    assert {x for x in got if x[2] == "w"} == {("w", f"c{i}", "w", u) for i in range(70) for u in unique if f"c{i}" != u}


def test_texts_are_not_multiplied(spark):
    """Expand / Generate see digests: no text column is repeated per key column or shuffled."""
    df = spark.createDataFrame([("x" * 50, "y", 1)], "t string, u string, n int")
    plan = K.column_stats({"d": df})._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    generate = [line for line in plan.splitlines() if "Generate explode" in line]
    assert generate and all("t#" not in line and "u#" not in line for line in generate)


def test_nulls_empty_tables_and_odd_names(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (None, None, "b")], "`odd.name` int, nothing int, s string")
    stats = {r["column"]: (r["row_count"], r["null_count"], r["n_distinct"]) for r in K.column_stats({"t": df, "e": df.limit(0)}).where("table = 't'").collect()}
    assert stats == {"odd.name": (3, 1, 2), "nothing": (3, 3, 0), "s": (3, 0, 2)}
    assert K.inclusions(spark, {"e": df.limit(0)}).count() == 0
