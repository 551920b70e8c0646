"""Constraint folding on the FIXTURES shapes: composite FK, self-reference, two FKs to one table, no key."""

from tessera.operators import catalog as C
from tessera.operators import keys as K

CONS = [
    ("emp", "emp_pk", "pk", 1, "id", None, None),
    ("emp", "emp_mgr_fk", "fk", 1, "manager_id", "emp", "id"),          # self-reference
    ("line", "line_pk", "pk", 1, "order_id", None, None),
    ("line", "line_pk", "pk", 2, "line_no", None, None),
    ("ship", "ship_line_fk", "fk", 2, "l_no", "line", "line_no"),        # composite, listed out of order
    ("ship", "ship_line_fk", "fk", 1, "o_id", "line", "order_id"),
    ("ship", "ship_from_fk", "fk", 1, "from_emp", "emp", "id"),          # two FKs to one table
    ("ship", "ship_to_fk", "fk", 1, "to_emp", "emp", "id"),
    ("ship", "ship_gone_fk", "fk", 1, "x", "missing_table", "id"),       # unavailable table
]


def test_fk_records_and_relationships(spark):
    cons = C.declared_constraints(spark, CONS)
    tables = spark.createDataFrame([("emp",), ("line",), ("ship",), ("log",)], "name string")  # log: no key
    rec = {r["constraint_name"]: (r["constrained_columns"], r["referred_table"], r["referred_columns"])
           for r in C.fk_records(cons, tables).collect()}
    assert rec["ship_line_fk"] == (["o_id", "l_no"], "line", ["order_id", "line_no"])
    assert "ship_gone_fk" not in rec
    rel = {(r["table"], r["direction"], r["constraint_name"]) for r in C.relationships(cons, tables).collect()}
    assert ("emp", "outgoing", "emp_mgr_fk") in rel and ("emp", "incoming", "emp_mgr_fk") in rel
    assert sum(1 for t, d, c in rel if t == "emp" and d == "incoming") == 3
    pks = {r["table"]: r["primary_keys"] for r in C.primary_keys(cons).collect()}
    assert pks == {"emp": ["id"], "line": ["order_id", "line_no"]}


def test_fk_violations_and_key_discovery(spark):
    emp = spark.createDataFrame([(1, None), (2, 1), (3, 9)], "id int, manager_id int")   # 9 is an orphan
    frames = {"emp": emp}
    cons = C.declared_constraints(spark, CONS[:2])
    v = {r["constraint_name"]: r["orphans"] for r in C.fk_violations(spark, frames, cons).collect()}
    assert v == {"emp_mgr_fk": 1}
    stats = {r["column"]: r["is_candidate"] for r in K.pk_candidates(K.column_stats(frames)).collect()}
    assert stats == {"id": True, "manager_id": False}


def test_distinct_profile_limit_and_order(spark):
    df = spark.createDataFrame([(i % 13, None if i % 5 == 0 else f"v{i % 4}") for i in range(40)], "a int, b string")
    prof = {r["column"]: r["distinct_values"] for r in C.distinct_profile({"t": df}, n=10).collect()}
    assert prof["a"] == sorted({str(i % 13) for i in range(40)})[:10]
    assert prof["b"] == ["v0", "v1", "v2", "v3"]


def test_fk_discovery_dense_and_sparse_keys(spark):
    parent = spark.createDataFrame([(1,), (2,), (5,)], "pid int")           # sparse key
    dense = spark.createDataFrame([(i,) for i in range(10)], "did int")     # dense key
    child = spark.createDataFrame([(1, 3, 9), (5, 1, 0), (None, 2, 4)], "a int, b int, c int")
    frames = {"p": parent, "d": dense, "k": child}
    got = {(r["table"], r["column"], r["ref_table"], r["ref_column"])
           for r in K.inclusions(spark, frames).collect()}
    assert ("k", "a", "p", "pid") in got          # {1, 5} within {1, 2, 5}
    assert ("k", "b", "p", "pid") not in got      # 3 is missing from {1, 2, 5}
    assert {("k", "a", "d", "did"), ("k", "b", "d", "did"), ("k", "c", "d", "did"), ("p", "pid", "d", "did")} <= got


def test_fixed_size_sample_and_profile(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = C.fixed_size_sample(df, 100, ["o_orderkey"])
    b = C.fixed_size_sample(df.repartition(5), 100, ["o_orderkey"])
    ka = sorted(r["o_orderkey"] for r in a.collect())
    assert len(ka) == 100 and ka == sorted(r["o_orderkey"] for r in b.collect())   # exact size, repeatable
    rows = a.collect()
    prof = {r["column"]: r["distinct_values"] for r in C.distinct_profile({"o": a}).collect()}
    for col in ("o_orderstatus", "o_orderpriority", "o_custkey"):
        want = sorted({str(r[col]) for r in rows if r[col] is not None})[:10]
        assert prof[col] == want


def test_profile_holds_a_few_values_per_partition(spark):
    """The smallest distinct values come from every partition's own smallest: no row of a frequent value is sorted or ranked."""
    rows = [(i, "yes" if i % 2 else "no", f"é{i % 30}" if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, flag string, name string").repartition(3)
    got = {r["column"]: r["distinct_values"] for r in C.distinct_profile({"t": df}, 4).collect()}
    assert got == {"id": ["0", "1", "10", "100"], "flag": ["no", "yes"], "name": ["é1", "é10", "é11", "é13"]}
    few = df.select("flag").mapInArrow(C._smallest(4), "column string, value string")
    assert few.count() <= 3 * 2
    assert C.distinct_profile({"t": df.where("id < 0")}, 4).count() == 0
