"""Record schemas (FIXTURES.md §2) and the driver tables' declared metadata."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and Spark types of the driver tables, in file order.
TABLE_COLUMNS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
               ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"),
                 ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"),
                 ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"),
                      ("text", "string")],
}

# Declared constraints of the driver tables (FIXTURES.md §3).
# (table, constraint_name, kind, ordinal, column, ref_table, ref_column)
DECLARED_CONSTRAINTS: list[tuple] = [
    ("region", "region_pk", "pk", 1, "r_regionkey", None, None),
    ("nation", "nation_pk", "pk", 1, "n_nationkey", None, None),
    ("customer", "customer_pk", "pk", 1, "c_custkey", None, None),
    ("supplier", "supplier_pk", "pk", 1, "s_suppkey", None, None),
    ("part", "part_pk", "pk", 1, "p_partkey", None, None),
    ("orders", "orders_pk", "pk", 1, "o_orderkey", None, None),
    ("events", "events_pk", "pk", 1, "event_id", None, None),
    ("documents", "documents_pk", "pk", 1, "doc_id", None, None),
    ("embeddings", "embeddings_pk", "pk", 1, "vec_id", None, None),
    ("pages", "pages_pk", "pk", 1, "page_id", None, None),
    ("benchmark", "benchmark_pk", "pk", 1, "item_id", None, None),
    ("labels", "labels_pk", "pk", 1, "doc_id", None, None),
    ("conversations", "conversations_pk", "pk", 1, "conv_id", None, None),
    ("conversations", "conversations_pk", "pk", 2, "turn", None, None),
    ("nation", "nation_region_fk", "fk", 1, "n_regionkey", "region", "r_regionkey"),
    ("customer", "customer_nation_fk", "fk", 1, "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "supplier_nation_fk", "fk", 1, "s_nationkey", "nation", "n_nationkey"),
    ("orders", "orders_customer_fk", "fk", 1, "o_custkey", "customer", "c_custkey"),
    ("lineitem", "lineitem_orders_fk", "fk", 1, "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "lineitem_part_fk", "fk", 1, "l_partkey", "part", "p_partkey"),
    ("lineitem", "lineitem_supplier_fk", "fk", 1, "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "labels_documents_fk", "fk", 1, "doc_id", "documents", "doc_id"),
]

CONSTRAINTS = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("constraint_name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("column", T.StringType()),
    T.StructField("ref_table", T.StringType()),
    T.StructField("ref_column", T.StringType()),
])

FK_STRUCT = T.StructType([
    T.StructField("constrained_columns", T.ArrayType(T.StringType())),
    T.StructField("referred_table", T.StringType()),
    T.StructField("referred_columns", T.ArrayType(T.StringType())),
])

SCHEMA_ROWS = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
])

QUERY_DOCS = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("sql_query", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("positive_votes", T.IntegerType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("type", T.StringType()),
])

VECTOR_INDEX = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("name", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("payload", T.StringType()),
])


def values_sql(rows: list[tuple], columns: list[str]) -> str:
    """Render literal rows as a DuckDB ``(VALUES ...) t(cols)`` relation."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    body = ",\n  ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES\n  {body}) AS t({', '.join(columns)})"


CONSTRAINT_COLS = ["tbl", "constraint_name", "kind", "ordinal", "col", "ref_table", "ref_column"]
