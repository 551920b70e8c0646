"""B: catalog extraction and profiling as DataFrame jobs.

The schema itself (table and column names, types) is metadata held by the
session catalog and is lifted into a DataFrame once; everything that reads
data (row counts, constraint checks, distinct values, key discovery) is one
unioned Spark job per concern, never one query per column.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.keys import repeated
from tessera.schemas import CONSTRAINTS, DECLARED_CONSTRAINTS, SCHEMA_ROWS

PROFILE_LIMIT = 10  # distinct values kept per column
INTEGRAL = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# ---------------------------------------------------------------- B1-B3 ----

def schema_frame(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(table, name, position, data_type, nullable) for every attached table."""
    rows = [(t, f.name, i + 1, f.dataType.simpleString(), f.nullable)
            for t, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, SCHEMA_ROWS)


def list_tables(schema_df: DataFrame) -> DataFrame:
    return schema_df.select(F.col("table").alias("name")).distinct()


def column_names(schema_df: DataFrame) -> DataFrame:
    """B2: ordered column-name list per table."""
    return (schema_df.groupBy("table")
            .agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("c"))
            .select("table", F.transform("c", lambda x: x["name"]).alias("columns")))


# ---------------------------------------------------------------- B4-B6 ----

def declared_constraints(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else DECLARED_CONSTRAINTS, CONSTRAINTS)


def _key_string(df: DataFrame, cols: list[str]) -> F.Column:
    return F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols])


def fk_violations(spark: SparkSession, frames: dict[str, DataFrame], constraints: DataFrame) -> DataFrame:
    """Count child key values absent from the parent, for every FK, in one job.

    Each side is reduced to its distinct keys first (partial aggregation map
    side), then one left-anti join over (constraint, key) finds orphans.
    """
    fks = (constraints.where(F.col("kind") == "fk")
           .groupBy("table", "constraint_name", "ref_table")
           .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column", "ref_column"))).alias("c"))
           .collect())  # catalog metadata: one row per declared FK
    if not fks:
        return spark.createDataFrame([], "constraint_name string, orphans bigint")
    # single-column integral keys join as bigint; composite or other keys as delimited text
    groups: dict[str, tuple[list, list]] = {"long": ([], []), "text": ([], [])}
    for r in fks:
        if r["table"] not in frames or r["ref_table"] not in frames:
            continue
        ccols = [x["column"] for x in r["c"]]
        pcols = [x["ref_column"] for x in r["c"]]
        cdf, pdf = frames[r["table"]], frames[r["ref_table"]]
        integral = (len(ccols) == 1 and isinstance(cdf.schema[ccols[0]].dataType, INTEGRAL)
                    and isinstance(pdf.schema[pcols[0]].dataType, INTEGRAL))
        kind = "long" if integral else "text"
        ck = F.col(ccols[0]).cast("bigint") if integral else _key_string(cdf, ccols)
        pk = F.col(pcols[0]).cast("bigint") if integral else _key_string(pdf, pcols)
        cond = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ccols])
        name = F.lit(r["constraint_name"]).alias("constraint_name")
        groups[kind][0].append(cdf.where(cond).select(name, ck.alias("k")))
        groups[kind][1].append(pdf.select(name, pk.alias("k")))
    names = spark.createDataFrame([(r["constraint_name"],) for r in fks], "constraint_name string")
    found = []
    for child, parent in groups.values():
        if child:
            found.append(_union(child).distinct()
                         .join(_union(parent).distinct(), ["constraint_name", "k"], "left_anti")
                         .groupBy("constraint_name").agg(F.count(F.lit(1)).alias("orphans")))
    if not found:
        return names.select("constraint_name", F.lit(0).cast("bigint").alias("orphans"))
    orphans = _union(found)
    return (names.join(orphans, "constraint_name", "left")
            .select("constraint_name", F.coalesce("orphans", F.lit(0)).alias("orphans")))


def pk_violations(spark: SparkSession, frames: dict[str, DataFrame], constraints: DataFrame) -> DataFrame:
    """(constraint_name) of the declared keys that two rows share, or that are null somewhere; one job for all tables."""
    pks = [r for r in (constraints.where(F.col("kind") == "pk").groupBy("table", "constraint_name")
                       .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("c")).collect()) if r["table"] in frames]
    if not pks:
        return spark.createDataFrame([], "constraint_name string")
    combos = [(r["table"], tuple(x["column"] for x in r["c"])) for r in pks]
    bad = repeated(frames, combos, 1)
    null = [frames[t].agg(F.max(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])).alias("bad")).select(F.lit(i).alias("i"), "bad")
            for i, (t, cols) in enumerate(combos)]
    bad |= {r["i"] for r in _union(null).where("bad").collect()}
    return spark.createDataFrame([(pks[i]["constraint_name"],) for i in sorted(bad)], "constraint_name string")


def verified_constraints(spark: SparkSession, frames: dict[str, DataFrame],
                         constraints: DataFrame) -> DataFrame:
    """Declared constraints that hold on the data: references without orphans, keys without nulls and repeats."""
    bad = fk_violations(spark, frames, constraints).where(F.col("orphans") > 0).select("constraint_name")
    bad = bad.unionByName(pk_violations(spark, frames, constraints))
    return constraints.join(bad, "constraint_name", "left_anti").select(*CONSTRAINTS.fieldNames())


def primary_keys(constraints: DataFrame) -> DataFrame:
    """(table, primary_keys) ordered by ordinal."""
    return (constraints.where(F.col("kind") == "pk").groupBy("table")
            .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("c"))
            .select("table", F.transform("c", lambda x: x["column"]).alias("primary_keys")))


def fk_records(constraints: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """One row per FK: (table, constraint_name, constrained_columns, referred_table, referred_columns).

    Only references to available tables are kept (left semi join), columns
    paired by ordinal so composite keys never cross-multiply.
    """
    fk = constraints.where(F.col("kind") == "fk")
    if tables is not None:
        fk = fk.join(tables.select(F.col("name").alias("ref_table")), "ref_table", "left_semi")
    return (fk.groupBy("table", "constraint_name", "ref_table")
            .agg(F.array_sort(F.collect_list(F.struct("ordinal", "column", "ref_column"))).alias("c"))
            .select("table", "constraint_name",
                    F.transform("c", lambda x: x["column"]).alias("constrained_columns"),
                    F.col("ref_table").alias("referred_table"),
                    F.transform("c", lambda x: x["ref_column"]).alias("referred_columns")))


def foreign_keys(constraints: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(table, foreign_keys array<struct>) ordered by constraint name."""
    rec = fk_records(constraints, tables)
    return (rec.groupBy("table")
            .agg(F.array_sort(F.collect_list(F.struct(
                "constraint_name",
                F.struct("constrained_columns", "referred_table", "referred_columns").alias("fk")))).alias("l"))
            .select("table", F.transform("l", lambda x: x["fk"]).alias("foreign_keys")))


# ---------------------------------------------------------------- B7-B8 ----

def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Exact counts of all tables in one job (a union of global aggregates)."""
    return _union([df.agg(F.count(F.lit(1)).alias("row_count"))
                   .select(F.lit(t).alias("table"), "row_count") for t, df in frames.items()])


# ---------------------------------------------------------------- B9-B12 ---

def head_sample(df: DataFrame, n: int = 3, order_by: list[str] | None = None) -> DataFrame:
    """First n rows; ordered by the key so the sample is repeatable."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def fixed_size_sample(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (all, if fewer) chosen by the md5 of seed and key, which any engine can repeat.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each partition
    keeps its n best rows, so no task ever holds more than n rows per input split.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))
    return df.withColumn("_h", h).orderBy("_h", *key_cols).limit(n).drop("_h")


def _profile_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def _smallest(n: int):
    """(column, value): the ``n`` smallest distinct values of every text column of a partition, which is all that is held of it."""
    def run(batches):
        best: dict[str, pa.Array] = {}
        for batch in batches:
            for name, values in zip(batch.schema.names, batch.columns):
                kept = best.get(name)
                if kept is not None and len(kept) == n:
                    values = values.filter(pc.less(values, kept[n - 1]))
                new = values.drop_null().unique()
                if len(new):
                    new = new if kept is None else pa.concat_arrays([kept, new]).unique()
                    best[name] = new.take(pc.sort_indices(new)[:n])  # by the bytes of UTF-8, as Spark orders texts
        for name, kept in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(kept), pa.string()), kept.cast(pa.string())], names=["column", "value"])
    return run


def distinct_profile(frames: dict[str, DataFrame], n: int = PROFILE_LIMIT) -> DataFrame:
    """Per (table, column) the n smallest distinct non-null values, as text.

    One scan per table: every partition keeps the n smallest distinct values of each column while it reads, so nothing is sorted,
    and what is shuffled and ranked is n values per column and partition, however often a value occurs.
    """
    long = []
    for t, df in frames.items():
        cols = _profile_columns(df)
        if not cols:
            continue
        s = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
        u = s.mapInArrow(_smallest(n), "column string, value string")
        long.append(u.select(F.lit(t).alias("table"), "column", "value"))
    w = Window.partitionBy("table", "column").orderBy("value")
    top = _union(long).withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= n)
    return (top.groupBy("table", "column")
            .agg(F.array_sort(F.collect_set("value")).alias("distinct_values")))


# ---------------------------------------------------------------- B16 ------

def key_flags(schema_df: DataFrame, constraints: DataFrame) -> DataFrame:
    """is_primary_key / is_foreign_key per column from the constraints."""
    pk = (constraints.where(F.col("kind") == "pk")
          .select("table", F.col("column").alias("name")).distinct()
          .withColumn("is_primary_key", F.lit(True)))
    fk = (constraints.where(F.col("kind") == "fk")
          .select("table", F.col("column").alias("name")).distinct()
          .withColumn("is_foreign_key", F.lit(True)))
    return (schema_df.join(pk, ["table", "name"], "left").join(fk, ["table", "name"], "left")
            .withColumn("is_primary_key", F.coalesce("is_primary_key", F.lit(False)))
            .withColumn("is_foreign_key", F.coalesce("is_foreign_key", F.lit(False))))


# ---------------------------------------------------------------- B15/B17 --

def tables_base(schema_df: DataFrame, constraints: DataFrame, counts: DataFrame) -> DataFrame:
    """catalog_tables = names + ordered columns + PKs + FKs + row count."""
    cols = column_names(schema_df)
    pks = primary_keys(constraints)
    fks = foreign_keys(constraints, list_tables(schema_df))
    empty_fk = F.array().cast("array<struct<constrained_columns:array<string>,"
                              "referred_table:string,referred_columns:array<string>>>")
    return (cols.join(pks, "table", "left").join(fks, "table", "left").join(counts, "table", "left")
            .select(F.col("table").alias("name"), "columns",
                    F.coalesce("primary_keys", F.array().cast("array<string>")).alias("primary_keys"),
                    F.coalesce("foreign_keys", empty_fk).alias("foreign_keys"),
                    F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count")))


def catalog_columns(schema_df: DataFrame, constraints: DataFrame, profile: DataFrame) -> DataFrame:
    """B3 + B16: one record per column with key flags and sample values."""
    return (key_flags(schema_df, constraints)
            .join(profile.withColumnRenamed("column", "name"), ["table", "name"], "left")
            .withColumn("distinct_values",
                        F.coalesce("distinct_values", F.array().cast("array<string>"))))


# ---------------------------------------------------------------- B13/B14 --

def relationships(constraints: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Outgoing and incoming FK relations of every table.

    Grouping by (constraint, direction) and pairing columns by ordinal keeps a
    self-reference's two directions apart and never cross-multiplies a
    composite key.
    """
    rec = fk_records(constraints, tables)
    out = rec.select("table", F.col("referred_table").alias("related_table"),
                     F.lit("outgoing").alias("direction"), "constraint_name",
                     F.col("constrained_columns").alias("local_columns"),
                     F.col("referred_columns").alias("remote_columns"))
    inc = rec.select(F.col("referred_table").alias("table"), F.col("table").alias("related_table"),
                     F.lit("incoming").alias("direction"), "constraint_name",
                     F.col("referred_columns").alias("local_columns"),
                     F.col("constrained_columns").alias("remote_columns"))
    both = out.unionByName(inc)
    system = F.col("table").like("pg_%") | F.col("table").like("information_schema%")
    return both.where(~system)
