"""Discovery of keys and references from the data.

Every value is read once, as a number or as two 64-bit digests of its text (one of 128 bits would serve as well: texts
themselves are never shuffled), and all columns of all tables go through the same distinct:

* single keys: distinct values per column against the row count;
* references: per value the set of columns that hold it, as bit masks; a column is contained in exactly the columns that
  every one of its values lists, so one ``bit_and`` per column yields all inclusions at once;
* composite keys: level by level, a combination is looked at only if no part of it is a key and its columns have
  enough distinct values together. A share of the combined values (all rows of each) refutes most of them; only the
  survivors are verified in full.

The number of columns and combinations is catalog metadata; nothing that grows with the rows passes the driver.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
KEYABLE = (*INTEGRAL, T.StringType)
#: columns whose bits share one 64-bit mask
WORD = 63
#: one in so many combined values is looked at before a combination is verified in full
REFUTE = 64


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _columns(frames: dict[str, DataFrame], types: tuple) -> list[tuple[str, T.StructField]]:
    return [(t, f) for t, df in frames.items() for f in df.schema.fields if isinstance(f.dataType, types)]


def _digest(field: T.StructField) -> tuple[Column, Column]:
    """A value as two numbers: itself, or two hashes of its text."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, INTEGRAL):
        return c.cast("bigint"), F.lit(0).cast("bigint")
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def _values(frames: dict[str, DataFrame], columns: list[tuple[str, T.StructField]]) -> DataFrame:
    """(id, a, b): the non-null values of every column, by the column's place in ``columns``."""
    out = []
    for t, df in frames.items():
        mine = [(i, f) for i, (u, f) in enumerate(columns) if u == t]
        if not mine:
            continue
        # digests first, so that what is multiplied by the columns is numbers only
        narrow = df.select(*[x for i, f in mine for x in (
            F.col(f"`{f.name}`").isNotNull().alias(f"k{i}"), _digest(f)[0].alias(f"a{i}"), _digest(f)[1].alias(f"b{i}"))])
        each = F.array(*[F.when(F.col(f"k{i}"), F.struct(F.lit(i).alias("id"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"))) for i, _ in mine])
        out.append(narrow.select(F.explode(each).alias("v")).where(F.col("v").isNotNull()).select("v.*"))
    return _union(out)


def _row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    return _union([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table"), "row_count") for t, df in frames.items()])


def _names(spark: SparkSession, columns: list[tuple[str, T.StructField]]) -> DataFrame:
    rows = [(i, t, f.name, isinstance(f.dataType, INTEGRAL)) for i, (t, f) in enumerate(columns)]
    return spark.createDataFrame(rows, "id int, table string, column string, integral boolean")


def column_stats(frames: dict[str, DataFrame], types: tuple = KEYABLE) -> DataFrame:
    """Row, null and distinct counts (+ range of numbers) of every column of ``types``: one pass over all values."""
    columns = _columns(frames, types)
    spark = next(iter(frames.values())).sparkSession
    zero = F.lit(0).cast("bigint")
    values = _values(frames, columns).groupBy("id", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    per = values.groupBy("id").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    known = _names(spark, columns).join(_row_counts(frames), "table").join(per, "id", "left")
    number = lambda c: F.when(F.col("integral"), F.col(c)).alias(c)
    return known.select("table", "column", "row_count", "integral", (F.col("row_count") - F.coalesce("n", zero)).alias("null_count"),
                        F.coalesce("n_distinct", zero).alias("n_distinct"), number("lo"), number("hi"))


def pk_candidates(stats: DataFrame) -> DataFrame:
    """Candidate key: non-empty, no null, as many distinct values as rows."""
    return stats.withColumn("is_candidate", (F.col("row_count") > 0) & (F.col("null_count") == 0)
                            & (F.col("n_distinct") == F.col("row_count")))


def _bits(word: Column, base: int) -> Column:
    """Numbers of the bits that are set, from ``base`` on."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(word, b) == 1), lambda b: b + base)


def inclusions(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """(table, column, ref_table, ref_column): integral columns whose values all occur in a candidate key of another column."""
    columns = _columns(frames, INTEGRAL)
    words = range(-(-len(columns) // WORD))
    mask = [F.bit_or(F.when(F.floor(F.col("id") / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("id") % WORD))
                     .otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in words]
    held = _values(frames, columns).groupBy("a").agg(*mask)
    whose = F.flatten(F.array(*[_bits(F.col(f"w{w}"), w * WORD) for w in words]))
    each = held.select(F.explode(whose).alias("id"), *[f"w{w}" for w in words])
    inside = each.groupBy("id").agg(F.count(F.lit(1)).alias("n_distinct"), *[F.bit_and(f"w{w}").alias(f"w{w}") for w in words])
    pairs = inside.select("id", F.explode(whose).alias("ref")).where("id <> ref")
    names = _names(spark, columns)
    # as many distinct values as rows: none is null
    key = (names.join(_row_counts(frames), "table").join(inside.select("id", "n_distinct"), "id").where("n_distinct = row_count")
           .select(F.col("id").alias("ref"), F.col("table").alias("ref_table"), F.col("column").alias("ref_column")))
    return pairs.join(key, "ref").join(names, "id").select("table", "column", "ref_table", "ref_column")


def repeated(frames: dict[str, DataFrame], combos: list[tuple[str, tuple[str, ...]]], share: int) -> set[int]:
    """Numbers of the combinations some value of which occurs in two rows; of ``share`` values one is looked at."""
    out = []
    for t, df in frames.items():
        mine = [(i, cols) for i, (u, cols) in enumerate(combos) if u == t]
        if not mine:
            continue
        used = sorted({c for _, cols in mine for c in cols})
        narrow = df.select(*[x for j, c in enumerate(used) for x in (_digest(df.schema[c])[0].alias(f"a{j}"), _digest(df.schema[c])[1].alias(f"b{j}"))])
        both = lambda cols: [F.col(f"{s}{used.index(c)}") for c in cols for s in "ab"]
        each = F.array(*[F.struct(F.lit(i).alias("id"), F.xxhash64(*both(cols)).alias("a"), F.xxhash64(F.lit(1), *both(cols)).alias("b")) for i, cols in mine])
        rows = narrow.select(F.explode(each).alias("v")).select("v.*")
        out.append(rows.where(F.pmod(F.col("a"), F.lit(share)) == 0) if share > 1 else rows)
    twice = _union(out).groupBy("id", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id").distinct()
    return {r["id"] for r in twice.collect()}  # at most one row per combination


def composite_keys(spark: SparkSession, frames: dict[str, DataFrame], max_size: int = 3, types: tuple = KEYABLE) -> DataFrame:
    """(table, columns, row_count): minimal keys of two to ``max_size`` columns without nulls, no part of which is a key."""
    stats = [r.asDict() for r in pk_candidates(column_stats(frames, types)).collect()]  # one row per column
    rows = {r["table"]: r["row_count"] for r in stats}
    distinct = {(r["table"], r["column"]): r["n_distinct"] for r in stats}
    open_now: dict[str, set[tuple[str, ...]]] = {}
    for r in stats:
        if r["row_count"] > 0 and r["null_count"] == 0 and not r["is_candidate"]:
            open_now.setdefault(r["table"], set()).add((r["column"],))
    order = {t: [f.name for f in df.schema.fields] for t, df in frames.items()}
    found = []
    for size in range(2, max_size + 1):
        grown = {}
        for t, parts in open_now.items():
            cols = sorted({c for p in parts for c in p}, key=order[t].index)
            grown[t] = {c for c in combinations(cols, size) if all(p in parts for p in combinations(c, size - 1))}
        # too few values to tell all rows apart: no key, but part of larger combinations
        asked = [(t, c) for t, some in grown.items() for c in sorted(some) if prod(distinct[t, x] for x in c) >= rows[t]]
        for share in (REFUTE, 1):
            if asked:
                gone = repeated(frames, asked, share)
                asked = [x for i, x in enumerate(asked) if i not in gone]
        found += [(t, list(c), rows[t]) for t, c in asked]
        keys = set(asked)
        open_now = {t: {c for c in some if (t, c) not in keys} for t, some in grown.items()}
    return spark.createDataFrame(found, "table string, columns array<string>, row_count bigint")
