"""F-queries: question keywords (words of part names, market segments, regions) against column values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import match as M
from tessera.plans.registry import query
from tessera.schemas import TABLE_COLUMNS
from tessera.sources.tables import TABLES, load_tables

SOURCES = [("part", "p_name"), ("customer", "c_mktsegment"), ("region", "r_name")]


def _inputs(spark, sf):
    frames = load_tables(spark, sf)
    return M.question_keywords(frames, SOURCES), M.value_dictionary(frames)


def _values_sql() -> str:
    parts = [f"SELECT '{t}' AS tbl, '{c}' AS col, regexp_replace(lower({c}), '[[:punct:] ]', '', 'g') AS v FROM {t} "
             f"WHERE {c} IS NOT NULL" for t in TABLES for c, ty in TABLE_COLUMNS[t] if ty == "string"]
    return "\nUNION ALL ".join(parts)


KW_SQL = f"""
kw AS (SELECT DISTINCT keyword, regexp_replace(keyword, '[[:punct:] ]', '', 'g') AS k FROM (
         SELECT unnest(regexp_split_to_array(lower(p_name), ' +')) AS keyword FROM part
         UNION ALL SELECT unnest(regexp_split_to_array(lower(c_mktsegment), ' +')) FROM customer
         UNION ALL SELECT unnest(regexp_split_to_array(lower(r_name), ' +')) FROM region) WHERE keyword <> ''),
vals AS (SELECT DISTINCT tbl, col, v FROM ({_values_sql()}) WHERE v <> '')"""


@query("value_match_substring", ids="F1 F2 F3 F5", oracle=f"""WITH {KW_SQL}
SELECT keyword, tbl AS table_name, col AS column_name, count(*) AS n_values
FROM kw JOIN vals ON contains(v, k) WHERE k <> '' GROUP BY keyword, tbl, col""")
def value_match_substring(spark, sf):
    """Exact substring branch: per keyword and column, the number of distinct values containing it."""
    kw, vals = _inputs(spark, sf)
    hits = M.substring_matches(kw, vals)
    return hits.groupBy("keyword", F.col("table").alias("table_name"), F.col("column").alias("column_name")) \
        .agg(F.count(F.lit(1)).alias("n_values"))


@query("value_match", ids="F3 F4")
def value_match(spark, sf):
    """Best 5 columns per keyword (substring = 1.0, else ratio >= 0.8); rows-only check for the ratio part."""
    kw, vals = _inputs(spark, sf)
    best = M.best_columns(kw, vals)
    return best.select("keyword", F.col("table").alias("table_name"), F.col("column").alias("column_name"),
                       F.round("score", 6).alias("score"), "rank")
