"""B-queries: catalog extraction, profiling and key discovery over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import models
from tessera.operators import catalog as C
from tessera.operators import enrich as N
from tessera.operators import keys as K
from tessera.operators.catalog_store import Catalog
from tessera.plans.registry import query
from tessera.schemas import (CONSTRAINT_COLS, DECLARED_CONSTRAINTS, TABLE_COLUMNS,
                             values_sql)
from tessera.sources.tables import TABLES, load_tables, read_table

PROFILED = ("part", "orders", "events")
INTEGRAL_TYPES = ("int", "bigint")
KEYABLE_TYPES = ("int", "bigint", "string")


def _paths(sf) -> dict[str, str]:
    return {t: f"{sf.rstrip('/')}/{t}.parquet" for t in TABLES}


def the_catalog(spark, sf) -> Catalog:
    return Catalog(spark, _paths(sf))


def catalog_parts(spark, sf):
    """Frames, schema and verified constraints; the constraints come from the stored catalog of these files."""
    cat = the_catalog(spark, sf)
    return cat.frames, cat.schema, cat.constraints()


def _join_arr(c, sep=","):
    return F.array_join(c, sep)


# --------------------------------------------------------------- oracles ---

TYPE_CASE = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"""

TABLE_LIST = ", ".join(f"'{t}'" for t in TABLES)

SCHEMA_SQL = f"""SELECT DISTINCT table_name AS tbl, column_name AS name, ordinal_position AS position,
  {TYPE_CASE} AS data_type, is_nullable = 'YES' AS nullable
FROM information_schema.columns WHERE table_name IN ({TABLE_LIST})"""


def _fk_orphan_sql() -> str:
    parts = []
    for (t, cname, kind, _o, col, rt, rc) in DECLARED_CONSTRAINTS:
        if kind != "fk":
            continue
        parts.append(f"SELECT '{cname}' AS constraint_name WHERE EXISTS (SELECT 1 FROM {t} "
                     f"WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {rc} FROM {rt} WHERE {rc} IS NOT NULL))")
    return "\nUNION ALL ".join(parts)


def _pk_broken_sql() -> str:
    keys: dict[tuple, list[str]] = {}
    for (t, cname, kind, _o, col, _rt, _rc) in DECLARED_CONSTRAINTS:
        if kind == "pk":
            keys.setdefault((t, cname), []).append(col)
    return "\nUNION ALL ".join(
        f"SELECT '{cname}' WHERE (SELECT count(*) FROM {t}) <> (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {t} "
        f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)}))" for (t, cname), cols in keys.items())


VERIFIED_SQL = f"""SELECT * FROM {values_sql(DECLARED_CONSTRAINTS, CONSTRAINT_COLS)}
WHERE constraint_name NOT IN ({_fk_orphan_sql()}
UNION ALL {_pk_broken_sql()})"""

COUNTS_SQL = "\nUNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS row_count FROM {t}" for t in TABLES)


# ---------------------------------------------------------------- queries --

@query("catalog_columns", ids="B1 B2 B3 B16", oracle=f"""
WITH s AS ({SCHEMA_SQL}), c AS ({VERIFIED_SQL})
SELECT s.tbl AS table_name, s.name AS column_name, s.position, s.data_type, s.nullable,
  EXISTS (SELECT 1 FROM c WHERE c.tbl = s.tbl AND c.col = s.name AND c.kind = 'pk') AS is_primary_key,
  EXISTS (SELECT 1 FROM c WHERE c.tbl = s.tbl AND c.col = s.name AND c.kind = 'fk') AS is_foreign_key
FROM s""")
def catalog_columns(spark, sf):
    _, schema_df, cons = catalog_parts(spark, sf)
    return C.key_flags(schema_df, cons).select(
        F.col("table").alias("table_name"), F.col("name").alias("column_name"), "position",
        "data_type", "nullable", "is_primary_key", "is_foreign_key")


@query("catalog_row_counts", ids="B7", oracle=f"SELECT tbl AS table_name, row_count FROM ({COUNTS_SQL})")
def catalog_row_counts(spark, sf):
    return C.row_counts(load_tables(spark, sf)).select(F.col("table").alias("table_name"), "row_count")


@query("catalog_tables_base", ids="B4 B5 B6 B15 B17", oracle=f"""
WITH s AS ({SCHEMA_SQL}), c AS ({VERIFIED_SQL}), n AS ({COUNTS_SQL}),
cols AS (SELECT tbl, string_agg(name, ',' ORDER BY position) AS columns FROM s GROUP BY tbl),
pk AS (SELECT tbl, string_agg(col, ',' ORDER BY ordinal) AS primary_keys FROM c WHERE kind = 'pk' GROUP BY tbl),
fk1 AS (SELECT tbl, constraint_name,
          string_agg(col, ',' ORDER BY ordinal) || '->' || min(ref_table) || '('
          || string_agg(ref_column, ',' ORDER BY ordinal) || ')' AS fk
        FROM c WHERE kind = 'fk' AND ref_table IN (SELECT tbl FROM s) GROUP BY tbl, constraint_name),
fk AS (SELECT tbl, string_agg(fk, ';' ORDER BY constraint_name) AS foreign_keys FROM fk1 GROUP BY tbl)
SELECT cols.tbl AS name, columns, coalesce(primary_keys, '') AS primary_keys,
       coalesce(foreign_keys, '') AS foreign_keys, coalesce(row_count, 0) AS row_count
FROM cols LEFT JOIN pk USING (tbl) LEFT JOIN fk USING (tbl) LEFT JOIN n USING (tbl)""")
def catalog_tables_base(spark, sf):
    base = the_catalog(spark, sf).tables()
    fk_text = F.array_join(F.transform("foreign_keys", lambda f: F.concat(
        F.array_join(f["constrained_columns"], ","), F.lit("->"), f["referred_table"], F.lit("("),
        F.array_join(f["referred_columns"], ","), F.lit(")"))), ";")
    return base.select("name", _join_arr(F.col("columns")).alias("columns"),
                       _join_arr(F.col("primary_keys")).alias("primary_keys"),
                       fk_text.alias("foreign_keys"), "row_count")


SAMPLED = {"part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def _profile_sql(tables, sep: str = "|", sample: int | None = None) -> str:
    parts = []
    for t in tables:
        rows = f"(SELECT * FROM {t} ORDER BY md5('42:' || {SAMPLED[t]}), {SAMPLED[t]} LIMIT {sample})" if sample else t
        for c, ty in TABLE_COLUMNS[t]:
            if ty.startswith("array"):
                continue
            parts.append(f"SELECT DISTINCT '{t}' AS tbl, '{c}' AS col, CAST({c} AS VARCHAR) AS v "
                         f"FROM {rows} WHERE {c} IS NOT NULL")
    u = "\n  UNION ALL ".join(parts)
    return f"""WITH u AS ({u}),
r AS (SELECT *, row_number() OVER (PARTITION BY tbl, col ORDER BY v) AS rn FROM u)
SELECT tbl AS table_name, col AS column_name, string_agg(v, '{sep}' ORDER BY v) AS distinct_values
FROM r WHERE rn <= 10 GROUP BY tbl, col"""


@query("profile_distinct_values", ids="B10", oracle=_profile_sql(PROFILED))
def profile_distinct_values(spark, sf):
    frames = load_tables(spark, sf, PROFILED)
    return C.distinct_profile(frames).select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"),
        F.array_join("distinct_values", "|").alias("distinct_values"))


@query("profile_sampled_distinct", ids="B11 B12 J18", oracle=_profile_sql(PROFILED, sample=1000))
def profile_sampled_distinct(spark, sf):
    """Distinct values over a repeatable 1,000-row sample of each table."""
    frames = load_tables(spark, sf, PROFILED)
    sampled = {t: C.fixed_size_sample(df, 1000, [SAMPLED[t]]) for t, df in frames.items()}
    return C.distinct_profile(sampled).select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"),
        F.array_join("distinct_values", "|").alias("distinct_values"))


@query("sample_head", ids="B9 E27", oracle="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 3""")
def sample_head(spark, sf):
    return C.head_sample(read_table(spark, sf, "orders"), 3, ["o_orderkey"])


def _pk_sql() -> str:
    parts = []
    for t in TABLES:
        for c, ty in TABLE_COLUMNS[t]:
            if ty not in KEYABLE_TYPES:
                continue
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, "
                         f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS n_distinct FROM {t}")
    u = "\nUNION ALL ".join(parts)
    return f"""SELECT *, row_count > 0 AND null_count = 0 AND n_distinct = row_count AS is_candidate
FROM ({u})"""


@query("key_discovery_pk", ids="B19", oracle=_pk_sql())
def key_discovery_pk(spark, sf):
    stats = K.pk_candidates(K.column_stats(load_tables(spark, sf)))
    return stats.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"),
                        "row_count", "null_count", "n_distinct", "is_candidate")


def _fk_sql() -> str:
    cols = [(t, c) for t in TABLES for c, ty in TABLE_COLUMNS[t] if ty in INTEGRAL_TYPES]
    parts = []
    for (ct, cc) in cols:
        for (pt, pc) in cols:
            if (ct, cc) == (pt, pc):
                continue
            parts.append(
                f"SELECT '{ct}' AS table_name, '{cc}' AS column_name, '{pt}' AS ref_table, '{pc}' AS ref_column "
                f"WHERE (SELECT count(*) > 0 AND count({pc}) = count(*) AND count(DISTINCT {pc}) = count(*) FROM {pt}) "
                f"AND (SELECT count({cc}) > 0 FROM {ct}) "
                f"AND NOT EXISTS (SELECT 1 FROM {ct} WHERE {cc} IS NOT NULL AND {cc} NOT IN "
                f"(SELECT {pc} FROM {pt}))")
    return "\nUNION ALL ".join(parts)


@query("key_discovery_fk", ids="B19", oracle=_fk_sql())
def key_discovery_fk(spark, sf):
    fk = K.inclusions(spark, load_tables(spark, sf))
    return fk.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"),
                     "ref_table", "ref_column")


def _composite_sql(max_size: int = 3) -> str:
    from itertools import combinations

    parts = []
    for t in TABLES:
        cols = [c for c, ty in TABLE_COLUMNS[t] if ty in KEYABLE_TYPES]
        for size in range(1, max_size + 1):
            for some in combinations(cols, size):
                known = " AND ".join(f"{c} IS NOT NULL" for c in some)
                parts.append(f"SELECT '{t}' AS table_name, [{', '.join(repr(c) for c in some)}] AS c, (SELECT count(*) FROM {t}) AS row_count, "
                             f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(some)} FROM {t} WHERE {known})) AS n")
    u = "\nUNION ALL ".join(parts)
    return f"""WITH u AS ({u}), k AS (SELECT * FROM u WHERE row_count > 0 AND n = row_count)
SELECT table_name, array_to_string(c, ',') AS columns, row_count FROM k
WHERE len(c) > 1 AND NOT EXISTS (SELECT 1 FROM k s WHERE s.table_name = k.table_name AND len(s.c) < len(k.c) AND list_has_all(k.c, s.c))"""


@query("key_discovery_composite", ids="B19", oracle=_composite_sql())
def key_discovery_composite(spark, sf):
    """Minimal keys of two or three columns of every table."""
    return K.composite_keys(spark, load_tables(spark, sf)).select(
        F.col("table").alias("table_name"), F.array_join("columns", ",").alias("columns"), "row_count")


@query("statistics_row_counts", ids="B8", oracle=f"SELECT tbl AS table_name, row_count, false AS stale FROM ({COUNTS_SQL})")
def statistics_row_counts(spark, sf):
    """Row counts from stored statistics: measured from footers, kept with the file listing, read back."""
    import uuid

    from tessera.session import checkpoint_dir
    from tessera.sources.statistics import StatisticsStore

    store = StatisticsStore(spark, f"{checkpoint_dir(spark)}/statistics/{uuid.uuid4().hex}")
    store.refresh(_paths(sf))
    return store.read(_paths(sf)).select(F.col("table").alias("table_name"), "row_count", "stale")


def _ranges_sql() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"CAST(min({c}) AS BIGINT) AS lo, CAST(max({c}) AS BIGINT) AS hi FROM {t}"
        for t in TABLES for c, ty in TABLE_COLUMNS[t] if ty in INTEGRAL_TYPES)


@query("statistics_column_ranges", ids="B8", oracle=_ranges_sql())
def statistics_column_ranges(spark, sf):
    """Row and null counts and ranges of all integral columns, from footers alone."""
    from tessera.sources.statistics import footer_column_ranges

    return footer_column_ranges(spark, _paths(sf)).select(
        F.col("table").alias("table_name"), F.col("column").alias("column_name"), "row_count", "null_count", "lo", "hi")


@query("relationships_bidirectional", ids="B5 B6 B13 B14", oracle=f"""
WITH c AS ({VERIFIED_SQL}),
fk AS (SELECT tbl, constraint_name, min(ref_table) AS ref_table,
              string_agg(col, ',' ORDER BY ordinal) AS cols,
              string_agg(ref_column, ',' ORDER BY ordinal) AS ref_cols
       FROM c WHERE kind = 'fk' GROUP BY tbl, constraint_name)
SELECT tbl AS table_name, ref_table AS related_table, 'outgoing' AS direction, constraint_name,
       cols AS local_columns, ref_cols AS remote_columns FROM fk
UNION ALL
SELECT ref_table, tbl, 'incoming', constraint_name, ref_cols, cols FROM fk""")
def relationships_bidirectional(spark, sf):
    frames, schema_df, cons = catalog_parts(spark, sf)
    rel = C.relationships(cons, C.list_tables(schema_df))
    return rel.select(F.col("table").alias("table_name"), "related_table", "direction", "constraint_name",
                      F.array_join("local_columns", ",").alias("local_columns"),
                      F.array_join("remote_columns", ",").alias("remote_columns"))


@query("column_key_flags", ids="B16 G18", oracle=f"""
WITH s AS ({SCHEMA_SQL}), c AS ({VERIFIED_SQL}),
f AS (SELECT s.tbl, s.name, s.nullable,
  EXISTS (SELECT 1 FROM c WHERE c.tbl = s.tbl AND c.col = s.name AND c.kind = 'pk') AS pk,
  EXISTS (SELECT 1 FROM c WHERE c.tbl = s.tbl AND c.col = s.name AND c.kind = 'fk') AS fk FROM s)
SELECT tbl AS table_name, name AS column_name,
  concat_ws(',', CASE WHEN pk THEN 'PK' END, CASE WHEN fk THEN 'FK' END,
            CASE WHEN NOT nullable THEN 'Required' END) AS badges
FROM f""")
def column_key_flags(spark, sf):
    from tessera.operators.graph import column_badges
    _, schema_df, cons = catalog_parts(spark, sf)
    flags = C.key_flags(schema_df, cons)
    return flags.select(F.col("table").alias("table_name"), F.col("name").alias("column_name"),
                        F.array_join(column_badges(), ",").alias("badges"))


@query("snapshot_roundtrip", ids="A7 A8 A9 B17 B18 G19", oracle=f"""
WITH s AS ({SCHEMA_SQL}), c AS ({VERIFIED_SQL}), n AS ({COUNTS_SQL})
SELECT s.tbl AS name, n.row_count, count(*) AS n_columns, count(*) AS n_described,
  (SELECT count(DISTINCT constraint_name) FROM c WHERE c.tbl = s.tbl AND c.kind = 'fk') AS n_fk,
  CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.tbl = s.tbl AND c.kind = 'fk') THEN CAST(round(least(1.0,
    0.2 * (SELECT count(DISTINCT constraint_name) FROM c WHERE c.tbl = s.tbl AND c.kind = 'fk') + 0.1 * count(*)
    + CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.tbl = s.tbl AND c.kind = 'pk') THEN 0.3 ELSE 0 END), 2) AS DOUBLE) ELSE 0.0 END AS importance_score
FROM s JOIN n ON n.tbl = s.tbl GROUP BY s.tbl, n.row_count""")
def snapshot_roundtrip(spark, sf):
    """Extract and enrich the catalog, save it as a snapshot, invalidate, re-extract, and read it back with a TTL."""
    import uuid

    from tessera.session import checkpoint_dir
    from tessera.sources import snapshot as S

    path = f"{checkpoint_dir(spark)}/snapshots/{uuid.uuid4().hex}"

    def extract():
        cat = the_catalog(spark, sf)
        cons, tabs = cat.constraints(), C.list_tables(cat.schema)
        return {"tables": cat.enriched_tables(models.describe, "describe"),
                "columns": cat.enriched_columns(models.describe, "describe"),
                "queries": spark.createDataFrame([], "question string, sql_query string, explanation string, "
                                                     "positive_votes int"),
                "relationships": C.relationships(cons, tabs)}

    S.load_or_extract(spark, path, extract)          # miss -> extract and save
    S.invalidate(spark, path)                        # next read misses
    assert S.read_snapshot(spark, path) is None
    snap = S.load_or_extract(spark, path, extract)   # re-extract after invalidation
    described = snap["columns"].groupBy(F.col("table").alias("name")).agg(F.count_if(F.col("description") != N.NO_DESCRIPTION).alias("n_described"))
    t = snap["tables"].join(described, "name")
    return t.select("name", "row_count", F.size("columns").cast("bigint").alias("n_columns"),
                    F.size("foreign_keys").cast("bigint").alias("n_fk"), "importance_score", "n_described")
