"""I-queries: scalar text functions over whole text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.registry import query
from tessera.session import spread
from tessera.sources.tables import read_table

# regex classes as DuckDB (RE2) literals, same meaning as tessera.functions.text
WS = r"[\t\n\x0B\f\r ]"
NW = r"[^A-Za-z0-9_]"


def _duck_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _duck_capitalize(c: str) -> str:
    x = c
    for ch in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '(^|\\.{WS}+){ch}', '\\1{ch.upper()}', 'g')"
    return x


def _duck_format_sql(c: str) -> str:
    x = f"regexp_replace({c}, '{WS}+', ' ', 'g')"
    x = f"regexp_replace({x}, '{WS}*(,){WS}*', '\\1 ', 'g')"
    x = f"regexp_replace({x}, '{WS}*(=){WS}*', ' \\1 ', 'g')"
    return f"trim({x})"


def _duck_layout(c: str) -> str:
    x = f"regexp_replace({_duck_strip(c)}, '{WS}+', ' ', 'g')"
    for kw in X.LAYOUT_KEYWORDS:
        x = f"regexp_replace({x}, '(^|{NW}){kw}({NW}|$)', '\\1' || chr(10) || '{kw}\\2', 'gi')"
    return (f"array_to_string(list_transform(string_split({x}, chr(10)), lambda ln, i: "
            f"CASE WHEN i = 1 THEN trim(ln) ELSE '    ' || trim(ln) END), chr(10))")


@query("text_stats", ids="I8", oracle=f"""
SELECT doc_id, length(text) AS characters,
  len(regexp_split_to_array({_duck_strip('text')}, '{WS}+')) AS words,
  len(string_split(text, chr(10))) AS lines,
  len(string_split(text, ' ')) - 1 AS spaces,
  length(regexp_replace(text, '{WS}', '', 'g')) AS characters_no_ws
FROM documents""")
def text_stats(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    stats = X.text_stats("text")
    return docs.select("doc_id", *[v.cast("bigint").alias(k) for k, v in stats.items()])


@query("text_tests", ids="I1 I2 I3 I4", oracle=f"""
SELECT doc_id,
  coalesce({_duck_strip('text')}, '') = '' AS is_blank,
  length(text) > 10000 AS over_max,
  regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') AS has_control,
  regexp_matches(text, '(?i)(^|{NW})(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN)({NW}|$)') AS looks_like_sql
FROM documents""")
def text_tests(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", X.is_blank("text").alias("is_blank"),
                       X.over_max_length("text", 10000).alias("over_max"),
                       X.has_control_chars("text").alias("has_control"),
                       X.looks_like_sql("text").alias("looks_like_sql"))


@query("text_normalise", ids="I5 I6 I7 I9", oracle=f"""
SELECT conv_id, turn,
  md5(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) AS normalized_md5,
  md5({_duck_capitalize('text')}) AS capitalized_md5,
  md5({_duck_format_sql('text')}) AS sql_spaced_md5,
  array_to_string(list_transform(string_split(role || '_turn', '_'),
     lambda w: upper(w[1]) || lower(w[2:])), ' ') AS header
FROM conversations""")
def text_normalise(spark, sf):
    conv = spread(read_table(spark, sf, "conversations"))
    return conv.select("conv_id", "turn",
                       F.md5(X.normalize_spaces("text")).alias("normalized_md5"),
                       F.md5(X.capitalize_sentences("text")).alias("capitalized_md5"),
                       F.md5(X.format_as_sql("text")).alias("sql_spaced_md5"),
                       X.header_title(F.concat("role", F.lit("_turn"))).alias("header"))


@query("text_display", ids="I10 I12 I13", oracle="""
SELECT event_id,
  CASE WHEN props IS NULL THEN 'NULL' WHEN length(props) > 100 THEN substr(props, 1, 100) || '...'
       ELSE props END AS props_display,
  CASE WHEN value IS NULL THEN 'NULL' ELSE CAST(value AS VARCHAR) END AS value_display,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END
    AS ts_iso,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events""")
def text_display(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select("event_id", X.display_value("props").alias("props_display"),
                     X.display_value("value").alias("value_display"),
                     X.iso_timestamp("ts").alias("ts_iso"),
                     F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def query_log(spark, sf):
    """The feedback log's SQL texts: one generated statement per event, with uneven layout."""
    ev = read_table(spark, sf, "events")
    sql = F.concat(F.lit("select  count(*) as n,sum(value)  from events\n where user_id="),
                   F.col("user_id").cast("string"), F.lit(" and event_type =  '"),
                   F.col("event_type"), F.lit("'  group by user_id order by 1"))
    return ev.select("event_id", sql.alias("sql_text"))


@query("sql_layout", ids="I7 I11", oracle=f"""
WITH log AS (
  SELECT event_id, 'select  count(*) as n,sum(value)  from events' || chr(10) || ' where user_id='
    || CAST(user_id AS VARCHAR) || ' and event_type =  ''' || event_type || '''  group by user_id order by 1' AS sql_text
  FROM events),
canon AS (SELECT {_duck_layout(_duck_format_sql('sql_text'))} AS layout FROM log)
SELECT layout, count(*) AS n_statements FROM canon GROUP BY layout""")
def sql_layout(spark, sf):
    """Canonicalise the query log (spacing + layout) and count statements per canonical text."""
    log = spread(query_log(spark, sf))
    canon = log.select(X.sql_layout(X.format_as_sql("sql_text")).alias("layout"))
    return canon.groupBy("layout").agg(F.count(F.lit(1)).alias("n_statements"))
