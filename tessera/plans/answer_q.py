"""E-queries: context, prompt, completion contract, parsing, execution, responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import header_title
from tessera.operators import answer as A
from tessera.operators import vectors as V
from tessera.plans.registry import query
from tessera.session import spread
from tessera.plans.vector_q import CENTROIDS_SQL, PAIRS_SQL, _docs, _self_questions, emb, \
    retrieve_tables_then_columns
from tessera.sources.tables import read_table, register_views

SCHEMA_NAME = "main"
# a custom template with an unknown placeholder that must survive substitution
TEMPLATE = A.DEFAULT_TEMPLATE + "\nKeep ${unknown} and $$ literal."


# ------------------------------------------------------------ retrieval ---

def retrieval_context(spark, sf):
    """Per question: rank-sorted arrays of retrieved tables, columns and similar queries."""
    q = _self_questions(spark, sf).drop("qlabel")
    cent = V.centroids(emb(spark, sf).select("label", F.col("embedding").alias("vector")), "label") \
        .select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("table"), "vector")
    cols = _docs(spark, sf).select("id", "vector",
                                   F.concat(F.lit("label_"), F.col("label").cast("string")).alias("table"))
    sizes = emb(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("table"), "n")
    colhits = retrieve_tables_then_columns(spark, q, cent, cols)
    tables = (colhits.select("question_id", "table", "table_rank").distinct().join(sizes, "table")
              .groupBy("question_id")
              .agg(F.array_sort(F.collect_list(F.struct(
                  "table_rank",
                  F.struct(F.col("table").alias("name"), F.array(F.lit("vec_id")).alias("primary_keys"),
                           F.concat(F.lit("Vectors labelled "), F.substring("table", 7, 10), F.lit(" ("),
                                    F.col("n").cast("string"), F.lit(" rows)")).alias("description"),
                           F.array(F.lit("vec_id"), F.lit("embedding"), F.lit("label")).alias("columns"))
                  .alias("t")))).alias("l"))
              .select("question_id", F.transform("l", lambda x: x["t"]).alias("tables")))
    columns = (colhits.groupBy("question_id")
               .agg(F.array_sort(F.collect_list(F.struct(
                   "table_rank", "rank",
                   F.struct("table", F.concat(F.lit("vec_"), F.col("id").cast("string")).alias("name"),
                            F.lit("array<float>").alias("data_type"), F.lit(False).alias("is_primary_key"),
                            F.lit(False).alias("is_foreign_key"), F.lit(True).alias("nullable"),
                            F.lit(None).cast("string").alias("description")).alias("c")))).alias("l"))
               .select("question_id", F.transform("l", lambda x: x["c"]).alias("columns")))
    qh = V.topk_cosine(_self_questions(spark, sf), _docs(spark, sf), 2, q_self="self_id")
    queries = (qh.groupBy("question_id")
               .agg(F.array_sort(F.collect_list(F.struct(
                   "rank",
                   F.struct(F.concat(F.lit("Which rows are like vec_"), F.col("id").cast("string"),
                                     F.lit("?")).alias("question"),
                            F.concat(F.lit("SELECT * FROM embeddings WHERE vec_id = "),
                                     F.col("id").cast("string")).alias("sql_query"),
                            F.lit(None).cast("string").alias("explanation")).alias("q")))).alias("l"))
               .select("question_id", F.transform("l", lambda x: x["q"]).alias("queries")))
    base = emb(spark, sf).select(F.col("vec_id").alias("question_id"))
    return (base.join(tables, "question_id", "left").join(columns, "question_id", "left")
            .join(queries, "question_id", "left"))


CONTEXT_SQL = f"""
WITH c AS ({CENTROIDS_SQL}),
sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
ts AS (SELECT e.vec_id AS question_id, c.label,
         list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c) AS sim FROM embeddings e, c),
tr AS (SELECT question_id, label, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, label) AS table_rank
       FROM ts),
top_t AS (SELECT * FROM tr WHERE table_rank <= 3),
p AS ({PAIRS_SQL}),
cr AS (SELECT t.question_id, t.label, t.table_rank, p.id,
         row_number() OVER (PARTITION BY t.question_id, t.label ORDER BY p.sim DESC, p.id) AS rank
       FROM top_t t JOIN p ON p.question_id = t.question_id AND p.dlabel = t.label),
cols AS (SELECT question_id, list('Column: label_' || label || '.vec_' || id || chr(10) || 'Type: array<float>'
                                   || chr(10) || 'Attributes: Nullable' ORDER BY table_rank, rank) AS l
         FROM cr WHERE rank <= 5 GROUP BY question_id),
tabs AS (SELECT t.question_id, list('Table: label_' || t.label || chr(10) || 'Primary Keys: vec_id' || chr(10)
                 || 'Description: Vectors labelled ' || t.label || ' (' || s.n || ' rows)' || chr(10)
                 || 'Columns: vec_id, embedding, label' ORDER BY t.table_rank) AS l
         FROM top_t t JOIN sizes s ON s.label = t.label GROUP BY t.question_id),
qr AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id) AS rank FROM p),
qs AS (SELECT question_id, list('Question: Which rows are like vec_' || id || '?' || chr(10)
                 || 'SQL: SELECT * FROM embeddings WHERE vec_id = ' || id ORDER BY rank) AS l
       FROM qr WHERE rank <= 2 GROUP BY question_id),
ctx AS (
  SELECT e.vec_id AS question_id,
    coalesce(nullif(concat_ws(chr(10) || chr(10),
      CASE WHEN len(tabs.l) > 0 THEN 'RELEVANT TABLES:' || chr(10) || array_to_string(tabs.l[1:5], chr(10) || chr(10)) END,
      CASE WHEN len(cols.l) > 0 THEN 'RELEVANT COLUMNS:' || chr(10) || array_to_string(cols.l[1:10], chr(10) || chr(10)) END,
      CASE WHEN len(qs.l) > 0 THEN 'SIMILAR QUERIES:' || chr(10) || array_to_string(qs.l[1:2], chr(10) || chr(10)) END
    ), ''), '{A.NO_CONTEXT}') AS context
  FROM embeddings e LEFT JOIN tabs ON tabs.question_id = e.vec_id LEFT JOIN cols ON cols.question_id = e.vec_id
  LEFT JOIN qs ON qs.question_id = e.vec_id)"""


def _context_df(spark, sf):
    r = retrieval_context(spark, sf)
    return r.select("question_id", A.assemble_context(F.col("tables"), F.col("columns"),
                                                      F.col("queries")).alias("context"), "tables",
                    "columns", "queries")


@query("context_text", ids="E6 E7 E8 E9 E10", oracle=CONTEXT_SQL + """
SELECT question_id, context FROM ctx""")
def context_text(spark, sf):
    return _context_df(spark, sf).select("question_id", "context")


def _question_text(col="question_id"):
    return F.concat(F.lit("Which rows are most like vec_"), F.col(col).cast("string"), F.lit("?"))


def _prompt_sql() -> str:
    parts = []
    for lit, name in A.template_parts(TEMPLATE, {"context", "query", "schema"}):
        if lit:
            parts.append("'" + lit.replace("'", "''") + "'")
        if name == "context":
            parts.append("context")
        elif name == "query":
            parts.append("'Which rows are most like vec_' || question_id || '?'")
        elif name == "schema":
            parts.append(f"'{SCHEMA_NAME}'")
    return " || ".join(parts)


@query("prompt_text", ids="E11 E26", oracle=CONTEXT_SQL + f"""
SELECT question_id, md5({_prompt_sql()}) AS prompt_md5, length({_prompt_sql()}) AS prompt_len FROM ctx""")
def prompt_text(spark, sf):
    ctx = _context_df(spark, sf)
    p = A.build_prompt(TEMPLATE, {"context": F.col("context"), "query": _question_text(),
                                  "schema": F.lit(SCHEMA_NAME)})
    return ctx.select("question_id", F.md5(p).alias("prompt_md5"), F.length(p).cast("bigint").alias("prompt_len"))


@query("stage_metadata", ids="E22", oracle=CONTEXT_SQL.split("cols AS")[0].rstrip().rstrip(",") + """,
qr AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id) AS rank FROM p),
nq AS (SELECT question_id, count(*) FILTER (WHERE rank <= 2) AS n FROM qr GROUP BY question_id),
nc AS (SELECT question_id, count(*) FILTER (WHERE rank <= 5) AS n FROM cr GROUP BY question_id),
nt AS (SELECT question_id, count(*) AS n FROM top_t GROUP BY question_id)
SELECT e.vec_id AS question_id,
  'columns_found=' || coalesce(nc.n, 0) || ';context_processing_strategy=simple;queries_found=' || coalesce(nq.n, 0)
  || ';retrieval_strategy=cosine_similarity;tables_found=' || coalesce(nt.n, 0) AS metadata
FROM embeddings e LEFT JOIN nt ON nt.question_id = e.vec_id LEFT JOIN nc ON nc.question_id = e.vec_id
LEFT JOIN nq ON nq.question_id = e.vec_id""")
def stage_metadata(spark, sf):
    ctx = _context_df(spark, sf)
    md = A.stage_metadata(retrieval_strategy=F.lit("cosine_similarity"),
                          tables_found=F.coalesce(F.size("tables"), F.lit(0)),
                          columns_found=F.coalesce(F.size("columns"), F.lit(0)),
                          queries_found=F.coalesce(F.size("queries"), F.lit(0)),
                          context_processing_strategy=F.lit("simple"))
    entries = F.array_sort(F.map_entries(md))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return ctx.select("question_id", text.alias("metadata"))


# -------------------------------------------------------------- parsing ---

def _jesc(c):
    """JSON string escaping of backslash, quote and the common control characters."""
    x = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    x = F.replace(x, F.lit('"'), F.lit('\\"'))
    x = F.replace(x, F.lit("\n"), F.lit("\\n"))
    x = F.replace(x, F.lit("\r"), F.lit("\\r"))
    return F.replace(x, F.lit("\t"), F.lit("\\t"))


def synthesized_answers(spark, sf):
    """Model answers in every shape the parser must handle, built from each conversation message."""
    conv = spread(read_table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    sql = F.concat(F.lit("SELECT count(*) FROM conversations WHERE conv_id = "), F.col("conv_id").cast("string"),
                   F.lit(";"))
    expl = F.concat(F.lit("Counts the messages of conversation "), F.col("conv_id").cast("string"))
    js = F.concat(F.lit('{"query": "'), _jesc(sql), F.lit('", "explanation": "'), _jesc(expl), F.lit('"}'))
    t = F.col("text")
    shapes = F.array(
        F.struct(F.lit("json").alias("shape"), js.alias("a")),
        F.struct(F.lit("fenced_json").alias("shape"),
                 F.concat(t, F.lit("\n```json\n"), js, F.lit("\n```\nHope this helps.")).alias("a")),
        F.struct(F.lit("sql_fence").alias("shape"), F.concat(F.lit("Here it is: "), t, F.lit("\n```sql\n"), sql,
                                                             F.lit("\n```")).alias("a")),
        F.struct(F.lit("bare_sql").alias("shape"), F.concat(t, F.lit(" "), F.lower(sql), F.lit(" ok")).alias("a")),
        F.struct(F.lit("no_semicolon").alias("shape"),
                 F.concat(F.lit("Try "), F.regexp_replace(sql, ";", "")).alias("a")),
        F.struct(F.lit("json_trailing").alias("shape"), F.concat(js, F.lit(" x")).alias("a")),
        F.struct(F.lit("no_query").alias("shape"),
                 F.concat(F.lit('{"explanation": "'), _jesc(expl), F.lit('"}')).alias("a")),
        F.struct(F.lit("empty").alias("shape"), F.lit("").alias("a")),
    )
    return conv.select("conv_id", "turn", F.explode(shapes).alias("s")) \
        .select("conv_id", "turn", "s.shape", F.col("s.a").alias("llm_response"))


def _jesc_sql(e: str) -> str:
    return (f"replace(replace(replace(replace(replace({e}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), "
            f"chr(13), '\\r'), chr(9), '\\t')")


ANSWERS_SQL = f"""
WITH b AS (SELECT conv_id, turn, text,
    'SELECT count(*) FROM conversations WHERE conv_id = ' || conv_id || ';' AS sql,
    'Counts the messages of conversation ' || conv_id AS expl FROM conversations),
j AS (SELECT *, '{{"query": "' || {_jesc_sql('sql')} || '", "explanation": "' || {_jesc_sql('expl')} || '"}}' AS js FROM b),
answers AS (
  SELECT conv_id, turn, 'json' AS shape, js AS llm_response FROM j
  UNION ALL SELECT conv_id, turn, 'fenced_json', text || chr(10) || '```json' || chr(10) || js || chr(10) || '```' || chr(10) || 'Hope this helps.' FROM j
  UNION ALL SELECT conv_id, turn, 'sql_fence', 'Here it is: ' || text || chr(10) || '```sql' || chr(10) || sql || chr(10) || '```' FROM j
  UNION ALL SELECT conv_id, turn, 'bare_sql', text || ' ' || lower(sql) || ' ok' FROM j
  UNION ALL SELECT conv_id, turn, 'no_semicolon', 'Try ' || replace(sql, ';', '') FROM j
  UNION ALL SELECT conv_id, turn, 'json_trailing', js || ' x' FROM j
  UNION ALL SELECT conv_id, turn, 'no_query', '{{"explanation": "' || {_jesc_sql('expl')} || '"}}' FROM j
  UNION ALL SELECT conv_id, turn, 'empty', '' FROM j)"""

_WS = r"[\t\n\x0B\f\r ]"


def _d_strip(e):
    return f"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"


PARSE_SQL = ANSWERS_SQL + f""",
c AS (SELECT *, {_d_strip('llm_response')} AS t0 FROM answers),
c2 AS (SELECT *, CASE WHEN contains(t0, '```json') THEN {_d_strip("split_part(split_part(t0, '```json', 2), '```', 1)")}
                      WHEN contains(t0, '```') THEN {_d_strip("split_part(t0, '```', 2)")}
                      ELSE t0 END AS cleaned FROM c),
g AS (SELECT *, coalesce(try(json_valid(cleaned) AND json_type(cleaned) = 'OBJECT'), false) AS is_obj FROM c2),
jq AS (SELECT *, CASE WHEN is_obj THEN json_extract_string(cleaned, '$.query') END AS jquery,
                 CASE WHEN is_obj THEN json_extract_string(cleaned, '$.explanation') END AS jexpl FROM g),
rx AS (SELECT *,
  CASE WHEN regexp_matches(llm_response, '(?i)```sql{_WS}*([\\s\\S]*?){_WS}*```') THEN 1
       WHEN regexp_matches(llm_response, '```{_WS}*([\\s\\S]*?){_WS}*```') THEN 2
       WHEN regexp_matches(llm_response, '(?i)(?:SELECT|INSERT|UPDATE|DELETE)[\\s\\S]*?;') THEN 3 END AS which FROM jq),
rx2 AS (SELECT *,
  CASE which WHEN 1 THEN regexp_extract(llm_response, '(?i)(```sql{_WS}*([\\s\\S]*?){_WS}*```)', 1)
             WHEN 2 THEN regexp_extract(llm_response, '(```{_WS}*([\\s\\S]*?){_WS}*```)', 1)
             WHEN 3 THEN regexp_extract(llm_response, '(?i)((?:SELECT|INSERT|UPDATE|DELETE)[\\s\\S]*?;)', 1) END AS g0,
  CASE which WHEN 1 THEN {_d_strip("regexp_extract(llm_response, '(?i)```sql" + _WS + "*([\\s\\S]*?)" + _WS + "*```', 1)")}
             WHEN 2 THEN {_d_strip("regexp_extract(llm_response, '```" + _WS + "*([\\s\\S]*?)" + _WS + "*```', 1)")}
             END AS g1 FROM rx),
rx3 AS (SELECT *, CASE WHEN which IN (1, 2) AND g1 <> '' THEN g1 WHEN which IS NOT NULL THEN {_d_strip('g0')} END AS rsql,
   nullif({_d_strip("CASE WHEN strpos(llm_response, g0) > 1 THEN substr(llm_response, 1, strpos(llm_response, g0) - 1) ELSE '' END")}, '') AS rexp
   FROM rx2),
parsed AS (SELECT *, coalesce(jquery <> '', false) AS ok FROM rx3)"""


@query("parse_answer", ids="E13 E14 E15 E16", oracle=PARSE_SQL + """
SELECT conv_id, turn, shape, CASE WHEN ok THEN jquery ELSE rsql END AS sql_query,
  CASE WHEN ok THEN jexpl ELSE rexp END AS explanation,
  CASE WHEN ok THEN 'json' WHEN rsql IS NOT NULL THEN 'regex' ELSE 'none' END AS parse_method
FROM parsed""")
def parse_answer(spark, sf):
    return A.parse_answer(synthesized_answers(spark, sf)).select(
        "conv_id", "turn", "shape", "sql_query", "explanation", "parse_method")


@query("parse_fallback", ids="E24", oracle=PARSE_SQL + """
SELECT conv_id, turn, shape, CASE WHEN is_obj THEN coalesce(jquery, '') ELSE '' END AS query,
  CASE WHEN is_obj THEN jexpl ELSE 'Error during JSON parsing' END AS explanation
FROM parsed""")
def parse_fallback(spark, sf):
    a = synthesized_answers(spark, sf)
    return a.select("conv_id", "turn", "shape", A.lenient_json(F.col("llm_response")).alias("r")) \
        .select("conv_id", "turn", "shape", "r.query", "r.explanation")


# ------------------------------------------------------------ execution ---

def _type_statements(spark, sf):
    ev = read_table(spark, sf, "events").select("event_type").distinct()
    sql = F.concat(F.lit("SELECT user_id, count(*) AS n FROM events WHERE event_type = '"), F.col("event_type"),
                   F.lit("' GROUP BY user_id ORDER BY n DESC, user_id"))
    return ev.select("event_type", sql.alias("sql_query"))


PREVIEW_SQL = """
r AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS i FROM r),
pv AS (SELECT event_type, string_agg('{"user_id":' || user_id || ',"n":' || n || '}', chr(10) ORDER BY i) AS preview
       FROM rk WHERE i <= 10 GROUP BY event_type),
rc AS (SELECT event_type, count(*) AS row_count FROM r GROUP BY event_type)"""


@query("execute_preview", ids="A6 E17 E18", oracle="WITH" + PREVIEW_SQL + """
SELECT event_type, true AS executed, row_count, preview FROM pv JOIN rc USING (event_type)""")
def execute_preview(spark, sf):
    register_views(spark, sf, ["events"])
    ex = A.execute_distinct(spark, _type_statements(spark, sf))
    return ex.select("event_type", "executed", "row_count", F.array_join("preview", "\n").alias("preview"))


@query("execute_legacy", ids="E25", oracle="WITH" + PREVIEW_SQL.replace("i <= 10", "i <= 5") + """
SELECT event_type, true AS success, row_count AS n_results, preview, CAST(NULL AS VARCHAR) AS error FROM pv JOIN rc USING (event_type)
UNION ALL SELECT 'no rows', true, 0, '', NULL UNION ALL SELECT 'no table', false, NULL, NULL, 'Failed to execute the SQL query'""")
def execute_legacy(spark, sf):
    """The legacy form of a response: all results and the first five; an empty result and a failing statement beside them."""
    register_views(spark, sf, ["events"])
    more = spark.createDataFrame([("no rows", "SELECT user_id FROM events WHERE false"), ("no table", "SELECT 1 FROM nowhere")], "event_type string, sql_query string")
    ex = A.execute_distinct(spark, _type_statements(spark, sf).unionByName(more), preview_rows=A.LEGACY_ROWS)
    out = A.legacy_response(ex)
    return out.select("event_type", "success", "n_results", F.array_join("preview", "\n").alias("preview"), "error")


@query("sanitize_rows", ids="E20 I12", oracle="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN microsecond(o_orderdate) % 1000000 = 0 THEN ''
         ELSE '.' || lpad(CAST(microsecond(o_orderdate) % 1000000 AS VARCHAR), 6, '0') END AS o_orderdate,
  o_orderpriority
FROM orders""")
def sanitize_rows(spark, sf):
    return A.sanitize(read_table(spark, sf, "orders"))


def _response_answers(spark, sf):
    """Per event type, answers in five states: good JSON, fenced SQL, DML, no SQL, bad column."""
    st = _type_statements(spark, sf)
    t = F.col("event_type")
    good = F.concat(F.lit('{"query": "'), F.col("sql_query"), F.lit('", "explanation": "Top users for '), t,
                    F.lit('"}'))
    shapes = F.array(
        F.struct(F.lit("json").alias("shape"), good.alias("a")),
        F.struct(F.lit("sql_fence").alias("shape"),
                 F.concat(F.lit("Users by "), t, F.lit(":\n```sql\n"), F.col("sql_query"), F.lit("\n```")).alias("a")),
        F.struct(F.lit("dml").alias("shape"),
                 F.concat(F.lit("DELETE FROM events WHERE event_type = '"), t, F.lit("';")).alias("a")),
        F.struct(F.lit("prose").alias("shape"), F.concat(F.lit("I cannot answer questions about "), t).alias("a")),
        F.struct(F.lit("bad_column").alias("shape"),
                 F.concat(F.lit("```sql\nSELECT no_such_column FROM events WHERE event_type = '"), t,
                          F.lit("'\n```")).alias("a")),
        F.struct(F.lit("runtime_error").alias("shape"),
                 F.concat(F.lit("```sql\nSELECT CAST(event_type AS INT) AS x FROM events WHERE event_type = '"), t, F.lit("'\n```")).alias("a")),
        F.struct(F.lit("cte_insert").alias("shape"),
                 F.concat(F.lit("```sql\nWITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '/no/such/place' USING parquet SELECT x, '"), t,
                          F.lit("' FROM a\n```")).alias("a")),
        F.struct(F.lit("empty").alias("shape"), F.lit(None).cast("string").alias("a")),
    )
    return st.select("event_type", F.explode(shapes).alias("s")).select(
        "event_type", "s.shape", F.col("s.a").alias("llm_response"))


@query("response_assembly", ids="E19 E21 H7", oracle="WITH" + PREVIEW_SQL + """,
t AS (SELECT DISTINCT event_type FROM events),
s(shape) AS (VALUES ('json'), ('sql_fence'), ('dml'), ('prose'), ('bad_column'), ('runtime_error'), ('cte_insert'), ('empty'))
SELECT t.event_type, s.shape,
  s.shape IN ('json', 'sql_fence') AS success,
  CASE s.shape WHEN 'empty' THEN 'No response received from the language model'
               WHEN 'prose' THEN 'Could not extract a valid SQL query from the response'
               WHEN 'dml' THEN 'Refused: only a single read-only SELECT or WITH statement is executed'
               WHEN 'cte_insert' THEN 'Refused: only a single read-only SELECT or WITH statement is executed'
               WHEN 'runtime_error' THEN 'Failed to execute the SQL query'
               WHEN 'bad_column' THEN 'Failed to execute the SQL query' END AS error,
  CASE WHEN s.shape IN ('json', 'sql_fence') THEN 'SELECT user_id, count(*) AS n FROM events WHERE event_type = '''
         || t.event_type || ''' GROUP BY user_id ORDER BY n DESC, user_id'
       WHEN s.shape = 'runtime_error' THEN 'SELECT CAST(event_type AS INT) AS x FROM events WHERE event_type = ''' || t.event_type || ''''
       WHEN s.shape = 'cte_insert' THEN 'WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY ''/no/such/place'' USING parquet SELECT x, '''
         || t.event_type || ''' FROM a'
       WHEN s.shape = 'dml' THEN 'DELETE FROM events WHERE event_type = ''' || t.event_type || ''';'
       WHEN s.shape = 'bad_column' THEN 'SELECT no_such_column FROM events WHERE event_type = ''' || t.event_type || ''''
  END AS query,
  CASE s.shape WHEN 'json' THEN 'Top users for ' || t.event_type WHEN 'sql_fence' THEN 'Users by ' || t.event_type || ':'
               WHEN 'prose' THEN 'I cannot answer questions about ' || t.event_type
               WHEN 'empty' THEN NULL ELSE 'No explanation provided' END AS explanation,
  CASE WHEN s.shape IN ('json', 'sql_fence') THEN pv.preview END AS preview,
  CASE WHEN s.shape IN ('json', 'sql_fence') THEN rc.row_count END AS row_count,
  s.shape NOT IN ('json', 'sql_fence') AS has_error,
  s.shape NOT IN ('prose', 'empty') AS has_query,
  s.shape IN ('json', 'sql_fence') AS has_results
FROM t CROSS JOIN s LEFT JOIN pv ON pv.event_type = t.event_type LEFT JOIN rc ON rc.event_type = t.event_type""")
def response_assembly(spark, sf):
    from tessera.operators.chatlog import answer_flags
    register_views(spark, sf, ["events"])
    parsed = A.parse_answer(_response_answers(spark, sf))
    ex = A.execute_distinct(spark, parsed)
    resp = A.assemble_response(ex)
    out = resp.select("event_type", "shape", "success", "error", "query",
                      F.col("response_explanation").alias("explanation"),
                      F.col("response_preview").alias("preview"), "row_count",
                      F.lit(False).alias("from_vector_store"))
    flagged = answer_flags(out)
    return flagged.select("event_type", "shape", "success", "error", "query", "explanation",
                          F.array_join("preview", "\n").alias("preview"), "row_count", "has_error", "has_query", "has_results")


@query("table_preview", ids="E27 I9", oracle="""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
  'C Custkey|C Name|C Nationkey|C Acctbal|C Mktsegment' AS headers
FROM customer ORDER BY c_custkey LIMIT 10""")
def table_preview(spark, sf):
    cust = read_table(spark, sf, "customer")
    headers = "|".join(h for h in [spark.range(1).select(
        *[header_title(F.lit(c)).alias(c) for c in cust.columns]).first()[c] for c in cust.columns])
    return cust.orderBy("c_custkey").limit(10).withColumn("headers", F.lit(headers))
