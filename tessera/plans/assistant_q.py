"""C-queries (enrichment) and the end-to-end assistant recipe over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.functions.text import table_scoped_question
from tessera.operators import answer as A
from tessera.operators import enrich as N
from tessera.operators import feedback as FB
from tessera.operators import vectors as V
from tessera.plans.catalog_q import (COUNTS_SQL, SCHEMA_SQL, VERIFIED_SQL, _profile_sql,
                                     the_catalog)
from tessera.plans.keywords_q import keywords_sql
from tessera.plans.registry import query
from tessera.session import cut_lineage
from tessera.sources.tables import TABLES, read_table, register_views

DIM = 64

TABLE_FACTS_SQL = f"""
WITH s AS ({SCHEMA_SQL}), c AS ({VERIFIED_SQL}), n AS ({COUNTS_SQL}),
cols AS (SELECT tbl, count(*) AS n_cols, string_agg(name, ', ' ORDER BY position) AS columns FROM s GROUP BY tbl),
pk AS (SELECT tbl, string_agg(col, ', ' ORDER BY ordinal) AS pks FROM c WHERE kind = 'pk' GROUP BY tbl),
fk1 AS (SELECT tbl, constraint_name, '- ' || string_agg(col, ', ' ORDER BY ordinal) || ' -> ' || min(ref_table)
          || '(' || string_agg(ref_column, ', ' ORDER BY ordinal) || ')' AS line
        FROM c WHERE kind = 'fk' GROUP BY tbl, constraint_name),
fk AS (SELECT tbl, count(*) AS n_fk, string_agg(line, chr(10) ORDER BY constraint_name) AS lines FROM fk1 GROUP BY tbl),
facts AS (SELECT cols.tbl AS name, n_cols, columns, coalesce(pks, '') AS pks, coalesce(n_fk, 0) AS n_fk,
                 coalesce(lines, 'No foreign keys') AS fk_lines, coalesce(n.row_count, 0) AS row_count,
                 CAST(round(least(1.0, 0.2 * coalesce(n_fk, 0) + 0.1 * n_cols + CASE WHEN pks IS NULL THEN 0 ELSE 0.3 END), 2) AS DOUBLE) AS score
          FROM cols LEFT JOIN pk USING (tbl) LEFT JOIN fk USING (tbl) LEFT JOIN n USING (tbl))"""


def base_tables(spark, sf):
    cat = the_catalog(spark, sf)
    return cat.frames, cat.schema, cat.constraints(), cat.tables()


@query("importance_score", ids="C1", oracle=TABLE_FACTS_SQL + """
SELECT name, score AS importance_score FROM facts""")
def importance_score(spark, sf):
    _, _, _, t = base_tables(spark, sf)
    return t.select("name", N.importance_score(F.col("foreign_keys"), F.col("columns"),
                                               F.col("primary_keys")).alias("importance_score"))


@query("table_prompt", ids="C2", oracle=TABLE_FACTS_SQL + """,
p AS (SELECT name, '[table] ' || name || ' (' || row_count || ' rows)' || chr(10) || '[references]' || chr(10) || fk_lines || chr(10)
        || '[key] ' || pks || chr(10) || '[fields] ' || columns || chr(10) || chr(10)
        || 'Task: in at most two sentences, say what one row stands for. Use the facts above and nothing else.' AS prompt FROM facts)
SELECT name, md5(prompt) AS prompt_md5, length(prompt) AS prompt_len FROM p""")
def table_prompt(spark, sf):
    _, _, _, t = base_tables(spark, sf)
    p = N.table_prompt()
    return t.select("name", F.md5(p).alias("prompt_md5"), F.length(p).cast("bigint").alias("prompt_len"))


def catalog_columns_full(spark, sf):
    return the_catalog(spark, sf).columns()


@query("column_prompt", ids="C3 B3 B10", oracle=f"""
WITH s AS ({SCHEMA_SQL}), c AS ({VERIFIED_SQL}), prof AS ({_profile_sql(TABLES, ' | ')}),
f AS (SELECT s.tbl, s.name, s.data_type, s.nullable,
  EXISTS (SELECT 1 FROM c WHERE c.tbl = s.tbl AND c.col = s.name AND c.kind = 'pk') AS pk,
  EXISTS (SELECT 1 FROM c WHERE c.tbl = s.tbl AND c.col = s.name AND c.kind = 'fk') AS fk,
  prof.distinct_values AS dv
  FROM s LEFT JOIN prof ON prof.table_name = s.tbl AND prof.column_name = s.name),
p AS (SELECT tbl, name, CASE WHEN dv IS NOT NULL THEN '[values] ' || dv || chr(10) ELSE '' END
  || '[field] ' || tbl || '.' || name || ' : ' || data_type || chr(10) || '[marks] '
  || concat_ws('; ', CASE WHEN fk THEN 'references another table' END, CASE WHEN pk THEN 'part of the key' END, CASE WHEN nullable THEN 'may be missing' END)
  || chr(10) || chr(10) || 'Task: one short sentence on what this field holds. Use the facts above and nothing else.' AS prompt FROM f)
SELECT tbl AS table_name, name AS column_name, md5(prompt) AS prompt_md5 FROM p""")
def column_prompt(spark, sf):
    cols = catalog_columns_full(spark, sf)
    return cols.select(F.col("table").alias("table_name"), F.col("name").alias("column_name"),
                       F.md5(N.column_prompt()).alias("prompt_md5"))


@query("enrich_fallbacks", ids="C4 C5 C7 C9", oracle=TABLE_FACTS_SQL.replace("WITH s AS", "WITH RECURSIVE s AS") + """,
described AS (SELECT name, 'Rows of ' || name || ' linked to other tables.' AS description FROM facts WHERE n_fk > 0),
""" + keywords_sql("SELECT name AS doc_id, description AS text FROM described") + """
SELECT facts.name, coalesce(description, 'No description available') AS description,
  coalesce(array_to_string(list_transform(kept, lambda x: x.kw), ','), '') AS keywords,
  CASE WHEN n_fk > 0 THEN score ELSE 0.0 END AS importance_score
FROM facts LEFT JOIN described ON described.name = facts.name LEFT JOIN kw ON kw.doc_id = facts.name""")
def enrich_fallbacks(spark, sf):
    _, _, _, t = base_tables(spark, sf)
    e = N.enrich_tables(t, models.describe)
    return e.select("name", "description", F.array_join("keywords", ",").alias("keywords"),
                    "importance_score")


# --------------------------------------------------------- the assistant --

def build_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored catalog -> enriched docs -> vector index (type, table, vector, payload) with hashed embeddings, stored beside them."""
    cat = the_catalog(spark, sf)
    tdocs, cdocs = cat.enriched_tables(models.describe, "describe"), cat.enriched_columns(models.describe, "describe")

    def embedded():
        t_text = tdocs.select(V.table_doc_id("name").alias("id"), F.lit("table").alias("type"),
                              F.col("name").alias("table"), F.col("name").alias("name"),
                              V.table_embedding_text().alias("text"))
        c_text = cdocs.select(V.column_doc_id("table", "name").alias("id"), F.lit("column").alias("type"),
                              "table", "name", V.column_embedding_text().alias("text"))
        docs = t_text.unionByName(c_text)
        return docs.join(V.hashed_embedding(docs, "text", ["id"], DIM), "id")

    return cat.part(f"index-describe-{DIM}", embedded), tdocs, cdocs


FLAGSHIP_QUESTIONS = (
    "Which 5 customers have the most orders?",
    "What is the total revenue by product category and customer country, only above 5000?",
    "How many customers are there?",
    "Show any 5 records of suppliers and their nation",
)


def answer_questions(spark: SparkSession, sf: str, questions: DataFrame, complete_fn=models.write_sql,
                     k_tables: int = 3, k_columns: int = 5, k_queries: int = 3,
                     stored_queries: DataFrame | None = None) -> DataFrame:
    """E1-E23 for a DataFrame of (question_id, original_query)."""
    register_views(spark, sf)
    index, tdocs, cdocs = build_index(spark, sf)
    q = A.understand(questions)
    # A stored question needs no retrieval and no model; its stored SQL goes straight to execution
    fields = "question string, sql_query string, explanation string"
    stored = stored_queries if stored_queries is not None else spark.createDataFrame([], fields)
    stored = stored.select(V.query_doc_id("question").alias("id"), "question", "sql_query", "explanation")
    gate = V.exact_match(q.select("question_id", F.col("original_query").alias("question")), stored.select("question", "sql_query", "explanation"))
    gate = cut_lineage(gate.select("question_id", "exact_match", F.col("m").alias("hit")))
    missed = q.join(gate.where("exact_match"), "question_id", "left_anti")
    qv = cut_lineage(V.hashed_embedding(missed, "processed_query", ["question_id"], DIM, "qvec"))
    tables_idx = index.where("type = 'table'")
    cols_idx = index.where("type = 'column'")
    th = cut_lineage(V.topk_cosine(qv, tables_idx, k_tables, doc_key="table", dim=DIM))  # read by columns and by context
    pairs = (th.join(qv, "question_id")
             .select(F.concat_ws("|", F.col("question_id").cast("string"), "table").alias("pair"),
                     "question_id", F.col("table").alias("ptable"), F.col("rank").alias("table_rank"), "qvec"))
    ch = V.topk_cosine(pairs, cols_idx, k_columns, q_key="pair", doc_key="id", q_group="ptable",
                       doc_group="table", dim=DIM)
    ch = ch.join(pairs.select("pair", "question_id", "table_rank"), "pair")
    tinfo = tdocs.select(F.col("name").alias("table"), F.struct("name", "primary_keys", "description",
                                                                "columns").alias("t"))
    cinfo = cdocs.select(V.column_doc_id("table", "name").alias("id"),
                         F.struct("table", "name", "data_type", "is_primary_key", "is_foreign_key", "nullable",
                                  "description").alias("c"))
    t_arr = (th.join(tinfo, "table").groupBy("question_id")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "t"))).alias("l"))
             .select("question_id", F.transform("l", lambda x: x["t"]).alias("tables")))
    c_arr = (ch.join(cinfo, "id").groupBy("question_id")
             .agg(F.array_sort(F.collect_list(F.struct("table_rank", "rank", "c"))).alias("l"))
             .select("question_id", F.transform("l", lambda x: x["c"]).alias("columns")))
    ctx = q.join(gate, "question_id").join(t_arr, "question_id", "left").join(c_arr, "question_id", "left")
    if stored_queries is not None and k_queries > 0:
        sq = stored
        sv = V.hashed_embedding(sq, "question", ["id"], DIM)
        qh = V.topk_cosine(qv, sv, k_queries, doc_key="id", dim=DIM)
        q_arr = (qh.join(sq, "id").groupBy("question_id")
                 .agg(F.array_sort(F.collect_list(F.struct("rank", F.struct("question", "sql_query",
                                                                             "explanation").alias("q")))).alias("l"))
                 .select("question_id", F.transform("l", lambda x: x["q"]).alias("queries")))
        ctx = ctx.join(q_arr, "question_id", "left")
    else:
        ctx = ctx.withColumn("queries", F.lit(None).cast("array<struct<question:string,sql_query:string,explanation:string>>"))
    ctx = ctx.withColumn("queries", F.when(F.col("exact_match"), F.array(F.struct("hit.question", "hit.sql_query", "hit.explanation"))).otherwise(F.col("queries")))
    ctx = ctx.withColumn("context", A.assemble_context(F.col("tables"), F.col("columns"), F.col("queries")))
    ctx = ctx.withColumn("final_prompt", A.build_prompt(A.DEFAULT_TEMPLATE, {
        "context": F.col("context"), "query": F.col("original_query"), "schema": F.lit("main")}))
    ctx = ctx.withColumn("metadata", A.stage_metadata(
        query_understanding_strategy=F.lit("passthrough"), retrieval_strategy=F.lit("cosine_similarity"),
        tables_found=F.coalesce(F.size("tables"), F.lit(0)), columns_found=F.coalesce(F.size("columns"), F.lit(0)),
        queries_found=F.coalesce(F.size("queries"), F.lit(0)), exact_match_found=F.col("exact_match")))
    # model answers are computed once: execution reads them twice (distinct statements, join back)
    ctx = ctx.withColumn("final_prompt", F.when(~F.col("exact_match"), F.col("final_prompt")))  # only misses are asked
    answered = A.complete(ctx, "final_prompt", "llm_response", complete_fn)
    known = F.to_json(F.struct(F.col("hit.sql_query").alias("query"), F.col("hit.explanation").alias("explanation")))
    answered = cut_lineage(answered.withColumn("llm_response", F.when(F.col("exact_match"), known).otherwise(F.col("llm_response"))))
    parsed = A.parse_answer(answered)
    executed = A.execute_distinct(spark, parsed)
    return A.project_response(A.assemble_response(executed))


def flagship_questions(spark: SparkSession) -> DataFrame:
    qs = spark.createDataFrame([(q,) for q in FLAGSHIP_QUESTIONS], "original_query string")
    return qs.select(F.xxhash64("original_query").alias("question_id"), "original_query",
                     F.lit("default").alias("recipe"))


@query("flagship_answer", ids="E1 E3 E4 E6-E8 E10-E23 D1-D4 C4 C7 C8 B17")
def flagship_answer(spark, sf):
    """A batch of questions answered end to end; the driver smoke-checks this on sf0.001."""
    return answer_questions(spark, sf, flagship_questions(spark))


@query("exact_match_answers", ids="E2 D15", oracle="""
SELECT 'How many ' || event_type || ' events are there?' AS original_question, event_type < 'm' AS from_vector_store, true AS success,
  CASE WHEN event_type < 'm' THEN 'SELECT count(*) AS stored FROM events WHERE event_type = ''' || event_type || ''''
       ELSE 'SELECT count(*) AS n FROM events WHERE event_type = ''' || event_type || '''' END AS query,
  CASE WHEN event_type < 'm' THEN 'kept from an earlier answer' ELSE 'not stored' END AS explanation,
  CASE WHEN event_type < 'm' THEN '{"stored":' ELSE '{"n":' END || count(*) || '}' AS preview
FROM events GROUP BY event_type""")
def exact_match_answers(spark, sf):
    """Questions about every event type; those about types before 'm' are stored with their SQL, the others are misses."""
    types = read_table(spark, sf, "events").select("event_type").distinct()
    text = F.concat(F.lit("How many "), F.col("event_type"), F.lit(" events are there?"))
    questions = types.select(F.xxhash64(text).alias("question_id"), text.alias("original_query"), F.lit("default").alias("recipe"))
    stored = types.where("event_type < 'm'").select(
        text.alias("question"), F.concat(F.lit("SELECT count(*) AS stored FROM events WHERE event_type = '"), F.col("event_type"), F.lit("'")).alias("sql_query"),
        F.lit("kept from an earlier answer").alias("explanation"))
    out = answer_questions(spark, sf, questions, stored_queries=stored, k_queries=0)  # misses are asked without similar questions
    return out.select("original_question", "from_vector_store", "success", "query",
                      F.when(F.col("from_vector_store"), F.col("explanation")).otherwise("not stored").alias("explanation"), F.array_join("preview", "\n").alias("preview"))


def _stored_questions(spark, sf) -> DataFrame:
    """One answered question per event type, kept as query documents in the vector store and read back from it."""
    from tessera.plans.vector_q import new_store

    types = read_table(spark, sf, "events").select("event_type").distinct()
    kept = types.select(F.concat(F.lit("How many "), F.col("event_type"), F.lit(" events are there?")).alias("question"),
                        F.concat(F.lit("SELECT count(*) AS stored FROM events WHERE event_type = '"), F.col("event_type"), F.lit("'")).alias("sql_query"),
                        F.lit("kept from an earlier answer").alias("explanation"), F.lit(1).cast("bigint").alias("positive_votes"),
                        F.lit(None).cast("timestamp_ntz").alias("last_ts"))
    docs = FB.as_query_docs(kept)
    rows = docs.select("id", "type", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("table"), "question",
                       F.to_json(F.struct("sql_query", "explanation", "positive_votes")).alias("payload"))
    store = new_store(spark)
    store.upsert(rows.join(V.hashed_embedding(docs, "question", ["id"], DIM), "id"))
    p = F.from_json("payload", "sql_query string, explanation string")
    return store.read().where("type = 'query'").select("question", p["sql_query"].alias("sql_query"), p["explanation"].alias("explanation"))


@query("similar_question_answers", ids="D5 D9 D21 E2 E5 E9", oracle="""
WITH t AS (SELECT event_type, count(*) AS n, 'SELECT count(*) AS stored FROM events WHERE event_type = ''' || event_type || '''' AS query FROM events GROUP BY event_type)
SELECT 'How many ' || event_type || ' events are there?' AS original_question, true AS from_vector_store, true AS success, 'kept from an earlier answer' AS explanation,
  query, '{"stored":' || n || '}' AS preview, 1 AS queries_found FROM t
UNION ALL
SELECT 'Are there how many ' || event_type || ' events?', false, true, 'As for a similar question', query, '{"stored":' || n || '}', 1 FROM t""")
def similar_question_answers(spark, sf):
    """Questions that are stored, and others in different words: those find the most similar stored question, whose SQL the
    model reads in its prompt."""
    types = read_table(spark, sf, "events").select("event_type").distinct()
    asked = types.select(F.explode(F.array(F.concat(F.lit("How many "), F.col("event_type"), F.lit(" events are there?")),
                                           F.concat(F.lit("Are there how many "), F.col("event_type"), F.lit(" events?")))).alias("original_query"))
    questions = asked.select(F.xxhash64("original_query").alias("question_id"), "original_query", F.lit("default").alias("recipe"))
    out = answer_questions(spark, sf, questions, models.reuse_similar, stored_queries=_stored_questions(spark, sf), k_queries=1)
    return out.select("original_question", "from_vector_store", "success", "explanation", "query", F.array_join("preview", "\n").alias("preview"),
                      F.col("metadata")["queries_found"].cast("int").alias("queries_found"))


def _recipe_questions(spark, sf) -> DataFrame:
    ev = read_table(spark, sf, "events").select("event_type").distinct().select(
        F.concat(F.lit("How many "), F.col("event_type"), F.lit(" events are there?")).alias("original_query"))
    tabs = spark.createDataFrame([(t,) for t in TABLES], "t string").select(
        table_scoped_question(F.col("t"), F.lit("how many rows?")).alias("original_query"))
    return ev.unionByName(tabs).select(F.xxhash64("original_query").alias("question_id"), "original_query")


def recipe_stages(spark, sf):
    """A recipe is a tuple of DataFrame -> DataFrame stages (no retrieval in this one)."""
    return (
        A.understand,
        lambda d: d.withColumn("final_prompt", A.build_prompt(A.DEFAULT_TEMPLATE, {
            "context": F.lit(A.NO_CONTEXT_FOR_PROMPT), "query": F.col("processed_query"),
            "schema": F.lit("main")})),
        lambda d: cut_lineage(A.complete(d, "final_prompt", "llm_response", models.write_sql)),
        A.parse_answer,
        lambda d: A.execute_distinct(spark, d),
        lambda d: A.assemble_response(d).withColumn("exact_match", F.lit(False))
        .withColumn("metadata", A.stage_metadata(recipe=F.lit("count_recipe"))),
        A.project_response,
    )


@query("recipe_batch", ids="E1 E12 E23 E26 C4", oracle=f"""
SELECT 'How many ' || event_type || ' events are there?' AS original_question, true AS success,
  'SELECT count(*) AS n FROM events WHERE event_type = ''' || event_type || '''' AS query,
  '{{"n":' || count(*) || '}}' AS preview
FROM events GROUP BY event_type
UNION ALL
SELECT 'About table ' || tbl || ': how many rows?', true, 'SELECT count(*) AS n FROM ' || tbl,
  '{{"n":' || row_count || '}}' FROM ({COUNTS_SQL})""")
def recipe_batch(spark, sf):
    register_views(spark, sf)
    out = A.run_recipe(_recipe_questions(spark, sf), recipe_stages(spark, sf))
    return out.select("original_question", "success", "query", F.array_join("preview", "\n").alias("preview"))
