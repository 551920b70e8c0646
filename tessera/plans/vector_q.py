"""D-queries: ids, exact cosine top-k and index maintenance over the driver tables.

The ``embeddings`` table is the column-document index (``label`` plays the
table the column belongs to); per-label centroids are the table documents.
Every vector asks for its neighbours, so each query covers the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import vectors as V
from tessera.operators.chatlog import messages_from_conversations
from tessera.plans.registry import query
from tessera.session import materialize
from tessera.sources.tables import read_table

DIM = 64


def _uuid_sql(expr: str) -> str:
    h = f"sha1(unhex('{V.DNS_NAMESPACE_HEX}') || encode({expr}))"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
            f"lower(printf('%x', (CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) & 3) | 8)) || "
            f"substr({h}, 18, 3) || '-' || substr({h}, 21, 12)")


def emb(spark, sf):
    return read_table(spark, sf, "embeddings")


def column_docs(spark, sf):
    """Index documents of type column: one per embedding row."""
    e = emb(spark, sf)
    t = F.concat(F.lit("label_"), F.col("label").cast("string"))
    n = F.concat(F.lit("vec_"), F.col("vec_id").cast("string"))
    return e.select(V.column_doc_id(t, n).alias("id"), F.lit("column").alias("type"),
                    F.col("embedding").alias("vector"), n.alias("name"), t.alias("table"),
                    F.lit(None).cast("string").alias("question"),
                    F.to_json(F.struct(F.col("vec_id"), F.col("label"))).alias("payload"))


def table_docs(spark, sf):
    """Index documents of type table: the centroid of each label's vectors."""
    c = V.centroids(emb(spark, sf).select("label", F.col("embedding").alias("vector")), "label")
    t = F.concat(F.lit("label_"), F.col("label").cast("string"))
    return c.select(V.table_doc_id(t).alias("id"), F.lit("table").alias("type"),
                    F.transform("vector", lambda x: x.cast("float")).alias("vector"), t.alias("name"),
                    t.alias("table"), F.lit(None).cast("string").alias("question"),
                    F.to_json(F.struct(F.col("label"))).alias("payload"))


CENTROIDS_SQL = """SELECT label, list(x ORDER BY i) AS c FROM (
  SELECT label, i, avg(x) AS x FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
  GROUP BY label, i) GROUP BY label"""


@query("doc_ids", ids="D6", oracle=f"""
SELECT 'table' AS kind, 'orders' AS name, {_uuid_sql("'table_orders'")} AS id
UNION ALL
SELECT 'column', 'label_' || label || '.vec_' || vec_id, {_uuid_sql("'column_label_' || label || '_vec_' || vec_id")}
FROM embeddings
UNION ALL
SELECT 'query', CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), {_uuid_sql('text')}
FROM conversations WHERE role = 'user'""")
def doc_ids(spark, sf):
    e = emb(spark, sf)
    col_ids = e.select(F.lit("column").alias("kind"),
                       F.concat(F.lit("label_"), F.col("label").cast("string"), F.lit(".vec_"),
                                F.col("vec_id").cast("string")).alias("name"),
                       V.column_doc_id(F.concat(F.lit("label_"), F.col("label").cast("string")),
                                       F.concat(F.lit("vec_"), F.col("vec_id").cast("string"))).alias("id"))
    msgs = messages_from_conversations(read_table(spark, sf, "conversations")).where("type = 'user'")
    q_ids = msgs.select(F.lit("query").alias("kind"),
                        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"),
                        V.query_doc_id("content").alias("id"))
    t_ids = spark.range(1).select(F.lit("table").alias("kind"), F.lit("orders").alias("name"),
                                  V.table_doc_id(F.lit("orders")).alias("id"))
    return t_ids.unionByName(col_ids).unionByName(q_ids)


def _self_questions(spark, sf):
    return emb(spark, sf).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("qvec"),
                                 F.col("label").alias("qlabel"), F.col("vec_id").alias("self_id"))


def _docs(spark, sf):
    return emb(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


PAIRS_SQL = """SELECT a.vec_id AS question_id, b.vec_id AS id, a.label AS qlabel, b.label AS dlabel,
  list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"""


@query("vec_topk", ids="D17 D19 D21 E5", oracle=f"""
WITH p AS ({PAIRS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id) AS rank FROM p)
SELECT question_id, id, round(sim, 6) AS similarity_score, rank FROM r WHERE rank <= 3""")
def vec_topk(spark, sf):
    hits = V.topk_cosine(_self_questions(spark, sf), _docs(spark, sf), 3, q_self="self_id", dim=DIM)
    return hits.select("question_id", "id", F.round("similarity_score", 6).alias("similarity_score"),
                       F.col("rank").cast("bigint").alias("rank"))


@query("vec_topk_filtered", ids="D17 D18", oracle=f"""
WITH p AS ({PAIRS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id) AS rank
      FROM p WHERE qlabel = dlabel)
SELECT question_id, id, round(sim, 6) AS similarity_score, rank FROM r WHERE rank <= 2""")
def vec_topk_filtered(spark, sf):
    hits = V.topk_cosine(_self_questions(spark, sf), _docs(spark, sf), 2, q_self="self_id",
                         q_group="qlabel", doc_group="label", dim=DIM)
    return hits.select("question_id", "id", F.round("similarity_score", 6).alias("similarity_score"),
                       F.col("rank").cast("bigint").alias("rank"))


def retrieve_tables_then_columns(spark, questions, tables, columns, k_tables=3, k_columns=5, dim=None):
    """E3 + E4: top tables per question, then top columns inside each retrieved table.

    The second search is one more top-k whose questions are the (question,
    table) pairs; the table equality is the group filter. No thread pool,
    no per-table round trip.
    """
    th = V.topk_cosine(questions, tables, k_tables, doc_key="table", dim=dim)
    pairs = materialize(th.join(questions, "question_id")
             .select(F.concat_ws("|", F.col("question_id").cast("string"), "table").alias("pair"),
                     "question_id", F.col("table").alias("ptable"), F.col("rank").alias("table_rank"),
                     "qvec", *(["self_id"] if "self_id" in questions.columns else [])), "pairs")
    ch = V.topk_cosine(pairs, columns, k_columns, q_key="pair", doc_key="id", q_group="ptable",
                       doc_group="table", q_self="self_id" if "self_id" in pairs.columns else None, dim=dim)
    return ch.join(pairs.select("pair", "question_id", "ptable", "table_rank"), "pair") \
        .select("question_id", F.col("ptable").alias("table"), "table_rank", "id", "rank", "similarity_score")


@query("vec_topk_per_group", ids="D18 D20 E3 E4", oracle=f"""
WITH c AS ({CENTROIDS_SQL}),
ts AS (SELECT e.vec_id AS question_id, c.label,
         list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c) AS sim FROM embeddings e, c),
tr AS (SELECT question_id, label, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, label) AS table_rank
       FROM ts),
top_t AS (SELECT * FROM tr WHERE table_rank <= 3),
p AS ({PAIRS_SQL}),
cr AS (SELECT t.question_id, t.label, t.table_rank, p.id, p.sim,
         row_number() OVER (PARTITION BY t.question_id, t.label ORDER BY p.sim DESC, p.id) AS rank
       FROM top_t t JOIN p ON p.question_id = t.question_id AND p.dlabel = t.label)
SELECT question_id, 'label_' || label AS "table", table_rank, id, rank, round(sim, 6) AS similarity_score
FROM cr WHERE rank <= 5""")
def vec_topk_per_group(spark, sf):
    q = _self_questions(spark, sf).drop("qlabel")
    cent = V.centroids(emb(spark, sf).select("label", F.col("embedding").alias("vector")), "label") \
        .select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("table"), "vector")
    cols = _docs(spark, sf).select("id", "vector",
                                   F.concat(F.lit("label_"), F.col("label").cast("string")).alias("table"))
    out = retrieve_tables_then_columns(spark, q, cent, cols, dim=DIM)
    return out.select("question_id", "table", F.col("table_rank").cast("bigint").alias("table_rank"), "id",
                      F.col("rank").cast("bigint").alias("rank"),
                      F.round("similarity_score", 6).alias("similarity_score"))


def _vsum(c):
    return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")), 4)


UPSERT_SQL = f"""
WITH c AS ({CENTROIDS_SQL}),
col_docs AS (SELECT {_uuid_sql("'column_label_' || label || '_vec_' || vec_id")} AS id, 'column' AS type,
               'vec_' || vec_id AS name, 'label_' || label AS tbl,
               list_transform(embedding, lambda x: CAST(x * 2 AS FLOAT)) AS vector FROM embeddings),
tab_docs AS (SELECT {_uuid_sql("'table_label_' || label")} AS id, 'table' AS type, 'label_' || label AS name,
               'label_' || label AS tbl, list_transform(c, lambda x: CAST(x AS FLOAT)) AS vector FROM c),
idx AS (SELECT * FROM col_docs UNION ALL SELECT * FROM tab_docs)"""


def upserted_index(spark, sf):
    """Index v1 = column docs; batch = table docs (inserts) + every column doc re-scaled (replaces)."""
    base = column_docs(spark, sf)
    rescaled = base.withColumn("vector", F.transform("vector", lambda x: (x * 2).cast("float")))
    return V.upsert(base, table_docs(spark, sf).unionByName(rescaled))


@query("index_upsert", ids="D7 D8", oracle=UPSERT_SQL + """
SELECT id, type, name, tbl AS table_name, len(vector) AS dim,
       round(list_sum(CAST(vector AS DOUBLE[])), 4) AS vsum FROM idx""")
def index_upsert(spark, sf):
    idx = upserted_index(spark, sf)
    return idx.select("id", "type", "name", F.col("table").alias("table_name"),
                      F.size("vector").cast("bigint").alias("dim"), _vsum(F.col("vector")).alias("vsum"))


@query("index_delete", ids="D10", oracle=f"""
WITH idx AS (SELECT {_uuid_sql("'column_label_' || label || '_vec_' || vec_id")} AS id,
               'vec_' || vec_id AS name, embedding FROM embeddings)
SELECT id, name FROM idx WHERE NOT (embedding[1] < 0)""")
def index_delete(spark, sf):
    """Delete the documents listed in a batch of ids (here: vectors whose first component is negative)."""
    idx = column_docs(spark, sf)
    doomed = idx.where(F.col("vector")[0] < 0).select("id")
    return V.delete_ids(idx, doomed).select("id", "name")


@query("index_update_vectors", ids="D11", oracle=f"""
WITH idx AS (SELECT {_uuid_sql("'column_label_' || label || '_vec_' || vec_id")} AS id,
               CAST(to_json({{'vec_id': vec_id, 'label': label}}) AS VARCHAR) AS payload, embedding FROM embeddings)
SELECT id, payload, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(-x AS FLOAT) AS DOUBLE))), 4) AS vsum
FROM idx""")
def index_update_vectors(spark, sf):
    idx = column_docs(spark, sf)
    new = idx.select("id", F.transform("vector", lambda x: (-x).cast("float")).alias("vector"))
    upd = V.update_vectors(idx, new)
    return upd.select("id", "payload", _vsum(F.col("vector")).alias("vsum"))


@query("index_dim_check", ids="A10", oracle=UPSERT_SQL + f"""
SELECT type, count(*) AS n_docs, min(len(vector)) AS min_dim, max(len(vector)) AS max_dim,
       bool_and(len(vector) = {DIM}) AS dim_ok FROM idx GROUP BY type""")
def index_dim_check(spark, sf):
    return V.dimension_check(upserted_index(spark, sf), DIM)


@query("exact_match_gate", ids="D15", oracle=f"""
WITH stored AS (SELECT {_uuid_sql('text')} AS qid, min(doc_id) AS stored_doc_id FROM documents GROUP BY text)
SELECT d.doc_id, s.stored_doc_id, s.stored_doc_id IS NOT NULL AS exact_match,
       coalesce(s.stored_doc_id <> d.doc_id, false) AS is_copy
FROM documents d LEFT JOIN stored s ON s.qid = {_uuid_sql('d.text')}""")
def exact_match_gate(spark, sf):
    """Each document as an incoming question against the stored (deduplicated) texts."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    stored = docs.select(F.col("doc_id").alias("stored_doc_id"), F.col("text").alias("question"))
    hit = V.exact_match(docs.withColumnRenamed("text", "question"), stored)
    return hit.select("doc_id", F.col("m.stored_doc_id").alias("stored_doc_id"), "exact_match",
                      F.coalesce(F.col("m.stored_doc_id") != F.col("doc_id"), F.lit(False)).alias("is_copy"))


# ------------------------------------------------------------ D13-D16 -----

def _index_texts(docs):
    """Documents as index rows without vector, plus the text to embed."""
    return docs.select(V.column_doc_id(F.lit("documents"), F.col("doc_id").cast("string")).alias("id"), F.lit("column").alias("type"),
                       F.col("doc_id").cast("string").alias("name"), F.lit("documents").alias("table"), F.lit(None).cast("string").alias("question"),
                       F.to_json(F.struct("lang", "source")).alias("payload"), "text")


def new_store(spark):
    import uuid

    from tessera.session import checkpoint_dir
    from tessera.sources.vector_store import VectorStore

    return VectorStore(spark, f"{checkpoint_dir(spark)}/index/{uuid.uuid4().hex}", DIM)


def _embed(texts):
    return V.hashed_embedding(texts, "text", ["id"], DIM)


@query("index_sync", ids="D13 D14 A10 A11", oracle="""
WITH d AS (SELECT coalesce(lang, '') = 'en' AS late, coalesce(source, '') = 'src1' AND contains(coalesce(text, ''), chr(10)) AS edited,
             coalesce(source, '') = 'src2' AS moved FROM documents),
s AS (SELECT 1 AS step, 'inserted' AS status, count(*) AS n FROM d WHERE NOT late
  UNION ALL SELECT 2, CASE WHEN late THEN 'inserted' WHEN edited THEN 'changed' WHEN moved THEN 'payload' ELSE 'untouched' END, count(*) FROM d GROUP BY 2
  UNION ALL SELECT 3, 'untouched', count(*) FROM d),
w AS (SELECT step, 'written' AS status, sum(n) AS n FROM s WHERE status <> 'untouched' GROUP BY step)
SELECT step, status, CAST(n AS BIGINT) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM w) WHERE n > 0""")
def index_sync(spark, sf):
    """Three synchronisations through the store: all documents but those of one language, then all (with one source's texts
    on one line and another source renamed), then the same again. Per step the documents by status and the rows written."""
    from tessera.sources.vector_store import refresh, sync

    docs = read_table(spark, sf, "documents")
    one_line = F.when(F.col("source") == "src1", F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(F.col("text"))
    renamed = F.when(F.col("source") == "src2", F.lit("archive2")).otherwise(F.col("source"))
    later = docs.withColumn("text", one_line).withColumn("source", renamed)
    store, steps = new_store(spark), []
    steps.append(sync(store, _index_texts(docs.where(F.coalesce("lang", F.lit("")) != "en")), _embed))
    steps.append(sync(store, _index_texts(later), _embed, sync_on_startup=True))
    steps.append(refresh(store, _index_texts(later), _embed))
    out = store.written().select((F.col("version") + 1).cast("int").alias("step"), F.lit("written").alias("status"), "n")
    for i, step in enumerate(steps):
        out = out.unionByName(step.select(F.lit(i + 1).alias("step"), "status", "n"))
    return out


@query("index_exists", ids="D16 D9 A10", oracle="""
SELECT conv_id, turn, EXISTS (SELECT 1 FROM conversations a WHERE a.role = 'user' AND a.turn = 0 AND a.text = c.text) AS stored
FROM conversations c WHERE role = 'user'""")
def index_exists(spark, sf):
    """Opening questions are stored as query documents; every user message is looked up in the store by its id."""
    msgs = messages_from_conversations(read_table(spark, sf, "conversations")).where("type = 'user'")
    first = msgs.where("turn = 0").select(F.col("content").alias("text")).where("text IS NOT NULL").distinct()
    rows = first.select(V.query_doc_id("text").alias("id"), F.lit("query").alias("type"), F.substring("text", 1, 40).alias("name"),
                        F.lit(None).cast("string").alias("table"), F.col("text").alias("question"), F.lit("{}").alias("payload"), "text")
    store = new_store(spark)
    vectors = _embed(rows.select("id", "text"))
    store.upsert(rows.drop("text").join(vectors, "id"))
    found = store.exists(msgs.select("conv_id", "turn", V.query_doc_id("content").alias("id")), ["id"])
    return found.select("conv_id", "turn", F.col("exists").alias("stored"))
