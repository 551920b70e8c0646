"""Registered queries of the training-data operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out
from tessera.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import identify, train

    docs = read_table(spark, sf_dir, "documents")
    rows, c = identify(docs, train(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(c["lang"]).alias("lang_pred"), F.col(c["score"]).alias("score"))


@query("op2_bitsliced_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.c, d.c) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.c) = len(d.c)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op2_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bitsliced import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; ``toxic`` marks those more likely toxic than not."""
    from tessera.llm.toxicity import score_toxicity, train

    docs = read_table(spark, sf_dir, "documents")
    rows, c = score_toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.col(c["severity"]).alias("severity"), F.col(c["p_toxic"]).alias("p_toxic"),
                       (F.col(c["p_toxic"]) >= 0.5).cast("int").alias("toxic"))


@query("op4_ngram_jaccard", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 90 * (u.n + v.n - c)),
r AS (SELECT doc_id AS x, doc_id AS z FROM documents UNION SELECT l.y, r.z FROM r JOIN l ON l.x = r.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(z) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n""")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.setjoin import near_classes

    rows = near_classes(read_table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op5_lm_score")
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed and mean conditional log-probability of every document's tokens."""
    from tessera.llm.pseudolm import score, train

    docs = read_table(spark, sf_dir, "documents")
    rows, c = score(docs, train(docs))
    return rows.select("doc_id", F.col(c["n_tokens"]).alias("n_tokens"), F.col(c["log_prob"]).alias("log_prob"), F.col(c["mean"]).alias("mean_log_prob"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import score_quality, train

    docs = read_table(spark, sf_dir, "documents")
    rows, c = score_quality(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(c["score"]).alias("score"),
                       (F.col(c["score"]) >= 0.7).cast("int").alias("predicted"))


@query("op7_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n FROM d),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS INTEGER), 100) AS win FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM p WHERE n >= 50)),
m AS (SELECT win, min(doc_id) AS first_id FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM w JOIN m USING (win) WHERE doc_id > first_id),
e AS (SELECT doc_id, i, coalesce(i > 50 + max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS opens FROM r),
g AS (SELECT doc_id, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
k AS (SELECT doc_id, span, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
c AS (SELECT k.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
        string_agg(substr(h, CAST(2 * since + 1 AS INTEGER), CAST(2 * (a - since) AS INTEGER)), '' ORDER BY a) AS kept
      FROM k JOIN p USING (doc_id) GROUP BY k.doc_id)
SELECT p.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE c.kept || substr(h, CAST(2 * tail + 1 AS INTEGER)) END)) AS kept_sha256
FROM p LEFT JOIN c ON p.doc_id = c.doc_id""")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffixdedup import without_repeats

    rows, c = without_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return rows.select("doc_id", size.alias("n_bytes"), (size - F.octet_length(c["kept"])).alias("n_removed"),
                       F.greatest(F.coalesce(F.size(c["starts"]), F.lit(0)), F.lit(0)).cast("bigint").alias("n_spans"),
                       F.sha2(c["kept"], 256).alias("kept_sha256"))


@query("op8_fingerprint")
def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprint import as_text, fingerprints, likeness

    rows = fingerprints(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                       likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


@query("op9_source_mix")
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    rows, c = mix(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col(c["size"]).alias("size"), F.col(c["source_size"]).alias("source_size"),
                       F.col(c["target"]).alias("target"), (F.col(c["size"]) * F.col(c["copies"])).alias("taken"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"))


_WORDS = r"""list_filter(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda t: length(t) > 0)"""


@query("op11_decontaminate", rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS t FROM documents),
i AS (SELECT item_id, {_WORDS.format(text="text")} AS t FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(t), 10) AS k, array_to_string(t[s:s + least(len(t), 10) - 1], ' ') AS win
      FROM (SELECT item_id, t, unnest(range(1, len(t) - least(len(t), 10) + 2)) AS s FROM i WHERE len(t) > 0)),
g AS (SELECT doc_id, s, k, array_to_string(t[s:s + k - 1], ' ') AS win
      FROM (SELECT doc_id, t, k, unnest(range(1, len(t) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM w) WHERE len(t) >= k)),
o AS (SELECT g.doc_id, g.s, g.k, w.item_id FROM g JOIN w ON g.k = w.k AND g.win = w.win),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS x FROM o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""")
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.wumanber import n_hit, occurrences

    rows, c = occurrences(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    hit, items = n_hit(F.col(c["spans"])), F.col(c["items"])
    return rows.select("doc_id", F.col(c["n_words"]).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
                       F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_TERMS = r"""list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: length(t) > 0)"""


@query("op13_lexical_search", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS}, []) AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
x AS (SELECT CAST(count(*) FILTER (WHERE len(t) > 0) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS l FROM d),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), x),
m AS (SELECT r, doc_id, 100 - 50 + (CAST(50 * len(t) AS BIGINT) * nd) // l AS m FROM d, x WHERE len(t) > 0),
c AS (SELECT f.r, f.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * m.m)) AS v FROM f JOIN w ON w.term = f.term JOIN m ON m.r = f.r),
s AS (SELECT q.item_id, c.r, CAST(sum(v) AS BIGINT) AS score FROM q JOIN c ON c.term = q.term GROUP BY q.item_id, c.r),
k AS (SELECT s.item_id, m.doc_id, score, row_number() OVER (PARTITION BY s.item_id ORDER BY score DESC, m.doc_id NULLS LAST) AS rank
      FROM s JOIN m ON m.r = s.r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lexsearch import search

    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op12_spelling_variants", r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(0, 256)) AS i))),
r AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY doc_id, run HAVING length(run) >= 6),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END)) AS y FROM r),
h AS (SELECT run, n, xor(list_reduce(y, lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b, tab),
s AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
v AS (SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS less FROM i),
p AS (SELECT DISTINCT word, near, near_n FROM (
  SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION ALL SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word
  UNION ALL SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word)),
f AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS best FROM p GROUP BY word),
l AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * w.n THEN best.near END AS form,
        CASE WHEN -best.less >= 5 * w.n THEN -best.less END AS form_n FROM w LEFT JOIN f ON f.word = w.word),
c AS (SELECT word, word AS root, 0 AS d FROM l UNION ALL SELECT c.word, l.form, d + 1 FROM c JOIN l ON l.word = c.root WHERE l.form IS NOT NULL)
SELECT l.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM l JOIN (SELECT word, arg_max(root, d) AS root FROM c GROUP BY word) e ON e.word = l.word""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling import variants

    return variants(read_table(spark, sf_dir, "documents"))
