"""C5 queries: keyword extraction over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import keywords as K
from tessera.plans.registry import query
from tessera.sources.tables import read_table


# letters of the tables' languages beyond ASCII: DuckDB's edit distance counts bytes, so each becomes one
_LETTERS = "ßäöüçñáéíóúàèìòùâêîôûëï", "ABCDEFGHIJKLMNOPQRSTUVW"


def keywords_sql(docs: str, top: int = 5, dedup_lim: float = 0.2) -> str:
    """CTEs ending in ``kw(doc_id, kept)``: the keywords of ``docs`` (SQL for doc_id, text), best first, as {kw, score, a}."""
    stop = f"(term IN ({', '.join(repr(w) for w in K.STOPWORDS)}) OR length(term) < 3)"
    return rf"""kd AS ({docs}),
ka AS (SELECT doc_id, regexp_split_to_array(text, '[.!?]+[\t\n\x0B\f\r ]+|[\r\n]+') AS arr FROM kd),
ks AS (SELECT doc_id, unnest(arr) AS stext, generate_subscripts(arr, 1) - 1 AS sent FROM ka),
kb AS (SELECT doc_id, sent, regexp_split_to_array(stext, '[^\p{{L}}\p{{N}}]+') AS arr FROM ks),
kw0 AS (SELECT doc_id, sent, unnest(arr) AS word, generate_subscripts(arr, 1) - 1 AS wi FROM kb),
kt AS (SELECT doc_id, sent, wi, word, lower(word) AS term, lag(lower(word)) OVER p AS l, lead(lower(word)) OVER p AS r,
    length(word) > 1 AND word = upper(word) AND regexp_matches(word, '\p{{L}}') AS acr
  FROM kw0 WHERE word <> '' WINDOW p AS (PARTITION BY doc_id, sent ORDER BY wi)),
kn AS (SELECT doc_id, max(sent) + 1 AS n_sent FROM kt GROUP BY doc_id),
kp AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf, count(*) FILTER (WHERE regexp_matches(word, '^\p{{Lu}}') AND NOT acr AND wi > 0) AS up,
    count(*) FILTER (WHERE acr) AS ac, count(DISTINCT sent) AS ns, quantile_cont(sent, 0.5) AS mid,
    count(l) AS nl, count(r) AS nr, count(DISTINCT l) AS dl, count(DISTINCT r) AS dr FROM kt GROUP BY doc_id, term),
kq AS (SELECT doc_id, avg(tf) FILTER (WHERE NOT {stop}) AS mean, stddev_pop(tf) FILTER (WHERE NOT {stop}) AS std, max(tf) AS most FROM kp GROUP BY doc_id),
kr AS (SELECT doc_id, term, tf, {stop} AS stop, greatest(up, ac) / (1 + ln(tf)) AS c, ln(ln(3 + mid)) AS place, tf / (mean + std) AS freq,
    1 + (CASE WHEN nl > 0 THEN dl / nl ELSE 0.0 END + CASE WHEN nr > 0 THEN dr / nr ELSE 0.0 END) * tf / most AS rel, ns / n_sent AS dif
  FROM kp JOIN kq USING (doc_id) JOIN kn USING (doc_id)),
kz AS (SELECT doc_id, term, tf, stop, coalesce(rel * place / (c + freq / rel + dif / rel), 0.0) AS s FROM kr),
kg AS (SELECT doc_id, term AS t1, CAST(NULL AS VARCHAR) AS t2, count(*) AS n FROM kt GROUP BY doc_id, term
  UNION ALL SELECT doc_id, term, r, count(*) FROM kt WHERE r IS NOT NULL GROUP BY doc_id, term, r),
kc AS (SELECT g.doc_id, concat_ws(' ', t1, t2) AS kw, x.s * coalesce(y.s, 1.0) / (n * (1 + (x.s + coalesce(y.s, 0.0)))) AS score
  FROM kg g JOIN kz x ON x.doc_id = g.doc_id AND x.term = t1 LEFT JOIN kz y ON y.doc_id = g.doc_id AND y.term = t2
  WHERE NOT x.stop AND NOT coalesce(y.stop, false)),
kl AS (SELECT doc_id, score, kw, translate(kw, '{_LETTERS[0]}', '{_LETTERS[1]}') AS a FROM kc),
kk(doc_id, k, kept) AS (SELECT DISTINCT doc_id, 0, CAST([] AS STRUCT(score DOUBLE, kw VARCHAR, a VARCHAR)[]) FROM kl
  UNION ALL SELECT kk.doc_id, k + 1, list_append(kept, min({{'score': score, 'kw': kw, 'a': kl.a}})) FROM kk JOIN kl ON kl.doc_id = kk.doc_id
  WHERE k < {top} AND len(list_filter(kept, lambda x: 1 - levenshtein(x.a, kl.a) / greatest(length(x.a), length(kl.a)) > {dedup_lim})) = 0
  GROUP BY kk.doc_id, k, kept),
kw AS (SELECT doc_id, arg_max(kept, k) AS kept FROM kk GROUP BY doc_id)"""


@query("keywords_topk", ids="C5 C9", oracle=f"""WITH RECURSIVE {keywords_sql("SELECT doc_id, text FROM documents")},
u AS (SELECT doc_id, unnest(kept) AS x, generate_subscripts(kept, 1) AS rank FROM kw)
SELECT doc_id, rank, x.kw AS keyword, round(x.score, 6) AS score FROM u""")
def keywords_topk(spark, sf):
    """Top-5 keywords (n-grams up to 2, dedup limit 0.2) of every document."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    kw = K.extract_keywords(docs)
    return kw.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "keyword", F.round("score", 6).alias("score"))


@query("keyword_term_stats", ids="C5", oracle=r"""
WITH a AS (SELECT doc_id, regexp_split_to_array(text, '[.!?]+[\t\n\x0B\f\r ]+|[\r\n]+') AS arr FROM documents),
s AS (SELECT doc_id, unnest(arr) AS stext, generate_subscripts(arr, 1) - 1 AS sent FROM a),
w AS (SELECT doc_id, sent, unnest(regexp_split_to_array(stext, '[^\p{L}\p{N}]+')) AS word FROM s),
t AS (SELECT doc_id, sent, lower(word) AS term FROM w WHERE word <> ''),
ns AS (SELECT doc_id, max(sent) + 1 AS n_sent FROM t GROUP BY doc_id)
SELECT t.doc_id, term, count(*) AS tf, count(DISTINCT sent) AS n_sent_term, min(sent) AS first_sent, ns.n_sent
FROM t JOIN ns USING (doc_id) GROUP BY t.doc_id, term, ns.n_sent""")
def keyword_term_stats(spark, sf):
    """The per-(document, term) statistics stage of C5, checked value by value."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    st = K.term_stats(docs)
    return st.select("doc_id", "term", "tf", "n_sent_term", F.col("first_sent").cast("bigint").alias("first_sent"),
                     F.col("n_sent").cast("bigint").alias("n_sent"))
