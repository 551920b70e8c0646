"""Statistical keyword extraction (after the published YAKE method), folded inside the row of a document.

A document is one row, so nothing has to be shuffled: sentences and words become an array of tokens with positions;
sorted by term it falls into one run per term, from which the term's features come; the scores go back to the tokens,
which sorted by position give the candidate n-grams (n <= 2), sorted by gram their counts. All of it is expressions
over arrays (every step sorts or walks an array once), so the work is linear but for the sorting, and a plan that
extracts keywords has no exchange. Candidates are ranked (lower scores are better) and de-duplicated greedily
with a normalised Levenshtein similarity.

Stated differences to the library: sentences split on . ! ? and line
breaks, words on non-letters; a compact stop-word list per language family;
exact parity with the library is not promised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

SENTENCE_SPLIT = "[.!?]+[\\t\\n\\x0B\\f\\r ]+|[\\r\\n]+"
WORD_SPLIT = "[^\\p{L}\\p{N}]+"

# Stop words (English, French, Spanish, German function words).
STOPWORDS = (
    "a an and are as at be but by for from has have he her his i in is it its of on or she that the their "
    "them they this to was we were which with you not no so if than then there these those what when where "
    "who will would can could do does did been being had our your my me us "
    "le la les un une des du de et en au aux ce ces dans par pour sur avec qui que est pas plus il elle ils "
    "el los las y o con por para del al es son lo se su sus como pero mas "
    "der die das ein eine und oder mit von zu im ist nicht den dem des sich auf auch fur"
).split()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    The value is the outcome of folding nothing: transform would copy it and all that it holds, words included.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def _runs(rows: Column, same: Callable[[Column, Column], Column]) -> Column:
    """A sorted array cut into arrays of neighbours that are the ``same``."""
    n = F.size(rows)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                                    lambda i: F.when(i == 0, F.lit(True)).otherwise(~same(F.get(rows, i), F.get(rows, i - 1))))).otherwise(F.array().cast("array<int>"))
    # by index: slice copies the whole array for every run
    run = lambda a, end: F.when(end == a + 1, F.array(F.get(rows, a))).otherwise(F.transform(F.sequence(a, end - 1), lambda i: F.get(rows, i)))
    return _let(starts, lambda at: F.transform(at, lambda a, k: _let(F.coalesce(F.get(at, k + 1), n), lambda end: run(a, end))))


def _tokens(text: Column) -> Column:
    """Array of (lw, sent, wi, left, right, up, acr) in the order of the text."""
    sentences = F.split(F.coalesce(text, F.lit("")), SENTENCE_SPLIT)
    words = F.transform(sentences, lambda s: F.filter(F.transform(F.split(s, WORD_SPLIT), lambda w, i: F.struct(w.alias("w"), F.lower(w).alias("lw"), i.alias("wi"))),
                                                      lambda t: t["w"] != ""))

    def token(ws, sent):
        def one(t, j):
            w = t["w"]
            # a word that begins with a-z, as most do, has neither flag: no case mapping and no pattern for it
            plain = (w >= "a") & (w < "{")
            acr = ~plain & (F.length(w) > 1) & (w == F.upper(w)) & w.rlike("\\p{L}")
            up = ~plain & (t["wi"] > 0) & F.substring(w, 1, 1).rlike("\\p{Lu}") & ~acr
            return F.struct(t["lw"].alias("lw"), sent.alias("sent"), t["wi"].alias("wi"), F.when(j > 0, F.get(ws, j - 1)["lw"]).alias("left"),
                            F.get(ws, j + 1)["lw"].alias("right"), up.alias("up"), acr.alias("acr"))
        return F.transform(ws, one)

    return F.flatten(F.transform(words, token))


def _by_term(tokens: Column) -> Column:
    """Tokens in one array per term, each in the order of the text."""
    return _let(F.sort_array(tokens), lambda s: _runs(s, lambda x, y: x["lw"] == y["lw"]))


def _term(run: Column) -> Column:
    """Features of a term from its tokens; one that occurs once, as most do, needs no arrays."""
    one = F.get(run, F.lit(0))

    def features(tf, up, acr, n_sent, median, n_left, n_right, d_left, d_right):
        whole = lambda x: x.cast("bigint")
        return F.struct(one["lw"].alias("term"), whole(tf).alias("tf"), whole(up).alias("tf_upper"), whole(acr).alias("tf_acronym"), whole(n_sent).alias("n_sent_term"),
                        one["sent"].alias("first_sent"), median.cast("double").alias("median_sent"), whole(n_left).alias("n_left"), whole(n_right).alias("n_right"),
                        whole(d_left).alias("d_left"), whole(d_right).alias("d_right"))

    left_one, right_one = one["left"].isNotNull(), one["right"].isNotNull()
    once = features(F.lit(1), one["up"], one["acr"], F.lit(1), one["sent"], left_one, right_one, left_one, right_one)
    n = F.size(run)
    sents = F.transform(run, lambda t: t["sent"])
    side = lambda name: F.array_compact(F.transform(run, lambda t: t[name]))
    left, right = side("left"), side("right")
    low, high = (F.get(run, i)["sent"] for i in (F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")))
    count = lambda flag: F.size(F.filter(run, lambda t: t[flag]))
    several = features(n, count("up"), count("acr"), F.size(F.array_distinct(sents)), (low + high) / 2, F.size(left), F.size(right),
                       F.size(F.array_distinct(left)), F.size(F.array_distinct(right)))
    return F.when(n == 1, once).otherwise(several)


def term_features(text: Column) -> Column:
    """Array of the features of every term of a text, and the number of sentences: struct(terms, n_sent)."""
    return _let(_tokens(text), lambda t: F.struct(F.transform(_by_term(t), _term).alias("terms"), _sentences(t).alias("n_sent")))


def _sentences(tokens: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(tokens, lambda t: t["sent"])) + 1, F.lit(0))


def _is_stop(term: Column) -> Column:
    return term.isin(*STOPWORDS) | (F.length(term) < 3)


def _scored(terms: Column, n_sent: Column) -> Column:
    """Array of (term, tf, is_stop, s): S(t) from the five features; stop words take no part in the mean."""
    content = F.transform(F.filter(terms, lambda t: ~_is_stop(t["term"])), lambda t: t["tf"].cast("double"))

    def with_mean(tfs):
        mean = F.aggregate(tfs, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(tfs), F.lit(0))
        return _let(mean, lambda m: F.struct(m.alias("mean"), F.sqrt(F.aggregate(tfs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.nullif(F.size(tfs), F.lit(0))).alias("std"),
                                             F.array_max(F.transform(terms, lambda t: t["tf"])).alias("most")))

    def score(t, d):
        case = F.greatest(t["tf_upper"], t["tf_acronym"]) / (1 + F.log(t["tf"]))
        place = F.log(F.log(3 + t["median_sent"]))
        freq = t["tf"] / (d["mean"] + d["std"])
        wl = F.when(t["n_left"] > 0, t["d_left"] / t["n_left"]).otherwise(F.lit(0.0))
        wr = F.when(t["n_right"] > 0, t["d_right"] / t["n_right"]).otherwise(F.lit(0.0))
        spread_over = t["n_sent_term"] / n_sent
        whole = _let(1 + (wl + wr) * t["tf"] / d["most"], lambda rel: rel * place / (case + freq / rel + spread_over / rel))
        return F.struct(t["term"].alias("term"), t["tf"].alias("tf"), _is_stop(t["term"]).alias("is_stop"), F.coalesce(whole, F.lit(0.0)).alias("s"))

    return _let(_let(content, with_mean), lambda d: F.transform(terms, lambda t: score(t, d)))


def _levenshtein_sim(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _candidate(kw: Column, n: Column, prod: Column, total: Column) -> Column:
    return F.struct((prod / (n * (1 + total))).alias("score"), kw.alias("kw"))


def _grams(by_term: Column, scored: Column) -> Column:
    """Candidates (score, kw) of one and two words; none begins or ends with a stop word."""
    single = F.transform(F.filter(scored, lambda t: ~t["is_stop"]), lambda t: _candidate(t["term"], t["tf"], t["s"], t["s"]))
    # scores go back to the tokens, and these into the order of the text
    placed = F.sort_array(F.flatten(F.transform(by_term, lambda run, k: _let(F.get(scored, k), lambda t: F.transform(run, lambda x: F.struct(
        x["sent"].alias("sent"), x["wi"].alias("wi"), x["right"].isNotNull().alias("more"), t["term"].alias("lw"), t["s"].alias("s"), t["is_stop"].alias("stop")))))))

    def pairs(p):
        both = F.transform(p, lambda x, i: _let(F.get(p, i + 1), lambda y: F.when(x["more"] & ~x["stop"] & ~y["stop"], F.struct(
            x["lw"].alias("t1"), y["lw"].alias("t2"), x["s"].alias("s1"), y["s"].alias("s2")))))
        runs = _let(F.sort_array(F.array_compact(both)), lambda s: _runs(s, lambda x, y: (x["t1"] == y["t1"]) & (x["t2"] == y["t2"])))
        return F.transform(runs, lambda r: _let(F.get(r, F.lit(0)), lambda g: _candidate(F.concat_ws(" ", g["t1"], g["t2"]), F.size(r), g["s1"] * g["s2"], g["s1"] + g["s2"])))

    return F.concat(single, _let(placed, pairs))


def keywords(text: Column, top: int = 5, dedup_lim: float = 0.2) -> Column:
    """Array of (score, kw): the best ``top`` candidates of a text, best first; empty for a text without any."""
    def greedy(cand):  # in rank order over all candidates of the document
        return F.aggregate(cand, F.array().cast("array<struct<score:double,kw:string>>"),
                           lambda acc, x: F.when(F.size(acc) >= top, acc).when(
                               F.forall(acc, lambda k: _levenshtein_sim(k["kw"], x["kw"]) <= dedup_lim),
                               F.concat(acc, F.array(x))).otherwise(acc))

    def of_runs(runs, n_sent):
        features = _let(F.transform(runs, _term), lambda terms: _scored(terms, n_sent))
        return _let(features, lambda sc: _let(F.sort_array(_grams(runs, sc)), greedy))

    return _let(_tokens(text), lambda t: _let(_sentences(t), lambda n: _let(_by_term(t), lambda runs: of_runs(runs, n))))


def term_stats(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per (doc, term): tf, upper-case and acronym counts, sentence statistics, context diversity."""
    rows = spread(docs.select(doc_col, text_col)).select(doc_col, term_features(F.col(text_col)).alias("f"))
    # outer: the optimizer would otherwise ask, below the shuffle and once more, whether the computed array is empty
    return rows.select(doc_col, F.explode_outer("f.terms").alias("t"), F.col("f.n_sent").alias("n_sent")).where(F.col("t").isNotNull()).select(doc_col, "t.*", "n_sent")


def term_scores(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, term, tf, is_stop, s): S(t) of every term."""
    rows = spread(docs.select(doc_col, text_col)).select(doc_col, _let(term_features(F.col(text_col)), lambda f: _scored(f["terms"], f["n_sent"])).alias("t"))
    return rows.select(doc_col, F.explode_outer("t").alias("t")).where(F.col("t").isNotNull()).select(doc_col, "t.*")


def extract_keywords(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", top: int = 5, dedup_lim: float = 0.2) -> DataFrame:
    """(doc, rank, keyword, score): the best ``top`` candidates per document, lower score first."""
    rows = spread(docs.select(doc_col, text_col)).select(doc_col, keywords(F.col(text_col), top, dedup_lim).alias("k"))
    return (rows.select(doc_col, F.posexplode_outer("k").alias("rank0", "k")).where(F.col("k").isNotNull())
            .select(doc_col, (F.col("rank0") + 1).alias("rank"), F.col("k.kw").alias("keyword"), F.col("k.score").alias("score")))
