"""Spelling variants of corpus words: asymmetric q-chunks, shift-bounded join, verification.

Two words are near if one edit (an inserted, deleted or replaced code point) parts them. Of such a pair the word that is not
longer contributes two disjoint chunks, its halves; the other contributes its positional grams of the halves' sizes.
One edit leaves a chunk whole, and the other word holds it as a gram in the same place, or one later if it is longer and the
edit lies before the chunk: of all its grams only those two places can meet a chunk, so only they are written. What
the chunk leaves of the word holds the edit, and of its two halves again one is spared; it is part of the join key,
so that a frequent chunk ("inter", "ation") makes no long list. Pairs that meet are verified by their edit distance, once
each, and never leave the join otherwise.

On Spark: words are counted by a partial aggregation, keys are twelve rows a word, the join is an equi-join on 64-bit
keys that adaptive execution may split. A word has at most a few thousand near words (its alphabet has about 90 letters).
Roots are found by pointer doubling; as the count of a form is a multiple of its word's, the number of steps is known
from the largest count.

Defined results: null and empty texts have no words; a null id counts as an empty one where the id enters; rows that repeat
count each; a word without near words has no form and is its own root; further columns are ignored; no words, no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, stored

#: code points of a word, occurrences of a word, and how many times more frequent a form is
MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: one in so many (document, word) pairs loses a letter
SLIP = 199
LETTER = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = 4


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """word, n: the words of at least ``min_length`` code points that occur at least ``min_count`` times.

    A run of letters whose hash with the document's id is divisible by ``slip`` loses one letter, chosen by that hash.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(f"({LETTER}{{{min_length},}})"), F.lit(0))
    # outer: the optimizer would otherwise search every text twice, first for whether it holds any run
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode_outer(found).alias("run")).where(F.col("run").isNotNull())
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % slip == 0, less).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _spared(number: int, size: Column) -> tuple[Column, Column]:
    """Letters at the head and at the tail that key ``number`` of a chunk word of ``size`` letters fixes.

    Keys 0 and 1 hold the first half and a half of the rest, keys 2 and 3 the last half and a half of the rest.
    """
    half = F.floor(size / 2).cast("int")
    rest = size - half
    none = F.lit(0)
    return ((half + F.floor(rest / 2).cast("int"), none), (half, rest - F.floor(rest / 2).cast("int")),
            (F.floor(half / 2).cast("int"), rest), (none, size - F.floor(half / 2).cast("int")))[number]


def _key(word: Column, number: int, size: Column) -> Column:
    """Key ``number`` of a word against chunk words of ``size`` letters: head and tail as they must agree."""
    head, tail = _spared(number, size)
    # a tail counts from the word's end: in a word that is one longer its grams stand one place later
    return F.concat(F.substring(word, F.lit(1), head), F.substring(word, F.length(word) - tail + 1, tail))


def _keys(word: Column, size: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), size, _key(word, i, size)).alias("key")) for i in range(KEYS)])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every pair of near words once, a shorter than b or before it in code-point order."""
    word, size = F.col("word"), F.length("word")
    chunks = words.select("word", "n", F.explode(_keys(word, size)).alias("k")).select(F.col("word").alias("a"), F.col("n").alias("a_n"), "k.*")
    grams = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("size"))
    grams = grams.select("word", "n", F.explode(_keys(word, F.col("size"))).alias("k")).select(F.col("word").alias("b"), F.col("n").alias("b_n"), "k.*")
    met = chunks.join(grams, ["key", "i"])
    a, b, size = F.col("a"), F.col("b"), F.length("a")
    met = met.filter(((size < F.length("b")) | (a < b)) & (F.levenshtein(a, b, 1) == 1))
    earlier = reduce(lambda x, y: x | y, [(F.col("i") > i) & (_key(a, i, size) == _key(b, i, size)) for i in range(KEYS - 1)])
    return met.filter(~earlier).select("a", "a_n", "b", "b_n")  # pairs that several keys bring together stay once


def roots(links: DataFrame, largest: int, factor: int = FACTOR) -> DataFrame:
    """word, root of every word that has a form: the end of its chain of forms, by pointer doubling."""
    at = links.select("word", F.col("form").alias("root"))
    hops = 1
    deepest = max(1, math.ceil(math.log(max(largest, 2), factor)))
    while hops < deepest:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        at = stored(at.join(on, at["root"] == on["via"], "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        hops *= 2
    return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
             factor: int = FACTOR, slip: int = SLIP) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word with its dominant spelling, see the module."""
    prepare(docs.sparkSession)
    words = stored(word_counts(docs, id_col, text_col, min_length, min_count, slip), "words")
    pairs = stored(near_pairs(words), "near")
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    near = near.join(words, "word", "right").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                                                    F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    wins = F.col("near_n") >= factor * F.col("n")
    rows = stored(near.select("word", "n", "n_near", F.when(wins, F.col("near")).alias("form"), F.when(wins, F.col("near_n")).alias("form_n")), "forms")
    largest = words.agg(F.max("n")).first()[0] or 0
    ends = roots(rows.filter(F.col("form").isNotNull()), largest, factor)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
