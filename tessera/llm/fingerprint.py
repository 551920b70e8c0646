"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch retains every hashed shingle below a fixed fraction of the hash range. Sketches of parts can be merged
(union) and their overlap estimates Jaccard likeness and containment, however unequal the documents are.

Shingles are ``SHINGLE`` words (all words, if a text has fewer). A text whose hashes all lie above the threshold
retains its least hash, so that short texts can be told apart; a text without words has the empty sketch.

Defined results: null texts are empty; empty sketches are alike (1) and unlike any other (0); rows are ordered by id, then
text, a null id last; repeated rows follow each other and are each other's next; a single row is its own next;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, prepare, stored

SHINGLE = 5
FRACTION = 0.25
#: documents per range of ids, id quantiles that cut the ranges, and the most ranges there are
RANGE_DOCS = 2000
QUANTILES = 64
MAX_RANGES = 100_000


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Add the sketch of column ``text`` as a sorted array of hashes."""
    most = -(1 << 63) + int(fraction * (1 << 64))
    n = F.size("__words")
    last = F.greatest(n - shingle, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col("__words"), i + k) for k in range(shingle)]))
    df = df.withColumn("__words", word_hashes(F.col(text)))
    # a missing word leaves the hash as it is: a short text has one shingle of all its words
    df = df.withColumn("__all", F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))).drop("__words")
    df = df.withColumn("__low", F.sort_array(F.array_distinct(F.filter("__all", lambda h: h < most))))
    least = F.when(F.size("__all") > 0, F.array(F.array_min("__all"))).otherwise(F.col("__low"))
    return df.withColumn(out, F.when(F.size("__low") > 0, F.col("__low")).otherwise(least)).drop("__all", "__low")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def merged(a: Column, b: Column) -> Column:
    """Sketch of two texts' shingles together."""
    return F.sort_array(F.array_union(a, b))


def as_text(sketch: Column) -> Column:
    return F.concat_ws(",", F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def with_next(rows: DataFrame, key: str, *cols: str, range_docs: int = RANGE_DOCS) -> DataFrame:
    """Add ``next_<col>`` from the next row in ascending (key, cols), the first row's after the last.

    Rows are dealt to ranges of the key: id quantiles, cut evenly in between. Each range is its own window; the
    first rows of a range are also sent to the range before it. Only one row per range (at most MAX_RANGES) is broadcast.
    """
    n, marks = rows.agg(F.count(F.lit(1)), F.percentile_approx(key, [i / QUANTILES for i in range(QUANTILES + 1)], 1000)).first()
    if not n:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in cols])
    sub = max(1, min(-(-n // (QUANTILES * range_docs)), MAX_RANGES // QUANTILES))
    edges = sorted(set(marks))
    bounds = F.array(*[F.lit(x).cast("bigint") for x in edges])
    slot = F.greatest(F.size(F.filter(bounds, lambda b: b <= F.col(key))), F.lit(1))
    low, high = F.get(bounds, F.col("__q") - 1).cast("double"), F.coalesce(F.get(bounds, F.col("__q")).cast("double"), F.lit(float(edges[-1]) + 1))
    inner = F.floor((F.col(key).cast("double") - low) * sub / F.greatest(high - low, F.lit(1.0)))
    dealt = rows.withColumn("__q", slot).withColumn("__range", F.col("__q").cast("bigint") * sub + F.greatest(F.least(inner, F.lit(sub - 1)), F.lit(0))).drop("__q")
    firsts = stored(dealt.groupBy("__range").agg(F.min(key).alias("__first")), "firsts")
    one = Window.orderBy("__range")  # one row per range, at most MAX_RANGES of them
    before = firsts.select("__first", F.coalesce(F.lag("__range").over(one), F.max("__range").over(Window.partitionBy(F.lit(1)))).alias("__before"))
    sent = dealt.join(F.broadcast(before), F.col(key) == F.col("__first"), "left").withColumn("__at", F.explode(F.array_compact(F.array(
        F.struct(F.col("__range").alias("range"), F.lit(0).alias("lap")),
        F.when(F.col("__before").isNotNull(), F.struct(F.col("__before").alias("range"), F.lit(1).alias("lap")))))))
    order = Window.partitionBy("__at.range").orderBy("__at.lap", key, *cols)
    ahead = sent.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in cols])
    return ahead.filter(F.col("__at.lap") == 0).drop("__at", "__range", "__first", "__before")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, text, sketch, next_text, next_sketch, edited, edited_sketch.

    The edited text replaces the last quarter of the characters by as many of the next document's first ones.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).cast("bigint"))
    rows = with_next(with_sketch(rows, "text", "sketch", shingle, fraction), "key", "text", "sketch")
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("quarter", F.floor(F.col("n_chars") / 4).cast("int"))
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("quarter"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), F.col("quarter"))))
    return with_sketch(rows, "edited", "edited_sketch", shingle, fraction).drop("key", "quarter")
