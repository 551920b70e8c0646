"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each document draws an exponential key, -ln(u) / weight, where u comes from a hash of the document and
the weight from its quality; the smallest keys of a source are a weighted sample without replacement.
A source's word budget first pays for whole epochs; what is left is spent on documents in key order,
found by prefix sums: sizes per (source, key range) first, then inside the one range where the budget ends.

Defined results: a null text has size 0; null is a source of its own, last in the order; a null id is
like any other; repeated rows share one key and are taken alike; documents of size 0 are taken 0 words; an empty
table gives an empty result. Columns of the input are kept by ``mix`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, prepare, stored, temp

#: weights of the sources in code point order, repeating
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: documents per key range
RANGE_DOCS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of letters among the characters that are not white space (0.1 for a text without any)."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    shown = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    return F.lit(0.1) + F.lit(0.9) * F.coalesce(F.when(shown > 0, letters / shown), F.lit(0.0))


def sample_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """Exponential key: -ln(u) / weight with u in (0, 1) from the document's hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), doc_id, text), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, docs, ...) plus target: ``share`` of all sizes dealt by weight, at most ``most`` times a source's size.

    Raising a common level until the capped shares add up is the same as re-dealing the excess: a source is
    capped when ``most * size <= level * weight``. Each step sums over the sources (one row each) and
    fetches two numbers; capped sources stay capped, so it ends.
    """
    n = temp("n")
    names = sources.select("source").orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row per source, not per document
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col(n), F.lit(len(weights))))
    names = names.select("source", rank.alias(n)).select("source", w.alias("w"))
    table = stored(sources.join(names, sources["source"].eqNullSafe(names["source"])).select(sources["*"], names["w"]), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(most)
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else cap <= F.lit(level) * F.col("w")
        spent, open_w, count = table.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("w"))), F.count_if(full)).first()
        if count == capped or not open_w:
            break
        capped, level = count, (share * total - (spent or 0.0)) / open_w
    goal = cap if not open_w else F.least(cap, F.lit(level) * F.col("w"))
    return table.withColumn("target", goal.cast("double")).drop("w")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        share: float = SHARE, most: float = MOST_EPOCHS, seed: int = 1, size: Column | None = None,
        weight: Column | None = None, range_docs: int = RANGE_DOCS) -> tuple[DataFrame, dict[str, str]]:
    """The input's rows and columns plus size, source_size, target and copies (times taken), under the names returned."""
    prepare(docs.sparkSession)
    out = {k: temp(k) for k in ("size", "source_size", "target", "copies")}
    doc, text = F.col(id_col), F.col(text_col)
    size = word_count(text) if size is None else size
    key = sample_key(doc, text, quality_weight(text) if weight is None else weight, seed)
    drawn = stored(docs.select(F.col(source_col).alias("source"), size.alias("size"), key.alias("key")), "drawn")
    # of unit exponentials, 1 - exp(-key) is uniform: scaled by the source's mean key, equal ranges of it hold about equally many
    sources = drawn.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"), F.avg("key").alias("mean"))
    goals = source_targets(sources, weights, share, most)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goals = stored(goals, "goals")
    by = goals.select(F.col("source").alias("s"), "docs", "mean", "rest")
    share_of = F.floor((1 - F.exp(-F.col("key") / F.col("mean"))) * F.ceil(F.col("docs") / range_docs)).cast("bigint")
    placed = drawn.join(by, F.col("source").eqNullSafe(F.col("s"))).withColumn("range", share_of)
    sums = placed.groupBy("s", "range").agg(F.sum("size").alias("n"), F.max("rest").alias("rest"))
    upto = sums.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("range")) - F.col("n"))
    last = upto.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    last = last.select(F.col("s").alias("s2"), F.col("range").alias("range2"), "before")
    inside = placed.join(last, F.col("s").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("range2")))
    run = F.sum("size").over(Window.partitionBy("s").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # a document that crosses the budget's end is taken when that comes nearer to it
    chosen = inside.withColumn("sum", F.col("before") + run).withColumn(
        "in", F.col("sum") - F.col("size") / 2 <= F.col("rest"))
    # every key below the cut is in: the first key left out, or just beyond the range's last key
    cut = chosen.groupBy("s").agg(F.min(F.when(~F.col("in"), F.col("key"))).alias("out"), F.max("key").alias("top"))
    cut = cut.select(F.col("s").alias("s3"), F.coalesce("out", F.col("top") * (1 + 1e-15)).alias("cut"))
    goals = goals.join(cut, F.col("source").eqNullSafe(F.col("s3")), "left")
    cut_at = F.coalesce("cut", F.when(F.col("rest") > 0, float("inf")).otherwise(-1.0))  # no range holds the end: all or nothing
    name = {c: temp(c) for c in ("source", "epochs", "cut", "key")}
    small = stored(goals.select(F.col("source").alias(name["source"]), F.col("source_size").alias(out["source_size"]), F.col("target").alias(out["target"]),
                                F.col("epochs").alias(name["epochs"]), cut_at.alias(name["cut"])), "cuts")
    rows = docs.withColumn(out["size"], size).withColumn(name["key"], key)
    joined = rows.join(small, rows[source_col].eqNullSafe(small[name["source"]]))
    copies = F.col(name["epochs"]) + (F.col(name["key"]) < F.col(name["cut"])).cast("bigint")
    got = joined.withColumn(out["copies"], F.when(F.col(out["size"]) > 0, copies).otherwise(F.greatest(F.col(name["epochs"]), F.lit(0))))
    return got.select(*docs.columns, *out.values()), out
