"""F: matching question keywords to column values.

Substring branch (exact, no pairwise comparison): the distinct keywords are
broadcast in size-checked blocks as an Aho-Corasick automaton and every
distinct value is scanned once, in ``mapInPandas``; all occurrences,
overlapping ones included, are reported, so no match is lost.

Ratio branch: only pairs that pass the exact length bound
``2 * min(la, lb) / (la + lb) >= threshold`` are generated (an equi-join on
the allowed value lengths) and scored with the Ratcliff-Obershelp ratio in an
Arrow-batched pandas UDF.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUNCT_OR_SPACE = "[\\p{Punct} ]"
# Bytes of distinct keywords broadcast per scan block.
MAX_KEYWORD_BYTES = 16 * 1024 * 1024


def normalise(c: Column) -> Column:
    """lower case, ASCII punctuation and spaces removed."""
    return F.regexp_replace(F.lower(c), PUNCT_OR_SPACE, "")


def value_dictionary(frames: dict[str, DataFrame]) -> DataFrame:
    """(table, column, v) distinct normalised non-null values of every string column."""
    parts = []
    for t, df in frames.items():
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not cols:
            continue
        u = df.select(*cols).unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
        parts.append(u.select(F.lit(t).alias("table"), "column", normalise(F.col("value")).alias("v")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("v") != "").distinct()


def _scan_partition(blocks_bc, block: int):
    """Executor side: one Aho-Corasick automaton per keyword block, reused across batches."""
    def run(it):
        import ahocorasick

        keys = blocks_bc.value[block]
        auto = ahocorasick.Automaton()
        for k in keys:
            auto.add_word(k, k)
        auto.make_automaton()
        for pdf in it:
            rows = []
            for t, c, v in zip(pdf["table"], pdf["column"], pdf["v"]):
                found = {k for _, k in auto.iter(v)} if v else ()
                rows.extend((t, c, v, k) for k in found)
            yield pd.DataFrame(rows, columns=["table", "column", "v", "k"])
    return run


def substring_matches(keywords: DataFrame, values: DataFrame,
                      max_broadcast_bytes: int = MAX_KEYWORD_BYTES) -> DataFrame:
    """(keyword, k, table, column, v) where the normalised keyword k occurs in the value v.

    The distinct normalised keywords are cut into blocks of at most
    ``max_broadcast_bytes`` (size checked on the executors first); each block
    is broadcast and every value is scanned once per block by an Aho-Corasick
    automaton, which reports every (also overlapping) keyword occurrence.
    """
    spark = values.sparkSession
    kw = keywords.select("keyword", "k").where(F.length("k") > 0)
    ks = kw.select("k").distinct()
    st = ks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("k") + 16).alias("bytes")).first()
    if not st["n"]:
        return spark.createDataFrame([], "keyword string, k string, table string, column string, v string")
    n_blocks = max(1, -(-int(st["bytes"]) // max_broadcast_bytes))
    blocks = [[] for _ in range(n_blocks)]
    parts = []
    for b in range(n_blocks):
        blk = ks if n_blocks == 1 else ks.where(F.pmod(F.xxhash64("k"), F.lit(n_blocks)) == b)
        blocks[b] = [r[0] for r in blk.collect()]  # at most max_broadcast_bytes
    bc = spark.sparkContext.broadcast(blocks)
    vals = values.select("table", "column", "v")
    for b in range(n_blocks):
        parts.append(vals.mapInPandas(_scan_partition(bc, b), "table string, column string, v string, k string"))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return hits.join(kw, "k").select("keyword", "k", "table", "column", "v")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity (Python's SequenceMatcher ratio)."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def ratio_matches(keywords: DataFrame, values: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(keyword, table, column, v, score) with ratio >= threshold among length-compatible pairs."""
    kw = keywords.select("keyword", "k", F.length("k").alias("lk")).where(F.col("lk") > 0)
    # allowed value lengths: 2*min/(lk+lv) >= t  <=>  lk*t/(2-t) <= lv <= lk*(2-t)/t
    lo = F.ceil(F.col("lk") * threshold / (2 - threshold) - 1e-9).cast("int")
    hi = F.floor(F.col("lk") * (2 - threshold) / threshold + 1e-9).cast("int")
    kl = kw.select("keyword", "k", "lk", F.explode(F.sequence(F.greatest(lo, F.lit(1)), hi)).alias("lv"))
    vals = values.select("table", "column", "v", F.length("v").alias("lv"))
    cand = kl.join(vals, "lv").where(~F.col("v").contains(F.col("k")))
    scored = cand.withColumn("score", ratio(F.col("k"), F.col("v")))
    return scored.where(F.col("score") >= threshold).select("keyword", "k", "table", "column", "v", "score")


def best_columns(keywords: DataFrame, values: DataFrame, threshold: float = 0.8, top: int = 5,
                 with_ratio: bool = True) -> DataFrame:
    """per keyword the best ``top`` columns (best score per column, ties by name)."""
    hits = substring_matches(keywords, values).withColumn("score", F.lit(1.0))
    if with_ratio:
        hits = hits.unionByName(ratio_matches(keywords, values, threshold))
    best = hits.groupBy("keyword", "table", "column").agg(F.max("score").alias("score"))
    w = Window.partitionBy("keyword").orderBy(F.desc("score"), "table", "column")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def question_keywords(frames: dict[str, DataFrame], sources: list[tuple[str, str]]) -> DataFrame:
    """Keywords = distinct words of the given text columns, with their normalised form."""
    parts = [frames[t].select(F.explode(F.split(F.lower(F.col(c)), " +")).alias("keyword")) for t, c in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(F.col("keyword") != "").distinct()
    return out.select("keyword", normalise(F.col("keyword")).alias("k")).where(F.col("k") != "")

