"""Ranked lexical search for many items at once, with common subexpressions evaluated once.

An item's score for a document is a sum of integer term contributions, so a sum over a set of terms that several items
share is the same number for all of them. The terms of a block of items are mined for such shared sets: in rounds, every
node (a term, or a sum found before) is paired with the node it shares most items with, if that choice is mutual; the
pair becomes a node of its own and takes the pair's place in the items that hold both. The result is a DAG: leaves are
terms, inner nodes partial document accumulators that several items or nodes share, roots the items. It is evaluated for a
block of documents at a time, every accumulator once (a vector over the documents), level by level; each task keeps
the ``k`` best documents of each item.

On Spark: one scan of the texts writes a forward table (document, number of terms, item terms with their counts) without
a shuffle; its sums are N, L and the document frequencies. A second job scores it by task and sends on at most k rows
per item and task, which are ranked in two steps. Items come in blocks of about ``BLOCK_TERMS`` (item, term) pairs; what
the driver sees is one block's DAG and statistics at a time.

Defined results: a null or empty text, or one without a term, has no score; an item without terms, or that meets no
document with a score above 0, returns no rows; rows with the same item id are one item (their terms together), also
under a null id; repeated documents rank one after the other; documents without id come last among equal scores; further
columns are ignored; empty tables give an empty result. Ids of documents are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import give_back, prepare, stored, temp, text_buffer
from tessera.llm.lexis import ranges, runs, same, words_of

K = 50
#: (item, term) pairs that are searched for together
BLOCK_TERMS = 1 << 16
#: nodes that one round of mining compares; those in most items come first
MINED = 4096
#: numbers held for one block of documents
CELLS = 1 << 22
#: groups of tasks whose best documents are ranked first
GROUPS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"


class Dag(NamedTuple):
    """Nodes 0 to terms - 1 are terms; ``levels`` hold (left, right) of the next nodes in turn; ``items`` the nodes that an item adds up."""
    terms: int
    levels: list[tuple[np.ndarray, np.ndarray]]
    items: list[np.ndarray]

    def sums(self) -> int:
        """Additions of document vectors that one evaluation needs."""
        return sum(len(left) for left, _ in self.levels) + sum(max(0, len(i) - 1) for i in self.items)


def mine(items: list[list[int]], terms: int, mined: int = MINED) -> Dag:
    """Find term sets that items share, and how sums over them build on each other."""
    holds = np.zeros((terms, len(items)), bool)
    for i, some in enumerate(items):
        holds[some, i] = True
    node = np.arange(terms)
    levels, made = [], terms
    while True:
        count = holds.sum(1)
        busy = np.flatnonzero(count > 1)
        busy = np.sort(busy[np.argsort(-count[busy], kind="stable")[:mined]])
        if len(busy) < 2:
            break
        part = holds[busy].astype(np.float32)
        shared = part @ part.T
        np.fill_diagonal(shared, 0)
        best = shared.argmax(1)
        here = np.arange(len(busy))
        pick = np.flatnonzero((shared[here, best] > 1) & (best[best] == here) & (here < best))
        if not len(pick):
            break
        left, right = busy[pick], busy[best[pick]]
        both = holds[left] & holds[right]
        levels.append((node[left], node[right]))
        holds[left] &= ~both
        holds[right] &= ~both
        holds = np.concatenate([holds, both])
        node = np.concatenate([node, np.arange(made, made + len(pick))])
        made += len(pick)
        kept = holds.any(1)
        holds, node = holds[kept], node[kept]
    return Dag(terms, levels, [node[holds[:, i]] for i in range(len(items))])


def evaluate(dag: Dag, leaves: np.ndarray) -> np.ndarray:
    """Scores (items x documents) from the contributions (terms x documents)."""
    made = sum(len(left) for left, _ in dag.levels)
    sums = np.empty((dag.terms + made, leaves.shape[1]), np.int64)
    sums[:dag.terms] = leaves
    at = dag.terms
    for left, right in dag.levels:
        np.add(sums[left], sums[right], out=sums[at:at + len(left)])
        at += len(left)
    out = np.zeros((len(dag.items), leaves.shape[1]), np.int64)
    for i, nodes in enumerate(dag.items):
        for x in nodes:
            out[i] += sums[x]
    return out


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, terms: the distinct terms of every item that has any."""
    found = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(id_col).alias("item"), F.explode(found).alias("term")).groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def plans(items: DataFrame, block_terms: int = BLOCK_TERMS) -> tuple[DataFrame, int]:
    """A written table with one row per block of items (its DAG), and the number of blocks."""
    pairs = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-pairs // block_terms)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        terms = sorted({t for some in rows["terms"] for t in some})
        number = {t: i for i, t in enumerate(terms)}
        dag = mine([[number[t] for t in some] for some in rows["terms"]], len(terms))
        return pd.DataFrame([{"block": rows["block"].iloc[0], "terms": terms, "item": list(rows["item"]), "left": [x.tolist() for x, _ in dag.levels],
                              "right": [x.tolist() for _, x in dag.levels], "items": [x.tolist() for x in dag.items]}])

    dealt = items.select(F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))).alias("block"), F.col("item").cast("string").alias("item"), "terms")
    schema = "block bigint, terms array<string>, item array<string>, left array<array<int>>, right array<array<int>>, items array<array<int>>"
    return stored(dealt.groupBy("block").applyInPandas(run, schema), "plans"), blocks


def forward(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, term, tf: of every document the number of all its terms, and its terms among ``terms`` (their numbers, counts)."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = [t.encode() for t in held.value]
        offsets = np.cumsum([0] + [len(t) for t in known])
        wanted = words_of(np.frombuffer(b"".join(known), np.uint8), offsets)
        order = np.argsort(wanted.code, kind="stable")
        codes = wanted.code[order]
        for part in texts:
            data, cuts = text_buffer(part)
            n, size = np.zeros(len(part), np.int64), max(1, len(known))
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in runs(data, cuts):
                n += np.bincount(text.row, minlength=len(n))
                of, hit = ranges(np.searchsorted(codes, text.code), np.searchsorted(codes, text.code, "right"))
                hit = order[hit]
                equal = same(text, of, wanted, hit)
                key, count = np.unique(text.row[of[equal]] * size + wanted.row[hit[equal]], return_counts=True)
                keys.append(key)
                counts.append(count)
            key, back = np.unique(np.concatenate(keys), return_inverse=True)  # a long text comes in several parts
            tf = np.zeros(len(key), np.int64)
            np.add.at(tf, back, np.concatenate(counts))
            at = pa.array(np.searchsorted(key // size, np.arange(len(n) + 1)), pa.int32())
            yield pa.StructArray.from_arrays([pa.array(n), pa.ListArray.from_arrays(at, pa.array(key % size, pa.int32())),
                                              pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], ["n", "term", "tf"])
        give_back()

    got = temp("forward")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.arrow_udf(run, "n bigint, term array<int>, tf array<bigint>")(F.col(text_col)).alias(got))
    return rows.select("id", F.col(got)["n"].alias("n"), F.col(got)["term"].alias("term"), F.col(got)["tf"].alias("tf"))


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of every term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Best:
    """The k best documents of every item so far, equal scores by ascending id, those without id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        least = self.floor
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        item, doc = np.nonzero(scores >= least[:, None])
        new = [item, scores[item, doc], ids[doc], missing[doc]]
        item, score, doc_id, none = (np.concatenate(x) for x in zip(self.kept, new))
        order = np.lexsort((doc_id, none, -score, item))
        sorted_items = item[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_items, sorted_items)
        self.kept = [x[order[rank < self.k]] for x in (item, score, doc_id, none)]
        # a later document with the least kept score may still come in by a smaller id
        last = order[rank == self.k - 1]
        self.floor[item[last]] = score[last]


def search_block(rows: DataFrame, plan, k: int) -> DataFrame:
    """number (of the item in the block), id, score, part: each task's k best documents of each item."""
    n_docs, length = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    df = np.zeros(len(plan["terms"]), np.int64)
    for r in rows.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # one row per term of the block
        df[r["term"]] = r["count"]
    dag = Dag(len(plan["terms"]), [(np.array(x), np.array(y)) for x, y in zip(plan["left"], plan["right"])], [np.array(x, np.int64) for x in plan["items"]])
    held = rows.sparkSession.sparkContext.broadcast((dag, weights(n_docs, df), n_docs, length or 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dag, weight, n_docs, length = held.value
        step = max(16, CELLS // (dag.terms + sum(len(x) for x, _ in dag.levels) + len(dag.items)))
        best, part = Best(len(dag.items), k), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(4)[0].as_py()
            column = batch.column(0)
            ids = np.asarray(column.fill_null(0))
            missing = np.asarray(column.is_null()).astype(np.int64)
            n = np.asarray(batch.column(1))
            m = 100 - 50 + (50 * n * n_docs) // max(1, length)
            cuts = batch.column(2).offsets.to_numpy()
            cuts = cuts - cuts[0]
            term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            doc = np.repeat(np.arange(len(n)), np.diff(cuts))
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            for a in range(0, len(n), step):
                b = min(len(n), a + step)
                some = slice(cuts[a], cuts[b])
                leaves = np.zeros((dag.terms, b - a), np.int64)
                leaves[term[some], doc[some] - a] = value[some]
                best.add(evaluate(dag, leaves), ids[a:b], missing[a:b])
        item, score, doc_id, none = best.kept
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64()),
                                          pa.array(np.full(len(item), part), pa.int64())], names=["number", "id", "score", "part"])
        give_back()

    task = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).cast("bigint")
    return rows.select("id", "n", "term", "tf", task.alias("part")).mapInArrow(run, "number bigint, id bigint, score bigint, part bigint")


def ranked(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 of every item."""
    spark = docs.sparkSession
    prepare(spark)
    kind = items.schema[item_col].dataType
    table, blocks = plans(item_terms(items, item_col, item_text_col), block_terms)
    found = []
    for block in range(blocks):
        plan = table.filter(F.col("block") == block).first()  # one block: bounded by block_terms
        if plan is None:
            continue
        rows = stored(forward(docs, plan["terms"], id_col, text_col), "forward")
        best = ranked(ranked(search_block(rows, plan, k), ["number", "part"], k).drop("rank"), ["number"], k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(plan["item"])], "number bigint, item string")
        named = best.join(F.broadcast(names), "number")  # one row per item of the block
        found.append(stored(named.select(F.col("item").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"),
                                         F.col("id").alias("doc_id"), "score"), "ranked"))
    if not found:
        return docs.filter("false").select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"),
                                           F.lit(0).cast("bigint").alias("score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
