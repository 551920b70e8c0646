"""Exact top-k inner products over a bit-sliced index.

Each block of vectors keeps, per dimension, the high bits of its quantised components as bitmaps (slices) over the
block's rows. A query adds the slices that its own components' bits select, with bitmap arithmetic (carry-save
adders on 64-bit words), which gives bitmaps of every row's sum. From the most significant sum slice
downward the best k rows and a threshold are found; the rows that the dropped low bits leave in doubt are
resolved by exact integer products.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; vectors are compared
only with vectors of the same length; a row with the query's id is the query's own and no candidate, repeated or not;
other repeated rows are candidates each; of different vectors
under one query id the smallest asks; rows with a null id take no part; an empty table gives an empty result; further
columns are ignored. Components must stay below 2**20 after quantising.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare, stored

SCALE = 256
#: rows of an index block and queries of a query block
BLOCK_ROWS = 8192
BLOCK_QUERIES = 128
#: slices kept of a component, and bits of a query component that the bitmap sum uses
SLICES = 5
QUERY_BITS = 4
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
INDEX = "dim int, block bigint, ids binary, codes binary, low binary, bits binary, drop int, slices binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, dim, code array<int>: floor(scale * component) of every vector that takes part."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(sound & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.size(v).alias("dim"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("code"))


def build_block(codes: np.ndarray) -> dict[str, np.ndarray | int]:
    """Slices of the high bits of ``codes`` (rows x dimensions), their lowest values and bit counts."""
    rows, dim = codes.shape
    low = codes.min(0)
    up = (codes - low).astype(np.int64)
    bits = np.array([int(x).bit_length() for x in up.max(0)], np.int64)
    drop = max(0, int(bits.max()) - SLICES)
    words = -(-rows // 64)
    slices = np.zeros((dim, SLICES, words), np.uint64)
    for c in range(SLICES):
        on = np.zeros((dim, words * 64), np.uint8)
        on[:, :rows] = (up.T >> (drop + c)) & 1
        slices[:, c] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)
    return {"low": low.astype(np.int64), "bits": bits, "drop": drop, "slices": slices}


def _index(vectors: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    n = vectors.count()
    blocks = max(1, -(-n // block_rows))

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        ids = table.column("id").to_numpy()[order].astype(np.int64)
        codes = table.column("code").combine_chunks().flatten().to_numpy().astype(np.int32).reshape(-1, dim)[order]
        b = build_block(codes)
        row = {"dim": dim, "block": table.column("block")[0].as_py(), "ids": ids.tobytes(), "codes": codes.tobytes(), "low": b["low"].tobytes(),
               "bits": b["bits"].tobytes(), "drop": b["drop"], "slices": b["slices"].tobytes()}
        return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()))})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return stored(dealt.groupBy("dim", "block").applyInArrow(run, INDEX), "bitslices"), blocks


def sum_slices(parts: list[list[np.ndarray]]) -> np.ndarray:
    """Add bitmaps by place: ``parts[w]`` holds arrays (n x words) of weight 2**w; the result has one bitmap per place."""
    out, w, words = [], 0, next(a.shape[-1] for p in parts for a in p)
    carry: list[np.ndarray] = []
    while w < len(parts) or carry:
        own = (parts[w] if w < len(parts) else []) + carry
        carry = []
        rows = np.concatenate(own) if own else np.zeros((0, words), np.uint64)
        while len(rows) >= 3:  # three bitmaps of one place make one of it and one of the next
            k = len(rows) // 3
            a, b, c = rows[:k], rows[k:2 * k], rows[2 * k:3 * k]
            odd = a ^ b
            carry.append((a & b) | (c & odd))
            rows = np.concatenate([odd ^ c, rows[3 * k:]])
        if len(rows) == 2:
            carry.append((rows[0] & rows[1])[None])
            rows = (rows[0] ^ rows[1])[None]
        out.append(rows[0] if len(rows) else np.zeros(words, np.uint64))
        w += 1
    return np.stack(out)


def _ones(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(slices: np.ndarray, alive: np.ndarray, k: int) -> int:
    """The k-th largest sum among ``alive`` rows (or the least, if fewer), from the most significant slice downward."""
    k = min(k, _ones(alive))
    sure, tied, value = 0, alive, 0
    for w in range(len(slices) - 1, -1, -1):
        on = tied & slices[w]
        n = _ones(on)
        if sure + n >= k:  # enough rows have this bit: the k-th has it too
            tied, value = on, value | 1 << w
        else:
            sure, tied = sure + n, tied & ~slices[w]
    return value


def at_least(slices: np.ndarray, alive: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of the alive rows whose sum is ``value`` or more."""
    if value <= 0:
        return alive
    if value >> len(slices):
        return np.zeros_like(alive)
    more, same = np.zeros_like(alive), alive
    for w in range(len(slices) - 1, -1, -1):
        if value >> w & 1:
            same = same & slices[w]
        else:
            more |= same & slices[w]
            same = same & ~slices[w]
    return more | same


def search_block(query: np.ndarray, own: int, ids: np.ndarray, codes: np.ndarray, block: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the block's k best rows for one query, ties to the smaller id."""
    rows, words = len(ids), block["slices"].shape[-1]
    live = np.zeros(words * 64, np.uint8)
    live[:rows] = ids != own
    alive = np.packbits(live, bitorder="little").view(np.uint64)
    if not alive.any():
        return ids[:0], ids[:0]
    size = np.abs(query.astype(np.int64))
    cut = max(0, int(size.max()).bit_length() - QUERY_BITS)
    high = size >> cut
    if high.any():
        # with a negative component the complement counts: (2**bits - 1) - up, bit by bit
        drop, bits = block["drop"], block["bits"]
        keep = np.maximum(bits - drop, 0)
        turn = (query < 0)[:, None] & (np.arange(SLICES)[None, :] < keep[:, None])
        slices = block["slices"] ^ np.where(turn, _FULL, np.uint64(0))[:, :, None]
        parts: list[list[np.ndarray]] = [[] for _ in range(SLICES + QUERY_BITS)]
        for a in range(QUERY_BITS):
            on = np.flatnonzero(high >> a & 1)
            for c in range(SLICES):
                used = on[keep[on] > c]
                if len(used):
                    parts[a + c].append(slices[used, c])
        if any(parts):
            sums = sum_slices(parts)
            kth = top_rows(sums, alive, k)
            # a row's exact sum lies between its sliced sum and this much more (all in units of 2**(cut + drop))
            most = (1 << bits) - 1
            doubt = int((size * most - (high << cut) * ((most >> drop) << drop)).clip(0).sum()
                        + ((high << cut) * np.minimum(most, (1 << drop) - 1)).sum())
            alive = at_least(sums, alive, kth - -(-doubt // (1 << (cut + drop))))
    some = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little")[:rows])
    score = codes[some].astype(np.int64) @ query.astype(np.int64)
    best = np.lexsort((ids[some], -score))[:k]
    return ids[some][best], score[best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
          block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best other rows. ``is_query`` reads the columns id, dim, code.

    Query blocks meet index blocks by an equi-join on the index block's number; a task holds one block of each.
    """
    spark = vectors.sparkSession
    prepare(spark)
    codes = quantised(vectors, id_col, vector_col, scale)
    index, blocks = _index(codes, block_rows)
    asked = codes.filter(is_query).groupBy("id").agg(F.min(F.struct("dim", "code")).alias("v")).select("id", "v.dim", "v.code")
    groups = max(1, -(-asked.count() // block_queries))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)))
    asked = asked.groupBy("dim", "group").agg(F.sort_array(F.collect_list(F.struct("id", "code"))).alias("queries"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    pairs = asked.repartition(blocks, "dim", "block").join(index.repartition(blocks, "dim", "block"), ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r, batch=batch: batch.column(c)[r]
                dim = get("dim").as_py()
                ids = np.frombuffer(get("ids").as_buffer(), np.int64)
                code = np.frombuffer(get("codes").as_buffer(), np.int32).reshape(-1, dim)
                block = {"bits": np.frombuffer(get("bits").as_buffer(), np.int64), "drop": get("drop").as_py(),
                         "slices": np.frombuffer(get("slices").as_buffer(), np.uint64).reshape(dim, SLICES, -1)}
                out: list[tuple[np.ndarray, ...]] = []
                for q in get("queries"):
                    own, vector = q["id"].as_py(), np.array(q["code"].as_py(), np.int64)
                    hit, score = search_block(vector, own, ids, code, block, k)
                    if len(hit):
                        out.append((np.full(len(hit), own), hit, score))
                cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = pairs.select("dim", "ids", "codes", "bits", "drop", "slices", "queries").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
