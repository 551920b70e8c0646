import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import bitsliced


def _brute(rows, k=5):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in sorted(sound, reverse=True):
        if q % 50 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q and len(a) == len(b))[:k]
            out[q] = [(i, -s) for s, i in near]
    return {(q, r + 1): x for q, near in out.items() for r, x in enumerate(near)}


def _got(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


def test_brute_force_with_ties_and_unsound_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-0.6, 0.6) for _ in range(12)]) for i in range(700)]
    rows += [(700 + i, [0.5] * 12) for i in range(300)]  # a hot vector: ties everywhere
    rows += [(2000, None), (2050, [float("nan")] * 12), (2001, [None] * 12), (2002, [float("inf")] + [0.1] * 11), (None, [0.3] * 12), (2100, []), (2003, [0.2] * 3),
             (2150, [0.1] * 3), (3, [0.9] * 12), (2200, [0.0] * 12), (2201, [1e-9] * 12)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score string")
    rows = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows]
    got = _got(bitsliced.top_k(df, F.col("id") % 50 == 0, block_rows=256, block_queries=4))
    assert got == _brute(rows)


def test_kernel_against_products():
    rng = np.random.default_rng(5)
    for rows, dim, scale in ((1, 3, 5), (70, 1, 200), (300, 16, 90), (130, 8, 1), (200, 5, 3000)):
        codes = np.floor(rng.normal(0, scale, (rows, dim))).astype(np.int32)
        block, ids = bitsliced.build_block(codes), np.arange(rows) * 3
        for i in range(0, rows, 7):
            ids_got, scores = bitsliced.search_block(codes[i].astype(np.int64), int(ids[i]), ids, codes, block, 5)
            want = codes.astype(np.int64) @ codes[i].astype(np.int64)
            order = [j for j in np.lexsort((ids, -want)) if j != i][:5]
            assert ids_got.tolist() == ids[order].tolist() and scores.tolist() == want[order].tolist()


def test_slice_sums():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2, (9, 128)).astype(np.uint8)
    maps = np.packbits(values, axis=1, bitorder="little").view(np.uint64)
    out = bitsliced.sum_slices([[maps[:4]], [maps[4:7]], [], [maps[7:]]])
    bits = np.unpackbits(out.view(np.uint8).reshape(len(out), -1), axis=1, bitorder="little").astype(int)
    assert ((bits * (1 << np.arange(len(out)))[:, None]).sum(0) == values[:4].sum(0) + 2 * values[4:7].sum(0) + 8 * values[7:].sum(0)).all()


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert bitsliced.top_k(df, F.col("id") % 50 == 0).count() == 0
