"""Exact top-k against numpy brute force; index maintenance semantics."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors as V


def brute(q, d, k, qg=None, dg=None, self_ids=None, dids=None):
    out = {}
    for i, qv in enumerate(q):
        res = []
        for j, dv in enumerate(d):
            if qg is not None and qg[i] != dg[j]:
                continue
            if self_ids is not None and self_ids[i] == dids[j]:
                continue
            nq, nd = np.linalg.norm(qv), np.linalg.norm(dv)
            if nq == 0 or nd == 0:
                continue
            res.append((-(qv @ dv) / (nq * nd), dids[j]))
        res.sort()
        out[i] = [(r[1], round(-r[0], 9)) for r in res[:k]]
    return out


@pytest.mark.parametrize("blocks", [(1024, 8192), (2, 7)])  # one block / many blocks
def test_topk_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(7)
    d = rng.normal(size=(60, 8)).astype(np.float32)
    d[5] = 0.0                      # zero vector never matches
    d[7] = d[8]                     # equal scores: tie broken by id
    q = rng.normal(size=(9, 8)).astype(np.float32)
    q[3] = 0.0                      # question with no hit
    dg = [i % 3 for i in range(60)]
    qg = [i % 4 for i in range(9)]  # group 3 has no documents
    docs = spark.createDataFrame([(i, d[i].tolist(), dg[i]) for i in range(60)], "id bigint, vector array<float>, g int")
    qs = spark.createDataFrame([(i, q[i].tolist(), qg[i]) for i in range(9)], "question_id bigint, qvec array<float>, g int")
    for k, grouped in [(3, False), (2, True), (100, False)]:   # k larger than the document count
        got = V.topk_cosine(qs, docs, k, q_group="g" if grouped else None, doc_group="g" if grouped else None,
                            block_questions=blocks[0], block_docs=blocks[1])
        rows = {}
        for r in got.orderBy("question_id", "rank").collect():
            rows.setdefault(r["question_id"], []).append((r["id"], round(r["similarity_score"], 9)))
        want = brute(q.astype(np.float64), d.astype(np.float64), k, qg if grouped else None,
                     dg if grouped else None, None, list(range(60)))
        assert {i: v for i, v in want.items() if v} == rows


def test_far_blocks_are_skipped(spark):
    """Clustered vectors: most pairs of blocks cannot hold a best document, and are not scored."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    d = (centres[np.arange(1200) % 12] + 0.05 * rng.normal(size=(1200, 16))).astype(np.float32)
    q = (centres[np.arange(60) % 12] + 0.05 * rng.normal(size=(60, 16))).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(d)], "id bigint, vector array<float>, g int")
    qs = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(q)], "question_id bigint, qvec array<float>, g int")
    for group in (None, "g"):
        counter = {}
        got = {}
        hits = V.topk_cosine(qs, docs, 5, q_group=group, doc_group=group, block_questions=8, block_docs=40, counter=counter)
        for r in hits.orderBy("question_id", "rank").collect():
            got.setdefault(r["question_id"], []).append((r["id"], round(r["similarity_score"], 9)))
        g = group and [i % 2 for i in range(1200)]
        assert got == brute(q.astype(np.float64), d.astype(np.float64), 5, g and g[:60], g or None, None, list(range(1200)))
        assert counter["scored"] < counter["pairs"] / 3


def test_question_blocks_meet_their_own_group_only(spark):
    docs = spark.range(400).selectExpr("id", "id % 20 AS g", "array(cast(id % 7 + 1 AS float), cast(id % 5 AS float)) AS vector")
    qs = spark.range(20).selectExpr("id AS question_id", "id AS g", "array(1f, cast(id AS float)) AS qvec")
    counter = {}
    hits = V.topk_cosine(qs, docs, 2, q_group="g", doc_group="g", block_questions=4, block_docs=30, counter=counter)
    assert hits.count() == 40 and counter["pairs"] == 20  # one block of each side per group, never a block of another group


def test_equal_vectors_give_k_rows_per_question(spark):
    docs = spark.range(5000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    qs = spark.createDataFrame([(1, [1.0, 2.0], "d0"), (2, [2.0, 1.0], "d3")], "question_id bigint, qvec array<double>, own string")
    got = V.topk_cosine(qs, docs, 3, q_self="own", block_docs=500).collect()
    ids = sorted(f"d{i}" for i in range(5000))
    want = {(1, r + 1): i for r, i in enumerate([x for x in ids if x != "d0"][:3])} | {(2, r + 1): i for r, i in enumerate([x for x in ids if x != "d3"][:3])}
    assert {(r["question_id"], r["rank"]): r["id"] for r in got} == want


def test_hashed_embedding_unit_and_deterministic(spark):
    df = spark.createDataFrame([(1, "Orders, Customers!"), (2, ""), (3, "orders customer")], "id int, t string")
    a = {r["id"]: r["vector"] for r in V.hashed_embedding(df, "t", ["id"], 16).collect()}
    b = {r["id"]: r["vector"] for r in V.hashed_embedding(df.repartition(3), "t", ["id"], 16).collect()}
    assert a == b
    assert abs(np.linalg.norm(a[1]) - 1) < 1e-5 and np.linalg.norm(a[2]) == 0
    assert np.allclose(a[1], a[3])  # plural folding + case folding


def test_upsert_delete_update(spark):
    idx = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<float>")
    batch = spark.createDataFrame([("b", [3.0], 1), ("b", [4.0], 2), ("c", [5.0], 1)],
                                  "id string, vector array<float>, seq int")
    up = {r["id"]: r["vector"][0] for r in V.upsert(idx, batch, order_col="seq").collect()}
    assert up == {"a": 1.0, "b": 4.0, "c": 5.0}
    dl = {r["id"] for r in V.delete_ids(idx, spark.createDataFrame([("a",)], "id string")).collect()}
    assert dl == {"b"}
    new = spark.createDataFrame([("a", [9.0]), ("zz", [0.0])], "id string, vector array<float>")
    upd = {r["id"]: r["vector"][0] for r in V.update_vectors(idx, new).collect()}
    assert upd == {"a": 9.0, "b": 2.0}
    chk = V.dimension_check(idx.withColumn("type", F.lit("t")), 1).first()
    assert chk["dim_ok"] and chk["n_docs"] == 2


def test_exact_match_keeps_oldest(spark):
    stored = spark.createDataFrame([(3, "q1"), (1, "q1"), (2, "q2")], "sid int, question string")
    qs = spark.createDataFrame([(10, "q1"), (11, "nope")], "qid int, question string")
    got = {r["qid"]: (r["exact_match"], r["m"]["sid"] if r["m"] else None)
           for r in V.exact_match(qs, stored).collect()}
    assert got == {10: (True, 1), 11: (False, None)}


def test_float_vectors_are_moved_as_floats(spark):
    """Blocks hold the vectors in the type they came in; the scores are those of doubles."""
    rows = [(i, [float(np.float32(np.sin(i * 7 + j))) for j in range(8)]) for i in range(60)]
    wide = spark.createDataFrame(rows, "id bigint, vector array<double>")
    slim = spark.createDataFrame(rows, "id bigint, vector array<float>")
    assert V._sound(slim, "id", "vector", None, 8).schema["m"].dataType["vec"].dataType.simpleString() == "array<float>"
    hits = [V.topk_cosine(d.selectExpr("id AS question_id", "vector AS qvec", "id AS self_id"), d, 3, q_self="self_id", block_docs=b)
            .orderBy("question_id", "rank").collect() for d in (slim, wide) for b in (1000, 16)]
    assert len(hits[0]) == 180
    key = lambda rows: [(r["question_id"], r["rank"], r["id"]) for r in rows]
    assert all(key(h) == key(hits[0]) for h in hits)
    assert hits[0] == hits[2] and hits[1] == hits[3]


@pytest.mark.parametrize("kind", ["plain", "copies", "one vector", "nearly one vector", "zeros"])
@pytest.mark.parametrize("k", [1, 3, 900])
def test_best_of_a_block_equals_brute_force(kind, k):
    """Runs of scores, equal vectors, keys that repeat, own keys that are null, and scores that single precision cannot tell apart."""
    rng = np.random.default_rng(11)
    d = rng.integers(-9, 10, size=(700, 8)).astype(np.float32)
    if kind == "copies":
        d = d[rng.integers(0, 20, 700)]
    if kind == "one vector":
        d[:] = d[0]
    if kind == "nearly one vector":
        d = d[0] * 1000 + rng.integers(-1, 2, size=(700, 8)).astype(np.float32) / 8
    if kind == "zeros":
        d[::3] = 0
    ids, own = rng.permutation(700) // 2, rng.integers(0, 350, 40).tolist()
    own[3] = None
    q = d[rng.integers(0, 700, 40)]
    docs = pa.StructArray.from_arrays([pa.array(ids), pa.array(list(d), pa.list_(pa.float32()))], names=["key", "vec"])
    asks = pa.StructArray.from_arrays([pa.array(range(40)), pa.array(list(q), pa.list_(pa.float32())), pa.array(own, pa.int64())], names=["key", "vec", "own"])
    score = V._unit(asks.field("vec"), 8) @ V._unit(docs.field("vec"), 8).T
    least = np.full(40, -2.0)
    for bounded in (False, True):
        i, j, s = V._block_best(asks, V._Documents(docs, 8, k), k, True, least if bounded else None)
        for n in range(40):
            want = sorted(((round(-x, 9), ids[m]) for m, x in enumerate(score[n]) if np.isfinite(x) and ids[m] != own[n]))[:k]
            got = sorted((round(-x, 9), ids[m]) for m, x in zip(j[i == n], s[i == n]))
            if bounded:
                want = [w for w in want if -w[0] >= least[n]]
            if kind == "nearly one vector":  # equal but for the last bits: which of them come first is rounding
                assert [g[0] for g in got] == [w[0] for w in want]
            else:
                assert got == want
            if len(want) > 1:
                least[n] = -want[len(want) // 2][0] - 1e-8


def test_bounds_spare_candidates_of_later_blocks(spark):
    """What a question's other blocks hold is written only where it reaches the k-th best score found first."""
    rng = np.random.default_rng(5)
    d = rng.normal(size=(600, 6)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)], "id bigint, vector array<float>")
    made = []

    def score(pairs):
        made.append("known" in pairs.columns)
        return V._score(pairs, 6, 3, False, "bigint", "bigint")

    asked = docs.limit(30).selectExpr("id AS question_id", "vector AS qvec")
    q, held = V._sound(asked, "question_id", "qvec", None, 6), V._sound(docs, "id", "vector", None, 6)
    pivots = V._pivots(held, 6, 12)
    blocks = V._blocks(q, 6, 8, pivots, 1), V._blocks(held, 6, 50, pivots, 50)
    found = V._pruned(*blocks, score, 3, None).collect()
    unbounded = V._pruned(*blocks, lambda pairs: V._score(pairs.drop("known"), 6, 3, False, "bigint", "bigint"), 3, None).count()
    u = d / np.linalg.norm(d, axis=1, keepdims=True)
    want = np.sort(u[[r["question_id"] for r in asked.collect()]] @ u.T, axis=1)[:, -3:]
    best = {}
    for r in found:
        best.setdefault(r["q"], []).append(r["score"])
    assert made == [False, True] and np.allclose(sorted(sum((sorted(v)[-3:] for v in best.values()), [])), sorted(want.ravel()), atol=1e-6)
    assert len(found) < unbounded * 0.8
