import re

import pytest

from tessera.llm import mixing


def _targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Deal by weight, cap, deal the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= most * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(v for s, v in out.items() if s not in open_)
    return out


def _run(docs, **kw):
    rows, c = mixing.mix(docs, **kw)
    return [{k: r[v] for k, v in c.items()} | {"doc_id": r["doc_id"], "source": r["source"]} for r in rows.collect()], rows


def test_targets_and_taken(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('word ', int(1 + id % 13)) text",
                                        "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 7) end source")
    rows, df = _run(docs, range_docs=64)
    assert df.columns[:3] == docs.columns
    sizes, taken, target = {}, {}, {}
    for r in rows:
        assert r["copies"] in (0, 1, 2) and r["size"] == 1 + r["doc_id"] % 13
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    want = _targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 7  # half of the longest document
    again, _ = _run(docs.repartition(13), range_docs=1000)
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_heavier_documents_are_drawn_more_often(spark):
    from pyspark.sql import functions as F

    docs = spark.range(6000).selectExpr("id doc_id", "'a b c' text", "concat('s', id % 2) source")
    rows, c = mixing.mix(docs, weights=(1, 1), share=0.5, weight=F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0))
    heavy, light = (rows.filter(f"doc_id % 4 {op} 2").agg({c["copies"]: "sum"}).first()[0] for op in ("<", ">="))
    assert heavy > 1.8 * light


def test_odd_rows(odd_docs):
    rows, df = _run(odd_docs)
    assert df.columns[:len(odd_docs.columns)] == odd_docs.columns and len(rows) == odd_docs.count()
    text = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or ""))
    assert len({r["copies"] for r in rows if r["doc_id"] == 2}) == 1


def test_empty(no_docs):
    rows, _ = mixing.mix(no_docs)
    assert rows.count() == 0
