import math
import random
import re

import numpy as np

from tessera.llm import lexis, lexsearch

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _terms(text):
    return [t.lower() for t in TERM.findall((text or "").encode())]


def _brute(docs, items, k=50):
    """Rows (item, rank, doc_id, score), document by document and term by term."""
    known = [(i, _terms(t)) for i, t in docs]
    known = [(i, t) for i, t in known if t]
    n, length = len(known), sum(len(t) for _, t in known)
    df = {}
    for _, t in known:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for name, text in items:
        asked.setdefault(name, set()).update(_terms(text))
    out = []
    for name, want in asked.items():
        scores = []
        for i, t in known:
            m = 100 - 50 + (50 * len(t) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 20 * m)) for x in want if x in t)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(name, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def _rows(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def _tables(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "漢字", "Averyveryverylongterm1", "Averyveryvery_ongterm1"]
    text = lambda most: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(7, docs[3][1])] * 3 + [(None, docs[5][1]), (900, docs[5][1]), (901, None), (902, " ,, ")]
    shared = text(12)
    items = [(i % 14, text(10) + " " + shared) for i in range(20)] + [(None, "w1 w2"), (50, ""), (51, None), (52, "nowhere")]
    return docs, items


def test_search_matches_brute_force(spark):
    for k, block in ((5, 1 << 16), (50, 60)):
        docs, items = _tables(k)
        got = lexsearch.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
                               spark.createDataFrame(items, "item_id long, text string"), k, block_terms=block)
        assert _rows(got) == _brute(docs, items, k)


def test_dag_shares_sums_and_keeps_them_exact():
    rng = random.Random(2)
    shared = [rng.sample(range(200), 25) for _ in range(4)]
    items = [sorted(set(rng.sample(range(200), 8) + shared[i % 4])) for i in range(40)]
    dag = lexsearch.mine(items, 200)
    leaves = np.array([[rng.randint(-9, 9) for _ in range(7)] for _ in range(200)], np.int64)
    want = np.array([leaves[i].sum(0) for i in items])
    assert np.array_equal(lexsearch.evaluate(dag, leaves), want)
    plain = sum(len(i) - 1 for i in items)
    assert dag.sums() < plain / 2
    # a limit on what one round compares changes the sharing, not the sums
    few = lexsearch.mine(items, 200, mined=6)
    assert np.array_equal(lexsearch.evaluate(few, leaves), want) and few.sums() <= plain


def test_items_without_shared_terms():
    dag = lexsearch.mine([[0, 1], [2], []], 3)
    assert not dag.levels and [i.tolist() for i in dag.items] == [[0, 1], [2], []]
    assert lexsearch.evaluate(dag, np.eye(3, dtype=np.int64)).tolist() == [[1, 1, 0], [0, 0, 1], [0, 0, 0]]


def test_best_keeps_ties_by_id():
    rng = random.Random(5)
    rows = [(rng.randint(0, 3), rng.randint(0, 50)) for _ in range(300)]
    best = lexsearch.Best(1, 10)
    for a in range(0, 300, 37):
        part = rows[a:a + 37]
        best.add(np.array([[s for s, _ in part]]), np.array([i for _, i in part]), np.zeros(len(part), np.int64))
    want = sorted([(-s, i) for s, i in rows if s > 0])[:10]
    assert list(zip((-best.kept[1]).tolist(), best.kept[2].tolist())) == want


def test_long_texts_in_parts(spark, monkeypatch):
    docs, items = _tables(9, 20)
    docs.append((1000, " ".join(t or "" for _, t in docs)))
    terms = sorted({t.decode() for _, x in items for t in _terms(x)})
    rows = lambda: sorted((str(tuple(r)) for r in lexsearch.forward(spark.createDataFrame(docs, "doc_id long, text string"), terms).collect()))
    whole = rows()
    assert lexis.PART == 1 << 20
    data, cuts = np.frombuffer(docs[-1][1].encode(), np.uint8), np.array([0, len(docs[-1][1].encode())])
    one, many = [lexis.words_of(data, cuts)], list(lexis.runs(data, cuts, part=50))
    assert len(many) > 5 and np.array_equal(np.concatenate([m.code for m in many]), one[0].code)
    assert np.array_equal(np.concatenate([m.at for m in many]), one[0].at)
    assert len(whole) == len(docs)


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "Quick brown JUDGES"), (2, "words"), (3, None), (4, ""), (2, "long1 long2"), (5, "ünïcode 漢字")], "item_id long, text string")
    got = lexsearch.search(odd_docs, bench)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert _rows(got) == _brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], [tuple(r) for r in bench.collect()])
    assert lexsearch.search(no_docs, bench).count() == 0
    empty = lexsearch.search(odd_docs, bench.filter("false"))
    assert empty.count() == 0 and empty.dtypes == got.dtypes
