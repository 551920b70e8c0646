import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lexis, wumanber

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _words(text):
    return WORD.findall((text or "").encode().lower())


def _brute(texts, items, window=10):
    """(words, hit word numbers, item ids) of each text, window by window."""
    wanted = []
    for name, text in items:
        w = _words(text)
        k = min(window, len(w))
        wanted += [(name, w[i:i + k]) for i in range(len(w) - k + 1) if k]
    out = []
    for text in texts:
        w, hit, names = _words(text), set(), set()
        for name, win in wanted:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    names |= {str(name)} if name is not None else set()
        out.append((len(w), hit, sorted(names)))
    return out


def _got(rows, c):
    return [(r[c["n_words"]], {x for s in r[c["spans"]] for x in range(s["a"], s["b"])}, list(r[c["items"]])) for r in rows]


def _random_tables(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "The", "longerWord", "x1", "é", "漢字漢字漢字漢字", "averyveryveryverylongword", "averyveryvery_erylongword"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", ".\n", "--"]) for _ in range(n))
    items = [(i % 17, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 25]))) for i in range(25)]
    rows = []
    for i in range(docs):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(items)[1].upper(), text(rng.randint(0, 12))]
        rows.append((i, " ".join(parts)))
    return rows, items


def test_occurrences_match_window_by_window_search(spark, monkeypatch):
    for seed in (1, 2):
        rows, items = _random_tables(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        bench = spark.createDataFrame(items, "item_id long, text string")
        got, c = wumanber.occurrences(docs, bench)
        assert _got(got.orderBy("doc_id").collect(), c) == _brute([t for _, t in rows], items)


def test_several_blocks_give_the_same(spark):
    rows, items = _random_tables(3)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got, c = wumanber.occurrences(docs, bench, block_bytes=400)
    assert _got(got.orderBy("doc_id").collect(), c) == _brute([t for _, t in rows], items)


def test_long_items_are_parted_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(wumanber, "PART_WORDS", 7)
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    parts = [(r["item"], bytes(r["words"])) for r in wumanber.parted(bench).collect()]
    searcher = wumanber.Searcher(parts)
    assert sum(len(kind.first) for kind, _, _ in searcher.kinds) == 51
    n, row, a, b, _, item = searcher.search(pa.array(["x " + " ".join(words[3:40]) + " y", " ".join(words)]))
    assert n.tolist() == [39, 60] and len(a) == 28 + 51 and set(item.tolist()) == {0}


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = random.Random(4)
    rows, items = _random_tables(5, docs=8)
    texts = [" , ".join(t for _, t in rows) + " " * 90 + rng.choice(items)[1] + "z" * 200 + " " + rng.choice(items)[1], "", None, "a b"]
    searcher = wumanber.Searcher([(str(i), b" ".join(_words(t))) for i, t in items])
    whole = searcher.search(pa.array(texts))
    for part in (16, 64, 300):
        monkeypatch.setattr(lexis, "PART", part)
        n, row, a, b, item_row, item = searcher.search(pa.array(texts))
        assert n.tolist() == whole[0].tolist()
        assert set(zip(row, a, b)) == set(zip(*whole[1:4]))
        assert np.array_equal(item_row, whole[4]) and np.array_equal(item, whole[5])


def test_shift_table_skips_most_places():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    searcher = wumanber.Searcher([("1", " ".join(rng.choices(words, k=40)).encode())])
    text = " ".join(rng.choices(words, k=20_000)).encode()
    kind = searcher.kinds[0][0]
    found = lexis.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(kind.stops(found)) < 200  # of 20,000 places
    assert int(kind.shift.max()) == 9


def test_odd_rows(spark, odd_docs, no_docs):
    items = [(1, "quick brown fox jumps over the lazy dog while seven wizards"), (1, "one two"), (None, "ünïcode 漢字"), (2, None), (3, ""), (4, "?!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = odd_docs.collect()
    got, c = wumanber.occurrences(odd_docs, bench)
    assert got.columns[:len(odd_docs.columns)] == odd_docs.columns
    found = {(r["doc_id"], r["text"]): x for r, x in zip(got.collect(), _got(got.collect(), c))}
    for r, want in zip(rows, _brute([r["text"] for r in rows], items)):
        assert found[(r["doc_id"], r["text"])] == want
    assert wumanber.occurrences(no_docs, bench)[0].count() == 0
    got, c = wumanber.occurrences(odd_docs, bench.filter("false"))
    assert got.filter(F.size(c["spans"]) > 0).count() == 0 and got.count() == len(rows)
    assert wumanber.occurrences(odd_docs, bench.filter("text is null"))[0].count() == len(rows)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_matches_brute_force(spark, sf):
    from tessera.llm.queries import op11_decontaminate

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    some = [r for r in docs if len(r["text"]) < 3000][:60]
    want = {r["doc_id"]: w for r, w in zip(some, _brute([r["text"] for r in some], items))}
    for r in op11_decontaminate(spark, sf).collect():
        if r["doc_id"] in want:
            n, hit, names = want[r["doc_id"]]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(names), bool(hit))
