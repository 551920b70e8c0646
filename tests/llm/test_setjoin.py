import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm import setjoin
from tessera.llm.shingles import shingle_sets
from tessera.llm.common import text_buffer


def _set(text, k):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _brute(rows, k, num, den):
    sets = [_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=repr)


def _near_copies(rng, n):
    """Families of copies with 0 to many edits, chains of edits, and texts that share long passages."""
    words = [f"W{i}" for i in range(3000)]
    rows = []
    common = [rng.choice(words) for _ in range(60)]
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 6, 12, 30, 80, 200]))]
        if rng.random() < 0.4:
            base = base + common
        last = base
        for _ in range(rng.choice([1, 1, 3, 10])):
            copy = list(last if rng.random() < 0.5 else base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                at = rng.randrange(len(copy))
                copy[at] = rng.choice([copy[at].lower(), "new%d" % rng.randrange(10 ** 6), copy[at] + "x"])
            last = copy
            rows.append(" ".join(copy))
    return rows[:n]


def _classes(spark, rows, k, num, den, **kw):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, component int")
    got = setjoin.near_classes(df, k, num, den, **kw).select("doc_id", "n", "component").collect()
    return sorted([tuple(r) for r in got], key=repr)


def test_classes_match_brute_force(spark):
    rng = random.Random(4)
    rows = list(enumerate(_near_copies(rng, 400)))
    rng.shuffle(rows)
    for k, num in ((3, 90), (5, 80)):
        assert _classes(spark, rows, k, num, 100) == _brute(rows, k, num, 100)


def test_members_in_many_chunks(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):  # copies that link to each other or not, around one text that is missing
        copy = list(base)
        for at in rng.sample(range(60), 2):
            copy[at] = f"{copy[at]}-{rng.choice('ab')}"
        rows.append((i, " ".join(copy)))
    want = _brute(rows, 3, 90, 100)
    assert len({c for _, _, c in want}) < 120
    assert _classes(spark, rows, 3, 90, 100, chunk=7) == want


def test_links_from_differences():
    rng = random.Random(2)
    for num in (80, 90):
        for _ in range(40):
            base = rng.sample(range(10 ** 6), rng.choice([8, 40, 150]))
            sets = []
            for _ in range(25):
                s = set(base)
                for _ in range(rng.randrange(0, max(2, len(base) // 4))):
                    s.discard(rng.choice(base))
                    if rng.random() < 0.7:
                        s.add(rng.choice(base) + 10 ** 7 + rng.randrange(3))
                sets.append(s)
            lead = np.array(sorted(base), np.uint64)
            arrays = [np.array(sorted(s), np.uint64) for s in sets]
            apart = [np.setxor1d(lead, a) for a in arrays]
            sizes = np.array([len(a) for a in arrays])
            linked = np.array([len(a) for a in apart]) <= setjoin.most_apart(sizes + len(lead), num, 100)
            members = setjoin._Members(np.arange(len(sets)), sizes, linked, apart, num, 100)
            for i, s in enumerate(sets):
                want = {j for j, o in enumerate(sets) if 100 * len(s & o) >= num * len(s | o)}
                assert set(members.answers(apart[i], len(s)).tolist()) == want


def test_shared_by_many_sets_of_a_batch_is_still_counted(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LOCAL", 2)
    rng = random.Random(6)
    rows = list(enumerate(_near_copies(rng, 150)))
    table = pa.RecordBatch.from_pydict({"text": [t for _, t in rows]})
    counted = pa.Table.from_batches(list(setjoin._element_rows(iter([table]), 3, 1)))
    got = setjoin._counts_of_sets(setjoin._shared_counts(counted, 4)).to_pylist()
    sets = {}
    for a, b, starts, e, key in setjoin._text_sets(table.column(0), 3):
        sets |= {int(k): set(e[s:t].tolist()) for k, s, t in zip(key.view(np.int64), starts, starts[1:]) if t > s}
    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, set()).add(k)
    want = {k: n for k, s in sets.items() if (n := sum(len(holders[x]) > 1 for x in s))}
    got = {r["key"]: r["shared"] for r in got}
    assert set(got) == set(want) and all(got[k] >= n for k, n in want.items())


def test_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = setjoin.near_classes(odd_docs, 5, 80, 100).select("doc_id", "n", "component").collect()
    assert sorted([tuple(r) for r in got], key=repr) == _brute(rows, 5, 80, 100)
    kept = setjoin.one_of_each(odd_docs, 5, 80, 100)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, 4, None, 5, 6, 8], key=repr)  # 7 is 1 with a few words before it


def test_empty(no_docs):
    assert setjoin.near_classes(no_docs).count() == 0
    assert setjoin.one_of_each(no_docs).count() == 0


def test_one_component_per_path_and_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 5001), (5000, 5000)]
    labels = {r["node"]: r["label"] for r in setjoin.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert len({labels[i] for i in range(301)}) == 1 and len({labels[i] for i in range(1000, 1100)}) == 1
    assert len(set(labels.values())) == 3


def test_shingles_of_long_words_and_parts(monkeypatch):
    from tessera.llm import shingles

    monkeypatch.setattr(shingles, "_SPAN", 64)
    rng = random.Random(9)
    texts = ["", " ", "a", "A b", "x" * 300 + " y", " ".join(rng.choice(["aa", "Bb", "c", "été"]) for _ in range(400)), "\t tab\nline\x0b v\x1cno "]
    column = pa.array(texts)
    for k in (3, 5):
        sizes = []
        for _, _, starts, _ in shingle_sets(*text_buffer(column), k):
            sizes += np.diff(starts).tolist()
        assert sizes == [len(_set(t, k)) for t in texts]


def test_words_longer_than_a_part_stay_whole(monkeypatch):
    from tessera.llm import shingles

    rng = random.Random(10)
    long = "".join(rng.choice("aBcdé漢") for _ in range(6000))  # more than _SPAN + 4000 bytes
    texts = [long, f"x {long} {long.swapcase()} {long}y z", "q" * 64, "q" * 128 + " r", long[:90], "", f"{long}\n"]
    want = [len(_set(t, 3)) for t in texts]
    monkeypatch.setattr(shingles, "_SPAN", 64)
    cut = list(shingle_sets(*text_buffer(pa.array(texts)), 3))
    assert [n for _, _, starts, _ in cut for n in np.diff(starts).tolist()] == want and want[0] == 1
    monkeypatch.setattr(shingles, "_SPAN", 1 << 21)
    whole = list(shingle_sets(*text_buffer(pa.array(texts)), 3))
    assert np.concatenate([keys for *_, keys in cut]).tolist() == np.concatenate([keys for *_, keys in whole]).tolist()


def _signed(sets, num, den):
    elements, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    row, sig = setjoin.signatures(elements, starts, setjoin.sizes_of_levels(num, den), num, den)
    return [set(sig[row == i].tolist()) for i in range(len(sets))]


def test_unrelated_sets_share_no_list():
    rng = np.random.default_rng(3)
    for num, n in ((80, 500), (80, 60), (90, 500)):
        sets = [np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64)) for _ in range(150)]
        signed = _signed(sets, num, 100)
        assert sum(map(len, signed)) == len(set().union(*signed))


def test_linked_sets_share_a_list_down_to_the_threshold():
    rng = np.random.default_rng(5)
    for num in (50, 80, 90):
        for n in (*range(1, 40), 77, 200, 501):
            for _ in range(6):
                x = np.unique(rng.integers(0, 1 << 52, n).astype(np.uint64))
                gone = rng.integers(0, len(x) * (100 - num) // 100 + 1)
                left = rng.permutation(x)[gone:]
                more = len(left) * 100 // num - len(x)  # the most that keeps them linked
                if not len(left) or more < 0:
                    continue
                y = np.unique(np.concatenate([left, rng.integers(0, 1 << 52, more).astype(np.uint64)]))
                assert 100 * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y))
                one, two = _signed([x, y], num, 100)
                assert one & two
