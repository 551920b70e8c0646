import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _counts(docs, slip=199):
    words = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def _brute(words):
    near = {w: [v for v in words if _one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def _rows(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _edited(rng, w, letters):
    i = rng.randint(0, len(w))
    kind = rng.randint(0, 2)
    if kind == 0:
        return w[:i] + rng.choice(letters) + w[i:]
    return w[:i] + (rng.choice(letters) if kind == 1 else "") + w[i + 1:]


def test_near_pairs_match_all_pairs(spark):
    rng = random.Random(1)
    for letters, lengths in (("ab", (6, 9)), ("abcdeéÿ", (6, 14))):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))) for _ in range(60)}
        words |= {_edited(rng, w, letters) for w in list(words) for _ in range(4)}
        words = sorted(w for w in words if len(w) >= 6)
        got = [(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()]
        want = {frozenset((a, b)) for a in words for b in words if _one_edit(a, b)}
        assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_variants_match_brute_force(spark):
    rng = random.Random(2)
    letters = "abcdeé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(12)]
    pool = base * 40 + [_edited(rng, w, letters) for w in base for _ in range(3)] * 6
    pool += [_edited(rng, _edited(rng, w, letters), letters) for w in base for _ in range(3)] * 5
    docs = [(i if i % 9 else None, " ".join(rng.choice([w, w.upper(), w.capitalize()]) + rng.choice(["", ",", "1", "-"])
                                            for w in rng.choices(pool, k=60))) for i in range(60)]
    docs += [(100, None), (101, ""), (3, docs[3][1]), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for slip in (199, 3):
        words = _counts(docs, slip)
        got = _rows(spelling.variants(df, slip=slip))
        assert got == _brute(words)
        assert any(f for _, f, _, _, _, _ in got)


def test_chains_of_forms_lead_to_one_root(spark):
    counts = {"abcdef": 6, "abcdeg": 30, "abcdhg": 150, "abcihg": 750, "abjihg": 3750, "akjihg": 18750, "lonely": 7}
    links = [(w, f) for w, f in zip(list(counts)[:5], list(counts)[1:6])]
    got = spelling.roots(spark.createDataFrame(links, "word string, form string"), max(counts.values()))
    assert {(r["word"], r["root"]) for r in got.collect()} == {(w, "akjihg") for w, _ in links}


def test_frequent_chunk_makes_no_long_lists(spark):
    """300 words that share a half, but differ in two letters or more: no key holds more than a few of them."""
    letters = "bcdfghjklmnpqrstvwxz"
    words = [f"inter{a}{b}{a}{b}{c}" for a in letters[:15] for b in letters for c in "aeiou"][:1500]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    keys = df.select("word", F.explode(spelling._keys(F.col("word"), F.length("word"))).alias("k")).groupBy("k").count()
    assert keys.agg(F.max("count")).first()[0] <= len(letters) * 5
    assert spelling.near_pairs(df).count() == sum(
        1 for w in words for o in "aeiou" if o > w[-1] and w[:-1] + o in set(words))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    repeated = odd_docs.unionAll(odd_docs).unionAll(odd_docs)
    assert _rows(spelling.variants(repeated)) == _brute(_counts(rows * 3))
    assert spelling.variants(no_docs).count() == 0
