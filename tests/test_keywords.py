"""Keyword extraction against a plain-Python brute force of the same scoring rules."""

import math
import statistics

import regex

from tessera.operators import keywords as K

TEXTS = {
    1: "Spark joins scale. Spark joins shuffle data across the cluster! The cluster stores Data in parquet.\n"
       "Parquet files hold columns. Joins on keys need a shuffle; keys with SKEW need salting.",
    2: "Vector search finds similar vectors. Exact search compares every vector with the question vector.",
    3: "",
}


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def brute(text, top=5, lim=0.2):
    toks = []
    for si, s in enumerate(regex.split(K.SENTENCE_SPLIT.replace("\\x0B", "\\x0b"), text)):
        ws = [(wi, w) for wi, w in enumerate(regex.split(K.WORD_SPLIT, s)) if w]
        for j, (wi, w) in enumerate(ws):
            left = ws[j - 1][1].lower() if j > 0 else None
            right = ws[j + 1][1].lower() if j + 1 < len(ws) else None
            toks.append((si, wi, w, w.lower(), left, right))
    if not toks:
        return []
    n_sent = max(t[0] for t in toks) + 1
    terms = {}
    for si, wi, w, lw, left, right in toks:
        d = terms.setdefault(lw, {"tf": 0, "up": 0, "acr": 0, "sents": [], "l": [], "r": []})
        acr = len(w) > 1 and w == w.upper() and regex.search(r"\p{L}", w) is not None
        d["tf"] += 1
        d["acr"] += acr
        d["up"] += (regex.match(r"\p{Lu}", w[0]) is not None) and not acr and wi > 0
        d["sents"].append(si)
        if left:
            d["l"].append(left)
        if right:
            d["r"].append(right)
    stop = {t for t in terms if t in K.STOPWORDS or len(t) < 3}
    content = [d["tf"] for t, d in terms.items() if t not in stop]
    mean = sum(content) / len(content)
    std = statistics.pstdev(content) if content else 0.0
    mx = max(d["tf"] for d in terms.values())
    S = {}
    for t, d in terms.items():
        tf = d["tf"]
        case = max(d["up"], d["acr"]) / (1 + math.log(tf))
        pos = math.log(math.log(3 + statistics.median(d["sents"])))
        freq = tf / (mean + std)
        wl = len(set(d["l"])) / len(d["l"]) if d["l"] else 0.0
        wr = len(set(d["r"])) / len(d["r"]) if d["r"] else 0.0
        rel = 1 + (wl + wr) * tf / mx
        dif = len(set(d["sents"])) / n_sent
        S[t] = rel * pos / (case + freq / rel + dif / rel)
    cands = {}
    for si, wi, w, lw, left, right in toks:
        cands[(lw, None)] = cands.get((lw, None), 0) + 1
        if right:
            cands[(lw, right)] = cands.get((lw, right), 0) + 1
    scored = []
    for (a, b), n in cands.items():
        if a in stop or (b is not None and b in stop):
            continue
        prod = S[a] * (S[b] if b else 1.0)
        total = S[a] + (S[b] if b else 0.0)
        scored.append((prod / (n * (1 + total)), a if b is None else f"{a} {b}"))
    kept = []
    for sc, kw in sorted(scored):
        if len(kept) >= top:
            break
        if all(1 - lev(k, kw) / max(len(k), len(kw)) <= lim for _, k in kept):
            kept.append((sc, kw))
    return kept


def test_keywords_equal_brute_force(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")
    got = {}
    for r in K.extract_keywords(df).orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append((round(r["score"], 9), r["keyword"]))
    for d, text in TEXTS.items():
        want = [(round(s, 9), k) for s, k in brute(text)]
        assert got.get(d, []) == want, (d, got.get(d), want)


def test_single_terms_and_plain_words(spark):
    """Flags and counts of words that occur once or often, with and without case; held values are folded, not copied."""
    text = "abc ÉCOLE École école {x} NASA nasa 漢字 漢字 aB Zed. zed ZED 12 I one. One two"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    rows = K.term_stats(df)
    got = {r["term"]: tuple(r)[2:-1] for r in rows.collect()}
    want = {}
    for si, s in enumerate(regex.split(K.SENTENCE_SPLIT.replace("\\x0B", "\\x0b"), text)):
        ws = [(wi, w) for wi, w in enumerate(regex.split(K.WORD_SPLIT, s)) if w]
        for j, (wi, w) in enumerate(ws):
            acr = len(w) > 1 and w == w.upper() and regex.search(r"\p{L}", w) is not None
            up = regex.match(r"\p{Lu}", w) is not None and not acr and wi > 0
            want.setdefault(w.lower(), []).append((si, up, acr, ws[j - 1][1].lower() if j else None, ws[j + 1][1].lower() if j + 1 < len(ws) else None))
    for term, t in want.items():
        left, right = [x[3] for x in t if x[3]], [x[4] for x in t if x[4]]
        assert got.pop(term) == (len(t), sum(x[1] for x in t), sum(x[2] for x in t), len({x[0] for x in t}), t[0][0], statistics.median(x[0] for x in t),
                                 len(left), len(right), len(set(left)), len(set(right))), term
    assert not got
    assert "transform(array(" not in rows._jdf.queryExecution().optimizedPlan().toString()
