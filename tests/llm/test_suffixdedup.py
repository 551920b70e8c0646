import random

import numpy as np

from tessera.llm import suffixdedup


def _brute(rows, length):
    """(id, bytes) -> removed spans, by comparing all windows."""
    first = {}
    for doc, raw in rows:
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, raw in rows:
        mark = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i:i + length]] < doc:
                mark[i:i + length] = b"\1" * length
        spans, at = [], 0
        while (a := mark.find(1, at)) >= 0:
            at = b if (b := mark.find(0, a)) >= 0 else len(raw)
            spans.append((a, at))
        out.append((doc, tuple(spans), bytes(x for x, m in zip(raw, mark) if not m)))
    return sorted(out)


def _texts(rng, n):
    pool = ["".join(rng.choice("abcdé 漢") for _ in range(rng.randrange(15, 160))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(5, 80))) for _ in range(rng.randrange(0, 6))]
        out.append("".join(p[rng.randrange(0, 5):] for p in parts))
    return out + ["a" * 200, "a" * 230, "ab" * 120, "b" + "ab" * 100, "", "short"]


def _got(docs, **kw):
    rows, c = suffixdedup.without_repeats(docs, **kw)
    return sorted((r["doc_id"], tuple(zip(r[c["starts"]] or [], r[c["ends"]] or [])), bytes(r[c["kept"]])) for r in rows.collect())


def test_spans_match_brute_force(spark):
    rng = random.Random(7)
    rows = list(enumerate(_texts(rng, 160)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, kept int").repartition(5)
    raw = [(i, t.encode()) for i, t in rows]
    for length, hot in ((50, 20_000), (50, 3), (33, 20_000), (100, 1)):
        assert _got(docs, length=length, hot=hot) == _brute(raw, length), (length, hot)


def test_work_in_many_groups(spark, monkeypatch):
    for name, value in (("ANCHORS", 300), ("RECORDS", 100), ("TEXT_BYTES", 2000)):
        monkeypatch.setattr(suffixdedup, name, value)
    rng = random.Random(3)
    rows = list(enumerate(_texts(rng, 120)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert _got(docs, length=50) == _brute([(i, t.encode()) for i, t in rows], 50)


def test_long_rows_are_cut_into_overlapping_parts(monkeypatch):
    monkeypatch.setattr(suffixdedup, "_SPAN", 256)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 40, 2000, 2000, 3000])
    row, place, first, last, _ = suffixdedup.anchors(data, offsets, 50)
    windows = {(r, w): p for r, p, a, b in zip(row, place, first, last) for w in range(a, b + 1)}
    assert len(windows) == (last - first + 1).sum() == sum(max(0, n - 49) for n in np.diff(offsets))
    strings = {}
    for (r, w), p in windows.items():  # equal windows have their anchor at the same place
        raw = data[offsets[r] + w:offsets[r] + w + 50].tobytes()
        assert strings.setdefault(raw, p - w) == p - w and 0 <= p - w <= 34


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(4)
    around = rng.integers(0, 2, (60, 90)).astype(np.uint8)
    around[30:50] = around[7]
    suffixes = suffixdedup._Suffixes(around, 50)
    size = np.array([1, 2, 3, 14, 40])
    record = np.concatenate([rng.permutation(60)[:n] for n in size])
    col = np.repeat([0, 5, 9, 20, 40], size)
    begin = np.repeat(np.cumsum(size) - size, size)
    order = suffixdedup.merge_sort(suffixes, record, col, begin, np.repeat(size, size))
    for s, n in zip(np.cumsum(size) - size, size):
        got = [around[record[i], col[i]:col[i] + 50].tobytes() for i in order[s:s + n]]
        assert got == sorted(got) and sorted(order[s:s + n]) == list(range(s, s + n))


def test_odd_rows(odd_docs):
    rows, c = suffixdedup.without_repeats(odd_docs)
    assert rows.columns[:len(odd_docs.columns)] == odd_docs.columns
    big = 1 << 62
    raw = [(r["doc_id"] if r["doc_id"] is not None else big, (r["text"] or "").encode()) for r in odd_docs.collect()]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else big, tuple(zip(r[c["starts"]] or [], r[c["ends"]] or [])), bytes(r[c["kept"]])) for r in rows.collect())
    assert got == _brute(raw, 50)


def test_whole_characters_stay(spark):
    passage = "é漢字ü" * 30
    docs = spark.createDataFrame([(1, "x" + passage), (2, "ab" + passage + "è" + "tail"), (3, "z" * 60)], "doc_id bigint, text string")
    rows, c = suffixdedup.without_repeats(docs, whole_characters=True)
    kept = {r["doc_id"]: bytes(r[c["kept"]]).decode() for r in rows.collect()}
    assert kept[1] == "x" + passage and kept[2] == "ab" + "ètail" and kept[3] == "z" * 60


def test_empty(no_docs):
    rows, _ = suffixdedup.without_repeats(no_docs)
    assert rows.count() == 0


def test_extensions_and_suffix_sort_agree():
    rng = np.random.default_rng(9)
    for length in (50, 33):
        left = length - suffixdedup.GRAM
        n = 400
        around = rng.integers(0, 2, (n, left + length)).astype(np.uint8)
        group = np.sort(rng.integers(0, 120, n))
        first = np.searchsorted(group, group)
        for i in range(n):  # agree with the group's first record on a stretch around the anchor
            a, b = rng.integers(0, left + 1), rng.integers(left + suffixdedup.GRAM, left + length + 1)
            around[i, a:b] = around[first[i], a:b]
        low = -rng.integers(0, left + 1, n)
        high = np.minimum(0, low + rng.integers(0, left + 1, n))
        rank = rng.integers(0, 30, n)
        want = np.zeros((n, left + 1), bool)
        for i in range(n):
            for j in np.flatnonzero((group == group[i]) & (rank < rank[i])):
                for c in range(max(low[i], low[j]) + left, min(high[i], high[j]) + left + 1):
                    want[i, c] |= (around[i, c:c + length] == around[j, c:c + length]).all()
        assert (suffixdedup._by_suffix_sort(around, group, low, high, rank, length) == want).all()
        few = np.bincount(group)[group] <= suffixdedup.FEW
        got = suffixdedup._by_extension(around[few], group[few], low[few], high[few], rank[few], length)
        assert (got == want[few]).all() and want.any()


def test_working_space_is_bounded():
    """Anchors of a buffer are found, and surroundings gathered, in parts: an executor's tasks hold tens of MB, not hundreds."""
    import tracemalloc

    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 4_000_000).astype(np.uint8)
    offsets = np.append(np.arange(0, 4_000_000, 50_000), 4_000_000)
    suffixdedup._tables()
    tracemalloc.start()
    row, place, first, last, gram = suffixdedup.anchors(data, offsets, 100)
    found = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    many = slice(0, 60_000)
    at = (place + offsets[row])[many]
    before = tracemalloc.get_traced_memory()[0]
    around = suffixdedup._around(data, at, (first - place)[many], (last - place)[many], 100)
    gathered = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert found < 100e6 and gathered < 60e6, (found, gathered)
    for i in (0, 777, 59_999):
        a, b = int(first[i] - place[i]), int(last[i] - place[i]) + 100
        want = np.zeros(184, np.uint8)
        want[a + 84:b + 84] = data[at[i] + a:at[i] + b]
        assert (around[i] == want).all()


def test_only_texts_that_lose_something_go_to_python(spark):
    docs = spark.createDataFrame([(1, "abc\u00e9d", [1], [5]), (2, "whole", None, None), (3, None, None, None)], "id int, text string, starts array<bigint>, ends array<bigint>")
    out = docs.select("id", suffixdedup.cut(docs.text, docs.starts, docs.ends).alias("kept"))
    assert [bytes(r["kept"]) for r in out.orderBy("id").collect()] == [b"ad", b"whole", b""]
    assert "CASE WHEN" in next(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in x or "Project" in x and "starts" in x)


def test_parts_of_a_row_give_the_anchors_of_the_whole(monkeypatch):
    rng = np.random.default_rng(8)
    sizes = [3000, 0, 49, 50, 51, 700, 1, 260]
    data, offsets = rng.integers(97, 101, sum(sizes)).astype(np.uint8), np.cumsum([0] + sizes)
    whole = suffixdedup.anchors(data, offsets, 50)
    monkeypatch.setattr(suffixdedup, "_SPAN", 256)
    assert all((a == b).all() for a, b in zip(whole, suffixdedup.anchors(data, offsets, 50)))  # an anchor on a border is found once
    covered = np.concatenate([np.arange(a, b + 1) + offsets[r] for r, _, a, b, _ in zip(*whole)])
    assert (np.sort(covered) == np.concatenate([offsets[r] + np.arange(max(0, n - 49)) for r, n in enumerate(sizes)])).all()  # every window has one


def test_suffixes_that_differ_in_their_first_bytes_are_not_merged(monkeypatch):
    rng = np.random.default_rng(9)
    around = rng.integers(0, 256, (400, 84)).astype(np.uint8)
    around[::2, 34:] = around[0, 34:]  # half of the records share all that follows the anchor's place
    around[::5] = around[0]
    n, compared = len(around), []
    before = suffixdedup._Suffixes.before
    monkeypatch.setattr(suffixdedup._Suffixes, "before", lambda self, x, *more: compared.append(len(x)) or before(self, x, *more))
    low, high = np.full(n, -34), np.zeros(n, np.int64)
    gone = suffixdedup._by_suffix_sort(around, np.zeros(n, np.int64), low, high, np.arange(n), 50)
    first = {}
    want = np.array([[first.setdefault((c, around[r, c:c + 50].tobytes()), r) < r for c in range(35)] for r in range(n)])
    assert (gone == want).all() and sum(compared) < 100_000  # merging 35 columns of 400 suffixes takes several times as many
