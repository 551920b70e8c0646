"""Exact removal of repeated substrings with a hash-compared suffix sort.

A byte is removed when a string of ``length`` bytes that covers it also starts in a document with a smaller id.

1. Anchors. In every window of ``length`` bytes the 16-byte string with the least hash is its anchor, so equal windows
   have equal anchors at equal places. Anchors are dealt by hash; those found in two documents or more are kept.
2. Suffix sort. Of each kept anchor the surrounding bytes, as far as windows with this anchor reach, meet in one
   group. The suffixes that start at its windows are put in order by their first eight bytes, and where these agree by a mergesort
   that compares two of them by their longest common extension: binary search over prefix polynomial hashes (unless all ``length``
   bytes agree by hash), then one byte. Neighbours that agree in ``length`` bytes by hash are compared byte by byte. In each class all but the smallest document's windows go.
3. Runs of removed windows are joined to spans and cut from the texts.

Skew: where records are made, equal surroundings are first reduced to the smallest document of the batch
(the others' windows go at once); an anchor with more than ``hot`` places is not a group at all: each of its
windows is a record of its own, dealt by the window's hash.

Defined results: null texts are empty; ids are read as whole numbers, a null id counts as larger than any; rows with
equal ids don't remove from each other, and fully repeated rows are judged alike; texts shorter than ``length``
lose nothing; an empty table gives an empty result; columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, giving_back, mix64, prepare, row_blocks, stored, temp, text_buffer

LENGTH = 50
GRAM = 16
#: places of one anchor above which its windows are dealt one by one
HOT = 20_000
#: records of a group that are compared two by two
FEW = 12
#: anchors, records and text bytes of one group of work
ANCHORS, RECORDS, TEXT_BYTES = 1_500_000, 100_000, 8_000_000
#: documents whose anchors are dealt out together
BATCH_ROWS = 2500
#: records whose surroundings are gathered together
GATHERED = 8192
#: bytes of surroundings that are compared together
COMPARED = 2_500_000
#: bytes whose anchors are found together, each with some hundred bytes of working space that should stay in a core's cache; places in them have 22 bits
_SPAN = 1 << 16
_TABLE = (1 << 19) + 4096
_BASE = 0x9E3779B97F4A7C15
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _last(table: pa.Table) -> pa.Table:
    give_back()
    return table


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not _TABLES:
        n = _TABLE
        _TABLES.update(up=_powers(_BASE, n), down=_powers(pow(_BASE, -1, 1 << 64), n))
    return _TABLES["up"], _TABLES["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of ``data``."""
    up, _ = _tables()
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:len(data)], out=out[1:])
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` neighbours."""
    p = 1
    while 2 * p <= width:
        values = np.minimum(values[:-p], values[p:])
        p *= 2
    rest = width - p
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, place, first window, last window and hash of every anchor; places count from the row's start."""
    _, down = _tables()
    width = length - GRAM + 1
    found: list[tuple[np.ndarray, ...]] = []
    for a, b in row_blocks(offsets, _SPAN):
        lo, hi = int(offsets[a]), int(offsets[b])
        for start in range(lo, hi, _SPAN):  # a longer row is cut into parts that overlap by one window
            stop = min(hi, start + _SPAN + length - 1)
            part = data[start:stop]
            if len(part) < length:
                continue
            sums = prefix_hashes(part)
            gram = mix64((sums[GRAM:] - sums[:-GRAM]) * down[:len(part) - GRAM + 1])
            place = np.arange(len(gram), dtype=np.uint64)
            best = (_least((gram >> np.uint64(22) << np.uint64(22)) | place, width) & np.uint64((1 << 22) - 1)).view(np.int64)
            over = (offsets[a + 1:b + 1, None] - start - np.arange(1, length)).ravel()  # windows that reach into the next row
            best[over[(over >= 0) & (over < len(best))]] = -1
            turn = np.append(0, np.flatnonzero(best[1:] != best[:-1]) + 1)  # between two rows there are such windows
            last = np.append(turn[1:], len(best)) - 1
            some = best[turn] >= 0
            turn, last = turn[some], last[some]
            at, own = best[turn], a + np.searchsorted(offsets[a:b + 1], turn + start, "right") - 1
            shift = start - offsets[own]
            found.append((own, at + shift, turn + shift, last + shift, gram[at]))
    if not found:
        return tuple(np.zeros(0, np.uint64 if i == 4 else np.int64) for i in range(5))
    own, at, first, last, gram = (np.concatenate(c) for c in zip(*found))
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1])))[:len(own)]  # an anchor's windows may lie in two parts
    return own[new], at[new], first[new], last[np.append(new[1:], len(own)) - 1], gram[new]


def _key(gram: np.ndarray) -> np.ndarray:
    """Hash that deals anchors out (the anchor's own hash is small, being a minimum)."""
    return mix64(gram ^ np.uint64(0xA0761D6478BD642F))


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, which compresses well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the (ordered) numbers of its members."""
    order = np.argsort(bucket, kind="stable")
    starts = _runs(bucket[order])
    for s, e in zip(starts, np.append(starts[1:], len(order))):
        if e > s:
            yield int(bucket[order[s]]), order[s:e]


ANCHOR_ROWS = "bucket bigint, keys binary, ids binary, counts binary, places binary"


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Per batch and bucket: 5-byte remainders of the anchors' hashes, the documents that hold them, and their places."""
    for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
        ids = batch.column(0).to_numpy().view(np.uint64)
        row, place, _, _, gram = anchors(*text_buffer(batch.column(1)), length)
        key = _key(gram)
        out: dict[str, list] = {"bucket": [], "keys": [], "ids": [], "counts": [], "places": []}
        for bucket, at in _split((key >> np.uint64(40)) % np.uint64(buckets)):
            rows, counts = np.unique(row[at], return_counts=True)  # members come in row order
            out["bucket"].append(bucket)
            out["keys"].append(key[at].view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            out["ids"].append(ids[rows].tobytes())
            out["counts"].append(_planes(counts))
            out["places"].append(_planes(place[at]))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64())] + [(c, pa.binary()) for c in ("keys", "ids", "counts", "places")]))


SHARED_ROWS = "part bigint, n bigint, ids binary, places binary"


def _shared_rows(table: pa.Table, parts: int, hot: int) -> pa.Table:
    """Of one bucket the places of anchors that two documents or more hold, by part of the documents."""
    keys, ids, places = [], [], []
    for k, d, c, p in zip(*(table.column(n).to_pylist() for n in ("keys", "ids", "counts", "places"))):
        five = np.frombuffer(k, np.uint8).reshape(-1, 5)
        wide = np.zeros((len(five), 8), np.uint8)
        wide[:, :5] = five
        keys.append(wide.view(np.uint64).ravel())
        ids.append(np.repeat(np.frombuffer(d, np.uint64), _from_planes(c)))
        places.append(_from_planes(p))
    key, doc, place = (np.concatenate(x) for x in (keys, ids, places))
    order = np.argsort(key, kind="stable")
    doc, place, starts = doc[order], place[order], _runs(key[order])
    size = np.diff(np.append(starts, len(order)))
    kept = np.repeat(np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts), size)
    flag = (place.astype(np.uint32) << np.uint32(1)) | np.repeat(size > hot, size).astype(np.uint32)
    doc, flag = doc[kept], flag[kept]
    order = np.argsort(doc, kind="stable")
    doc, flag = doc[order], flag[order]
    out: dict[str, list] = {"part": [], "n": [], "ids": [], "places": []}
    for part, at in _split(doc % np.uint64(parts)):
        out["part"].append(part)
        out["n"].append(len(at))
        out["ids"].append(doc[at].tobytes())
        out["places"].append(flag[at].tobytes())
    return pa.table(out, schema=pa.schema([("part", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("places", pa.binary())]))


RECORD_ROWS = "bucket bigint, whole boolean, keys binary, low binary, high binary, of binary, place binary, ids binary, ranks binary, bytes binary"
_RECORD_SCHEMA = pa.schema([("bucket", pa.int64()), ("whole", pa.bool_())] + [(c, pa.binary()) for c in ("keys", "low", "high", "of", "place", "ids", "ranks", "bytes")])


def _context_hash(around: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> np.ndarray:
    up, _ = _tables()
    total = np.zeros(len(around), np.uint64)
    for c in range(around.shape[1]):
        total += _VALUE[around[:, c]] * up[c]
    return mix64(total ^ key) + mix64((low * 65536 + high).astype(np.uint64))


def _first_of_equal(around: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, rank: np.ndarray, code: np.ndarray | None = None) -> np.ndarray:
    """For each record the one of the smallest document with the same key and surroundings (itself, if none is equal byte by byte)."""
    code = _context_hash(around, low, high, key) if code is None else code
    order = np.lexsort((rank, code))
    starts = _runs(code[order])
    lead = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    same = (around[order] == around[lead]).all(1) & (low[order] == low[lead]) & (high[order] == high[lead]) & (key[order] == key[lead])
    out = np.empty(len(order), np.int64)
    out[order] = np.where(same, lead, order)
    return out


def _around(data: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Bytes of the windows ``low`` to ``high`` (relative to the anchor), one row each, zero elsewhere; the anchor is at column length - GRAM."""
    left = length - GRAM
    col = np.arange(-left, length)
    out = np.zeros((len(place), left + length), np.uint8)
    for a in range(0, len(place), GATHERED):  # an index takes eight times the bytes that it fetches
        s = slice(a, a + GATHERED)
        inside = (col[None, :] >= low[s, None]) & (col[None, :] < high[s, None] + length)
        out[s][inside] = data[(place[s, None] + col[None, :])[inside]]
    return out


def _record_rows(texts: pa.Table, shared: pa.Table, length: int, buckets: int) -> pa.Table:
    """Records of the kept anchors of one part of the documents: surroundings, dealt by hash; and windows that go at once."""
    empty = _RECORD_SCHEMA.empty_table()
    if not texts.num_rows or not shared.num_rows:
        return empty
    ids = np.concatenate([np.frombuffer(x, np.uint64) for x in shared.column("ids").to_pylist()])
    flags = np.concatenate([np.frombuffer(x, np.uint32) for x in shared.column("places").to_pylist()])
    known, first = np.unique(texts.column("id").to_numpy().view(np.uint64), return_index=True)
    first = first[np.isin(known, ids)]
    texts = texts.take(pa.array(np.sort(first))).combine_chunks()
    own = texts.column("id").to_numpy().view(np.uint64)
    rank = texts.column("rank").to_numpy()
    column = texts.column("text").chunk(0)
    data, offsets = text_buffer(column)
    row, place, first_w, last_w, gram = anchors(data, offsets, length)
    spot = np.argsort(own)
    wanted = (spot[np.searchsorted(own[spot], ids)].astype(np.uint64) << np.uint64(32)) | (flags >> np.uint32(1))
    order = np.argsort(wanted)
    wanted, hot_flag = wanted[order], (flags[order] & np.uint32(1)).astype(bool)
    mine = (row.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
    hit = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
    kept = np.flatnonzero(wanted[hit] == mine)
    hot = hot_flag[hit[kept]]
    row, place, first_w, last_w, gram = (x[kept] for x in (row, place, first_w, last_w, gram))
    low, high = first_w - place, last_w - place
    key = _key(gram)
    # the windows of hot anchors become records of their own
    n = np.where(hot, high - low + 1, 1)
    of = np.repeat(np.arange(len(row)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    single = hot[of]
    row, place, key = row[of], place[of], key[of]
    low = low[of] + np.where(single, step, 0)
    high = np.where(single, low, high[of])
    out: list[dict] = []
    for a in range(0, len(row), 100_000):
        s = slice(a, a + 100_000)
        r, p, lo, hi, k, one = row[s], place[s], low[s], high[s], key[s].copy(), single[s]
        c = _around(data, p + offsets[r], lo, hi, length)
        h = _context_hash(c, lo, hi, np.where(one, np.uint64(1), k))
        k[one] = mix64(h[one])
        # equal surroundings: only the smallest document's need to be compared with the others'
        gone = rank[r] > rank[r[_first_of_equal(c, lo, hi, k, rank[r], h)]]
        sent = np.flatnonzero(~gone)
        for whole, members in ((False, sent), (True, np.flatnonzero(gone))):
            to = (k[members] >> np.uint64(40)) % np.uint64(buckets) if not whole else np.full(len(members), int(own[0] % np.uint64(buckets)), np.uint64)
            for bucket, at in _split(to):
                at = members[at]
                docs, of_doc = np.unique(r[at], return_inverse=True)
                col = np.arange(c.shape[1]) - (length - GRAM)
                inside = (col[None, :] >= lo[at][:, None]) & (col[None, :] < hi[at][:, None] + length)
                out.append({"bucket": bucket, "whole": whole, "keys": b"" if whole else k[at].tobytes(), "low": lo[at].astype(np.int16).tobytes(),
                            "high": hi[at].astype(np.int16).tobytes(), "of": of_doc.astype(np.uint32).tobytes(), "place": p[at].astype(np.uint32).tobytes(),
                            "ids": own[docs].tobytes(), "ranks": rank[docs].tobytes(), "bytes": b"" if whole else pa.compress(c[at][inside].tobytes(), "zstd", asbytes=True)})
    return pa.Table.from_pylist(out, schema=_RECORD_SCHEMA) if out else empty


class _Suffixes:
    """Suffixes (record, column) of a byte matrix, compared by prefix hashes."""

    def __init__(self, around: np.ndarray, length: int):
        up, _ = _tables()
        self.around, self.length, self.width = around, length, around.shape[1] + 1
        sums = np.zeros((len(around), self.width), np.uint64)
        np.cumsum(_VALUE[around] * up[None, :around.shape[1]], axis=1, out=sums[:, 1:])
        self.sums, self.bytes = sums.ravel(), np.ascontiguousarray(around).ravel()
        padded = np.concatenate([self.bytes, np.zeros(8, np.uint8)])  # a suffix has more than eight bytes, so a word ends inside its record
        self.words = np.ndarray((len(self.bytes) + 1,), "<u8", padded, strides=(1,))

    def common(self, x: np.ndarray, y: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Longest common extension of records x and y from a column on, by binary search (at most ``length``)."""
        a, b = x * self.width + col, y * self.width + col
        base = self.sums[a] - self.sums[b]
        out = np.full(len(x), self.length)
        short = np.flatnonzero(self.sums[a + self.length] - self.sums[b + self.length] != base)
        a, b, base = a[short], b[short], base[short]
        lo, hi = np.zeros(len(short), np.int64), np.full(len(short), self.length - 1)
        for _ in range(int(self.length - 1).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.sums[a + mid] - self.sums[b + mid] == base
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        out[short] = lo
        return out

    def common_left(self, x: np.ndarray, y: np.ndarray, col: int, most: np.ndarray) -> np.ndarray:
        """Longest common extension of records x and y to the left of a column, at most ``most`` each."""
        a, b = x * self.width + col, y * self.width + col
        base = self.sums[a] - self.sums[b]
        lo, hi = np.zeros(len(x), np.int64), most.astype(np.int64)
        for _ in range(int(col).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.sums[a - mid] - self.sums[b - mid] == base
            lo, hi = np.where(same, mid, lo), np.where(same, hi, np.maximum(mid - 1, lo))
        return lo

    def before(self, x: np.ndarray, y: np.ndarray, col: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before suffix y; equal suffixes do where ``ties``."""
        far = self.common(x, y, col)
        equal = far == self.length
        w = self.width - 1
        at = col + np.where(equal, 0, far)
        return np.where(equal, ties, self.bytes[x * w + at] < self.bytes[y * w + at])

    def word(self, x: np.ndarray, col: np.ndarray) -> np.ndarray:
        """First eight bytes of suffixes, as numbers in the order of the suffixes."""
        return self.words[x * (self.width - 1) + col].byteswap()

    def same(self, x: np.ndarray, y: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Whether two suffixes agree in ``length`` bytes: by hash, then byte by byte."""
        out = self.common(x, y, col) == self.length
        w, span = self.width - 1, np.arange(self.length)
        for a in range(0, len(x), 1 << 16):
            check = a + np.flatnonzero(out[a:a + (1 << 16)])
            i = (x[check] * w + col[check])[:, None] + span
            j = (y[check] * w + col[check])[:, None] + span
            out[check] = (self.bytes[i] == self.bytes[j]).all(1)
        return out


def merge_sort(suffixes: _Suffixes, record: np.ndarray, col: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the suffixes inside their segments (``start`` and ``size`` per element): bottom-up merges, all segments at once."""
    order = np.arange(len(record))
    width = 1
    while True:
        at = np.flatnonzero(size > width)
        if not len(at):
            return order
        x, s, n = order[at], start[at], size[at]
        p = at - s
        run = p // width
        other = run ^ 1
        first = np.minimum(other * width, n)
        lo, hi = first.copy(), np.minimum((other + 1) * width, n)
        right = (run & 1).astype(bool)  # of equal suffixes the left run's come first
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            e = x[open_]
            y = order[s[open_] + mid]
            less = suffixes.before(record[y], record[e], col[e], right[open_])
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        merged = order.copy()
        merged[s + (run & ~1) * width + p - run * width + lo - first] = x
        order = merged
        width *= 2


def repeated_windows(around: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each record and window column, whether a smaller document of its group has the same window.

    Records of a group are neighbours. Windows are sorted as suffixes, except in groups of a few records: there the common
    extensions of two records' anchors, to the right and to the left, tell all windows that they share.
    """
    size = np.bincount(group)[group]
    few = size <= FEW
    gone = np.zeros((len(around), length - GRAM + 1), bool)
    for at, how in ((np.flatnonzero(few & (size > 1)), _by_extension), (np.flatnonzero(~few), _by_suffix_sort)):
        if len(at):
            gone[at] = how(around[at], group[at], low[at], high[at], rank[at], length)
    return gone


def _by_extension(around: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Windows that each record shares with a smaller document's record, at most FEW - 1 comparisons for a record."""
    left = length - GRAM
    suffixes = _Suffixes(around, length)
    edges = np.zeros((len(around), left + 2), np.int64)
    for step in range(1, FEW):
        x = np.flatnonzero(group[step:] == group[:-step]) if len(group) > step else np.zeros(0, np.int64)
        y = x + step
        some = rank[x] != rank[y]
        x, y = x[some], y[some]
        x, y = np.where(rank[x] > rank[y], x, y), np.where(rank[x] > rank[y], y, x)  # x may lose windows to y
        first, last = np.maximum(low[x], low[y]) + left, np.minimum(high[x], high[y]) + left
        some = first <= last
        x, y, first, last = x[some], y[some], first[some], last[some]
        if not len(x):
            continue
        right = suffixes.common(x, y, np.full(len(x), left))
        begin = np.maximum(first, left - suffixes.common_left(x, y, left, left - first))
        end = np.minimum(last, left + right - length)  # column of the last shared window
        some = begin <= end
        x, y, begin, end = x[some], y[some], begin[some], end[some]
        col = np.arange(around.shape[1])
        inside = (col[None, :] >= begin[:, None]) & (col[None, :] < end[:, None] + length)
        true = ((around[x] == around[y]) | ~inside).all(1)  # equal hashes, equal bytes
        np.add.at(edges, (x[true], begin[true]), 1)
        np.add.at(edges, (x[true], end[true] + 1), -1)
        if not true.all():  # a hash collision: those records are sorted, with every comparison checked
            odd = np.isin(group, group[x[~true]])
            edges[odd] = 0
            edges[odd, :-1] = np.diff(_by_suffix_sort(around[odd], group[odd], low[odd], high[odd], rank[odd], length).astype(np.int64), prepend=0, axis=1)
    return np.cumsum(edges, axis=1)[:, :-1] > 0


def _by_suffix_sort(around: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    left = length - GRAM
    gone = np.zeros((len(around), left + 1), bool)
    n = high - low + 1
    record = np.repeat(np.arange(len(around)), n)
    col = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n) + low[record] + left
    segment = group[record] * (left + 1) + col
    order = np.argsort(segment, kind="stable")
    record, col, segment = record[order], col[order], segment[order]
    starts = _runs(segment)
    size = np.diff(np.append(starts, len(segment)))
    several = np.repeat(size > 1, size)
    record, col = record[several], col[several]
    size = size[size > 1]
    if not len(record):
        return gone
    begin = np.cumsum(size) - size
    suffixes = _Suffixes(around, length)
    # suffixes that differ in their first bytes are in order at once, the others are merged
    word, segment = suffixes.word(record, col), np.repeat(np.arange(len(size)), size)
    order = np.lexsort((word, segment))
    record, col, word = record[order], col[order], word[order]
    starts = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (segment[1:] != segment[:-1])))
    size = np.diff(np.append(starts, len(word)))
    order = merge_sort(suffixes, record, col, np.repeat(starts, size), np.repeat(size, size))
    record, col = record[order], col[order]
    new = np.ones(len(record), bool)
    new[1:] = ~((col[1:] == col[:-1]) & suffixes.same(record[:-1], record[1:], np.minimum(col[:-1], col[1:])))
    new[begin] = True
    starts = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(rank[record], starts), np.diff(np.append(starts, len(record))))
    gone[record, col] = rank[record] > least
    return gone


SPAN_ROWS = "part bigint, ids binary, starts binary, ends binary"
_SPAN_SCHEMA = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])


def _span_rows(table: pa.Table, length: int, parts: int) -> pa.Table:
    """Of one bucket's records the runs of windows that go, by part of the documents."""
    left = length - GRAM
    ids, starts, ends = [], [], []
    fields: list[list[np.ndarray]] = [[] for _ in range(7)]
    for r in table.to_pylist():
        of = np.frombuffer(r["of"], np.uint32)
        low, high = (np.frombuffer(r[c], np.int16).astype(np.int64) for c in ("low", "high"))
        place, doc = np.frombuffer(r["place"], np.uint32).astype(np.int64), np.frombuffer(r["ids"], np.uint64)[of]
        raw = b"" if r["whole"] else pa.decompress(r["bytes"], int((high - low + length).sum()), "zstd", asbytes=True)
        if r["whole"]:
            ids.append(doc)
            starts.append(place + low)
            ends.append(place + high + length)
        else:
            for f, v in zip(fields, (np.frombuffer(r["keys"], np.uint64), low, high, place, doc, np.frombuffer(r["ranks"], np.int64)[of], np.frombuffer(raw, np.uint8))):
                f.append(v)
    if fields[0]:
        key, low, high, place, doc, rank, raw = (np.concatenate(f) for f in fields)
        ends_at = np.cumsum(high - low + length)
        order = np.argsort(key, kind="stable")
        starts_at = _runs(key[order])
        size = np.diff(np.append(starts_at, len(order)))
        # groups of one record have nothing to be compared with
        several = size > 1
        groups, size = starts_at[several], size[several]
        cuts = [0]
        total = np.cumsum(size)
        most = COMPARED // (left + length)
        while cuts[-1] < len(size):  # whole groups, about so many records at a time
            done = total[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, done + most, "right"))))
        col = np.arange(-left, length)
        for a, b in zip(cuts, cuts[1:]):
            n = size[a:b]
            at = order[np.repeat(groups[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            lo, hi = low[at], high[at]
            inside = (col[None, :] >= lo[:, None]) & (col[None, :] < hi[:, None] + length)
            many = hi - lo + length
            around = np.zeros((len(at), left + length), np.uint8)
            around[inside] = raw[np.repeat(ends_at[at] - many - np.cumsum(many) + many, many) + np.arange(many.sum())]
            # equal surroundings: the smallest document's stand for all
            lead = _first_of_equal(around, lo, hi, key[at], rank[at])
            whole = rank[at] > rank[at[lead]]
            ids.append(doc[at[whole]])
            starts.append(place[at[whole]] + lo[whole])
            ends.append(place[at[whole]] + hi[whole] + length)
            at, lo, hi, around, group = at[~whole], lo[~whole], hi[~whole], around[~whole], np.repeat(np.arange(b - a), n)[~whole]
            gone = repeated_windows(around, group, lo, hi, rank[at], length)
            edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            of, first = np.nonzero(edge == 1)
            _, last = np.nonzero(edge == -1)
            ids.append(doc[at[of]])
            starts.append(place[at[of]] + first - left)
            ends.append(place[at[of]] + last - left - 1 + length)
    if not ids:
        return _SPAN_SCHEMA.empty_table()
    doc, first, last = (np.concatenate(x) for x in (ids, starts, ends))
    out: dict[str, list] = {c: [] for c in _SPAN_SCHEMA.names}
    for part, at in _split(doc % np.uint64(parts)):
        out["part"].append(part)
        out["ids"].append(doc[at].tobytes())
        out["starts"].append(first[at].astype(np.uint32).tobytes())
        out["ends"].append(last[at].astype(np.uint32).tobytes())
    return pa.table(out, schema=_SPAN_SCHEMA)


def _joined_spans(table: pa.Table) -> pa.Table:
    """Maximal removed spans of each document of one part."""
    doc, start, end = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]).astype(w) for c, t, w in
                       (("ids", np.uint64, np.uint64), ("starts", np.uint32, np.int64), ("ends", np.uint32, np.int64)))
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    firsts = _runs(doc)
    number = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(doc))))
    base = number * (1 << 32)  # one running maximum serves all documents
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(new)
    close = reach[np.append(at[1:], len(doc)) - 1] - base[at]
    per = np.concatenate([[0], np.cumsum(np.bincount(number[at], minlength=len(firsts)))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(per), pa.array(x, pa.int64())) for x in (start[at], close)]
    return pa.table([pa.array(doc[firsts].view(np.int64)), *lists], names=["id", "starts", "ends"])


def _id(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id (hash of id and text), starts, ends: the maximal spans of bytes to remove, for documents that lose any."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.filter(F.octet_length(text_col) >= length).select(
        _id(id_col, text_col).alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit((1 << 63) - 1)).alias("rank"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    per_anchor = (length - GRAM + 2) / 2
    buckets = max(1, round(size / per_anchor / ANCHORS))
    parts = max(1, round(size / TEXT_BYTES))
    found = rows.select("id", "text").mapInArrow(lambda batches: giving_back(_anchor_rows(batches, length, buckets)), ANCHOR_ROWS)
    shared = stored(found.groupBy("bucket").applyInArrow(lambda t: _last(_shared_rows(t, parts, hot)), SHARED_ROWS), "shared")
    records = max(1, round((shared.agg(F.sum("n")).first()[0] or 0) / RECORDS))
    dealt = rows.withColumn("part", _unsigned_mod("id", parts))
    made = dealt.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(lambda a, b: _last(_record_rows(a, b, length, records)), RECORD_ROWS)
    spans = made.groupBy("bucket").applyInArrow(lambda t: _last(_span_rows(t, length, parts)), SPAN_ROWS)
    return stored(spans.groupBy("part").applyInArrow(_joined_spans, "id bigint, starts array<bigint>, ends array<bigint>"), "spans")


def _unsigned_mod(col: str, n: int) -> Column:
    """The 64-bit number, read as unsigned, modulo n (as numpy does it)."""
    high, low = F.shiftrightunsigned(col, 32), F.col(col).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.pmod(high, F.lit(n)) * F.lit((1 << 32) % n) + F.pmod(low, F.lit(n)), F.lit(n)).cast("bigint")


def _whole_characters(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """Shrink a span until it cuts no UTF-8 character apart."""
    while start < end and raw[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def cut(text: Column, starts: Column, ends: Column, whole_characters: bool = False) -> Column:
    """Bytes of a text without the spans (null spans: all of them)."""
    @F.pandas_udf("binary")
    def run(texts, firsts, lasts):
        import pandas as pd

        out = []
        for t, a, b in zip(texts, firsts, lasts):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if a is not None:
                kept, at = [], 0
                for s, e in zip(a, b):
                    if whole_characters:
                        s, e = _whole_characters(raw, s, e)
                    kept.append(raw[at:s])
                    at = e
                raw = b"".join(kept) + raw[at:]
            out.append(raw)
        return pd.Series(out, dtype=object)
    # a text that loses nothing does not go to Python and back
    return F.when(starts.isNull(), F.coalesce(text, F.lit("")).cast("binary")).otherwise(run(F.when(starts.isNotNull(), text), starts, ends))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT,
                    whole_characters: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The input's rows and columns plus starts, ends (of the removed spans, null: none) and kept (bytes), under the names returned."""
    spans = repeated_spans(docs, length, id_col, text_col, hot)
    out = {c: temp(c) for c in ("starts", "ends", "kept")}
    own = temp("id")
    found = spans.select(F.col("id").alias(own), F.col("starts").alias(out["starts"]), F.col("ends").alias(out["ends"]))
    rows = docs.withColumn(own, _id(id_col, text_col)).join(found, own, "left").drop(own)
    return rows.withColumn(out["kept"], cut(F.col(text_col), F.col(out["starts"]), F.col(out["ends"]), whole_characters)), out
