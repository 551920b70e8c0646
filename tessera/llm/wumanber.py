"""Benchmark passages in documents: Wu-Manber multi-pattern search with words as symbols.

The test strings are the windows of the benchmark items: ``window`` consecutive words, or all words of a shorter
item. They are searched by length. A table gives every block of two words the distance by which the search may
move on without missing a window; where it is 0, the hash of the window's last block, with that of its first, selects
the few windows that can end there, and their words are compared byte for byte. Many search heads move through a
run of texts at a time.

On Spark: documents are read once and nothing is shuffled. The benchmark meets them in blocks of at most about
``BLOCK_BYTES`` (one, for usual benchmarks), each broadcast; with several blocks the results so far are written
between them.

Defined results: a null text or one without words has no words, no hits and no items; an item without words never
occurs; an item with a null id marks words but is not listed; rows with the same item id are one item; repeated
documents get the same result; further columns stay, also those that clash. Texts are read in parts of about 1 MB, cut
between words, so memory follows the longest word and not the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64, prepare, stored, temp, text_buffer
from tessera.llm.lexis import Words, ranges, runs, same, words_of

WINDOW = 10
#: bytes of benchmark text that are searched for together
BLOCK_BYTES = 4 << 20
#: words of one row of the parted benchmark
PART_WORDS = 2048
#: words that a search head looks after
LANE = 128
RESULT = "n_words bigint, spans array<struct<a: bigint, b: bigint>>, items array<string>"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a block of two words."""
    return mix64(a * _ONE + b * _TWO)


class Patterns:
    """The windows of one length with their shift table and buckets."""

    def __init__(self, words: Words, first: np.ndarray, length: int):
        self.words, self.length = words, length
        code = words.code
        ends = _block(code[first + max(length - 2, 0)], code[first + length - 1])
        starts = _block(code[first], code[first + min(1, length - 1)])
        key = mix64(ends * _ONE + starts)
        order = np.argsort(key, kind="stable")
        self.first, self.keys, self.order = first[order], key[order], order
        self.bits = np.uint64(64 - min(24, max(12, int(16 * len(first)).bit_length())))
        self.shift = np.full(1 << (64 - int(self.bits)), max(length - 1, 1), np.uint8)
        for j in range(min(1, length - 1), length):
            slot = _block(code[first + max(j - 1, 0)], code[first + j]) >> self.bits
            np.minimum.at(self.shift, slot, length - 1 - j)

    def stops(self, text: Words) -> np.ndarray:
        """Places of last words at which the shift table lets a window end."""
        code, n, back = text.code, len(text.code), min(1, self.length - 1)
        place = np.arange(self.length - 1, n, LANE)
        end = np.minimum(place + LANE, n)
        found = []
        while len(place):
            move = self.shift[_block(code[place - back], code[place]) >> self.bits]
            found.append(place[move == 0])
            place = place + np.maximum(move, 1)
            live = place < end
            place, end = place[live], end[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of the window) of every occurrence."""
        last, code = self.stops(text), text.code
        start = last - self.length + 1
        whole = text.row[start] == text.row[last]
        last, start = last[whole], start[whole]
        back = min(1, self.length - 1)
        key = mix64(_block(code[last - back], code[last]) * _ONE + _block(code[start], code[start + back]))
        of, hit = ranges(np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right"))
        for j in range(self.length):
            equal = same(text, start[of] + j, self.words, self.first[hit] + j)
            of, hit = of[equal], hit[equal]
        return start[of], self.order[hit]


class Searcher:
    """All windows of one block of the benchmark: (item id, words joined by blanks) pairs."""

    def __init__(self, parts: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.names = sorted({i for i, _ in parts if i is not None})
        number = {name: i for i, name in enumerate(self.names)}
        data = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)
        offsets = np.cumsum([0] + [len(p[1]) for p in parts])
        words = words_of(data, offsets)
        counts = np.bincount(words.row, minlength=len(parts))
        begin = np.cumsum(counts) - counts
        first: dict[int, list[int]] = {}
        owners: dict[int, list[set[int]]] = {}
        known: dict[bytes, tuple[int, int]] = {}
        raw = words.data.tobytes()
        for row, (name, _) in enumerate(parts):
            length = min(window, int(counts[row]))
            for w in range(begin[row], begin[row] + counts[row] - length + 1 if length else 0):
                end = w + length - 1
                text = raw[words.start[w]:words.start[end] + words.size[end]]
                if text not in known:
                    known[text] = length, len(first.setdefault(length, []))
                    first[length].append(w)
                    owners.setdefault(length, []).append(set())
                if name is not None:
                    owners[length][known[text][1]].add(number[name])
        self.kinds = []
        for length, at in first.items():
            sizes = np.array([len(o) for o in owners[length]])
            flat = np.array([x for o in owners[length] for x in sorted(o)], np.int64)
            self.kinds.append((Patterns(words, np.array(at), length), np.append(0, np.cumsum(sizes)), flat))

    def search(self, column) -> tuple[np.ndarray, ...]:
        """Words of each row; row, first and end word of every occurrence; row and item number of every item that occurs."""
        data, offsets = text_buffer(column)
        n = np.zeros(len(column), np.int64)
        rows, a, b, item_rows, items = ([np.zeros(0, np.int64)] for _ in range(5))
        for text in runs(data, offsets, self.window - 1):
            n += np.bincount(text.row[text.seen:], minlength=len(n))
            for kind, cuts, owners in self.kinds:
                start, pattern = kind.occurrences(text)
                rows.append(text.row[start])
                a.append(text.at[start])
                b.append(text.at[start] + kind.length)
                of, owner = ranges(cuts[pattern], cuts[pattern + 1])
                pair = np.unique(text.row[start][of] * max(1, len(self.names)) + owners[owner])
                item_rows.append(pair // max(1, len(self.names)))
                items.append(pair % max(1, len(self.names)))
        pair = np.unique(np.concatenate(item_rows) * max(1, len(self.names)) + np.concatenate(items))
        return n, np.concatenate(rows), np.concatenate(a), np.concatenate(b), pair // max(1, len(self.names)), pair % max(1, len(self.names))


def _lists(row: np.ndarray, n: int, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), values)


def span_lists(row: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> pa.ListArray:
    """Spans of ``n`` rows, sorted, those that meet joined."""
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    wide = int(b.max()) + 2 if len(b) else 1
    upto = np.maximum.accumulate(row * wide + b) if len(b) else b
    opens = np.ones(len(row), bool)
    opens[1:] = row[1:] * wide + a[1:] > upto[:-1]
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(row)) - 1 if len(at) else at
    spans = pa.StructArray.from_arrays([pa.array(a[at], pa.int64()), pa.array((upto[last] - row[last] * wide), pa.int64())], ["a", "b"])
    return _lists(row[at], n, spans)


_READY: dict[str, Searcher] = {}


def _searching(parts, window: int):
    """Arrow function from texts to results; a worker builds the tables of a block once."""
    key = temp("block")

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Searcher(parts.value, window)
        searcher = _READY[key]
        names = pa.array(searcher.names, pa.string())
        for part in texts:
            n, row, a, b, item_row, item = searcher.search(part)
            yield pa.StructArray.from_arrays([pa.array(n), span_lists(row, a, b, len(n)), _lists(item_row, len(n), names.take(pa.array(item)))],
                                             ["n_words", "spans", "items"])
    return run


def _joined(lists: pa.Array) -> pa.Array:
    """Each row's spans sorted, those that meet joined."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    a, b = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    return span_lists(row, a, b, len(lists))


def parted(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item, words: the items' words, long items in rows that overlap so that each window lies in one of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _WORD.findall((text or "").encode().lower())
                for at in range(0, max(min(len(words), 1), len(words) - window + 1), PART_WORDS):
                    ids.append(name)
                    parts.append(b" ".join(words[at:at + PART_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.binary())], names=["item", "words"])

    return items.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "item string, words binary")


def occurrences(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text",
                window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """The input's rows and columns plus, under the names returned, n_words, spans and items.

    ``spans`` are the runs of words (a: first, b: end) inside any occurrence of a window, ``items`` the ids, as sorted strings, of
    the items that have one.
    """
    spark = docs.sparkSession
    prepare(spark)
    out = {k: temp(k) for k in ("n_words", "spans", "items")}
    parts = stored(parted(items, id_col, item_text_col, window).distinct(), "windows")
    total = parts.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    rows, got = docs, temp("found")
    for block in range(blocks):
        mine = parts.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block)
        # at most about block_bytes by the deal above
        held = spark.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in mine.collect()])
        found = F.arrow_udf(_searching(held, window), RESULT)(F.col(text_col))
        rows = rows.withColumn(got, found)
        if block == 0:
            rows = rows.select(*docs.columns, *[F.col(got)[k].alias(out[k]) for k in out])
        else:
            both = F.arrow_udf(_joined, "array<struct<a: bigint, b: bigint>>")(F.concat(F.col(out["spans"]), F.col(got)["spans"]))
            listed = F.sort_array(F.array_distinct(F.concat(F.col(out["items"]), F.col(got)["items"])))
            rows = rows.select(*docs.columns, F.col(out["n_words"]), both.alias(out["spans"]), listed.alias(out["items"]))
        if block + 1 < blocks:
            rows = stored(rows, "found")
    return rows, out


def n_hit(spans: Column) -> Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
