"""Word shingle sets of texts as sorted 52-bit hashes, computed on whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessera.llm.common import mix64, row_blocks
from tessera.llm.suffixdedup import _BASE, _SPAN, _VALUE, _tables

BITS = 52
_ROWS = 1 << (64 - BITS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row and hash of every word (a run of bytes that are not ASCII white space, A-Z read as a-z).

    The bytes are read in parts of ``_SPAN``; a word that goes on in the next part is carried over, so words of any length stay whole.
    """
    up, down = _tables()
    rows, hashes, at, end, open_word = [], [], 0, len(data), None
    while at < end:
        stop = min(end, at + _SPAN)
        part = _LOWER[data[at:stop]]
        word = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        inner = offsets[(offsets > at) & (offsets < stop)] - at
        edge[inner] = True
        first = word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1])
        last = word & (np.concatenate([~word[1:], [True]]) | edge[1:])
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[:len(part)], out=sums[1:])
        row, code, size = np.searchsorted(offsets, s + at, "right") - 1, (sums[e] - sums[s]) * down[s], (e - s).astype(np.uint64)
        if open_word:  # the first word began in an earlier part: its hash moves up by the bytes before
            before, length = open_word
            code[:1] = before + code[:1] * np.uint64(pow(_BASE, length, 1 << 64))
            size[:1] += np.uint64(length)
            open_word = None
        if stop < end and word[-1] and not _SPACE[data[stop]] and offsets[np.searchsorted(offsets, stop)] != stop:
            open_word = code[-1:], int(size[-1])
            row, code, size = row[:-1], code[:-1], size[:-1]
        rows.append(row)
        hashes.append(mix64(code + size))
        at = stop
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, end row, starts of the rows' sets (one more than rows) and their sorted distinct hashes.

    A text of fewer words than ``k`` has one shingle of all of them; without words the set is empty.
    """
    factors = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for a, b in row_blocks(offsets, _SPAN):
        for r in range(a, b, _ROWS):
            end = min(b, r + _ROWS)
            row, word = _word_hashes(data[offsets[r]:offsets[end]], offsets[r:end + 1] - offsets[r])
            n = np.bincount(row, minlength=end - r)
            if len(word) >= k:
                whole = row[k - 1:] == row[:len(row) - k + 1]
                code = np.zeros(len(word) - k + 1, np.uint64)
                for j in range(k):
                    code += word[j:len(word) - k + 1 + j] * factors[j]
                code, of = code[whole], row[:len(whole)][whole]
            else:
                code, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            short = np.flatnonzero((n > 0) & (n < k))
            if len(short):
                begin = np.cumsum(n) - n
                few = np.zeros(len(short), np.uint64)
                for j in range(k - 1):
                    some = n[short] > j
                    few[some] += word[begin[short[some]] + j] * factors[j]
                code = np.concatenate([code, few + n[short].astype(np.uint64)])
                of = np.concatenate([of, short])
            key = np.sort((of.astype(np.uint64) << np.uint64(BITS)) | (mix64(code) >> np.uint64(64 - BITS)))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            starts = np.searchsorted(key, np.arange(end - r + 1, dtype=np.uint64) << np.uint64(BITS)) if end - r < _ROWS else np.append(
                np.searchsorted(key, np.arange(end - r, dtype=np.uint64) << np.uint64(BITS)), len(key))
            yield r, end, starts, key & np.uint64((1 << BITS) - 1)
