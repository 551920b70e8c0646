"""Words of texts on whole Arrow buffers: runs of digits, letters and bytes of other scripts, with A-Z read as a-z."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from tessera.llm.common import mix64, row_blocks

#: bytes that one pass looks at together; a text beyond that is read in parts, cut between words
PART = 1 << 20
_BLANK = 0x20
_FOLD = np.full(256, _BLANK, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words(NamedTuple):
    """``data``: folded bytes and a margin; per word its row, first byte, size, code and place among the row's words.

    ``seen`` counts the first words that an earlier part of the same text held already.
    """
    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    size: np.ndarray
    code: np.ndarray
    at: np.ndarray
    seen: int


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers."""
    return np.ndarray((len(data) - 7,), "<u8", buffer=data.data, strides=(1,))


def words_of(data: np.ndarray, offsets: np.ndarray, first_row: int = 0) -> Words:
    """All words of the rows. Equal words have equal codes; words with equal codes need not be equal."""
    folded = np.concatenate([_FOLD[data], np.full(8, _BLANK, np.uint8)])
    inside = folded[:len(data)] != _BLANK
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    row = np.searchsorted(offsets, start, "right") - 1
    head = _eights(folded)[start] & _MASK[np.minimum(size, 8)]
    tail = np.where(size > 8, _eights(folded)[np.maximum(start + size - 8, 0)], np.uint64(0))
    code = mix64(head ^ mix64(tail + size.astype(np.uint64)))
    begin = np.searchsorted(row, np.arange(len(offsets) - 1))
    return Words(folded, row + first_row, start, size, code, np.arange(len(row)) - begin[row], 0)


def runs(data: np.ndarray, offsets: np.ndarray, overlap: int = 0, part: int | None = None) -> Iterator[Words]:
    """Words of runs of rows; a text longer than ``part`` comes in several, each with ``overlap`` words of the one before."""
    part = part or PART
    for a, b in row_blocks(offsets, part):
        if b - a > 1 or offsets[b] - offsets[a] <= part:
            yield words_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], a)
            continue
        at, new, end, known, seen = int(offsets[a]), int(offsets[a]), int(offsets[b]), 0, 0
        while new < end:
            stop = min(end, new + part)
            while stop < end:  # on to the next blank
                ahead = np.flatnonzero(_FOLD[data[stop:min(end, stop + part)]] == _BLANK)
                if len(ahead):
                    stop += int(ahead[0])
                    break
                stop = min(end, stop + part)
            got = words_of(data[at:stop], np.array([0, stop - at]), a)
            n = len(got.row)
            if n > seen:
                yield got._replace(at=got.at + (known - seen), seen=seen)
                known += n - seen
            seen = min(overlap, n)
            at, new = (at + int(got.start[n - seen]) if seen else stop), stop


def same(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether the words ``i`` of ``a`` and ``j`` of ``b`` are the same bytes, pair by pair."""
    equal = a.size[i] == b.size[j]
    x, y, done = _eights(a.data), _eights(b.data), 0
    left = np.flatnonzero(equal)
    while len(left):
        rest = a.size[i[left]] - done
        differ = (x[a.start[i[left]] + done] ^ y[b.start[j[left]] + done]) & _MASK[np.minimum(rest, 8)]
        equal[left[differ != 0]] = False
        left = left[(differ == 0) & (rest > 8)]
        done += 8
    return equal


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every i the numbers lo[i] to hi[i] - 1: the i of each, and the numbers."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]
