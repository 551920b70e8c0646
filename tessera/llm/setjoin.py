"""Exact n-gram Jaccard join by set-relation skipping, and the classes of linked documents.

Sets are a document's distinct word shingles; two link when |x & y| / |x | y| reaches a threshold.

1. Sets. Equal sets are one set from here on (documents with equal texts need one computation).
2. Positions. In the order "shingles of one set only first", a set's answers can be found at its first
   n - ceil(t n) + 1 positions. Where all of these hold shingles that no other set has, the set is skipped whole: one count
   over all shingles leaves the sets whose answers are open.
3. Index lists. An open set is cut by hash into m parts, m - 1 being the most elements in which two linked sets
   of its size can differ: linked sets agree in one whole part. Lists are keyed by (size level, part position,
   contents of the part); sizes too far apart never share a level, so such blocks are skipped by position. Empty parts,
   in which unrelated sets agree, have a list only for sets with so few other parts that a linked set can differ in all of them.
4. Answers by relation. The least set of a list is its leader. Every member's difference from its leader is computed
   once. Members that link to the leader are in its class: pairs among them are skipped. Any other member's overlap
   with a further one follows from the two differences, |dx| + |dy| - 2 |dx & dy|, which are small for highly
   similar sets: an index over the differences, ordered by their size, is probed at the rarest few elements only, and blocks of
   members whose difference is too large or too small are skipped.
5. Classes. Links are contracted to components in rounds of minimum labels.

A leader's members are dealt out in chunks; members of different chunks meet in a grid of chunk pairs, as
differences. No list, leader or component is collected in one place; no pairs within a group are emitted, only a
spanning set of links.

Defined results: null texts are empty; an empty set (no words) is linked with nothing; a text with fewer words than a
shingle has one shingle of all of them; rows with a null id get their own class under a null id unless they link; repeated rows
are one set; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, giving_back, mix64, prepare, stored, temp, text_buffer
from tessera.llm.shingles import shingle_sets
from tessera.llm.suffixdedup import _last, _runs, _split, _unsigned_mod

#: shingles, signatures, bytes of set elements and of text that one group of work holds
SHINGLES, SIGNATURES, SET_BYTES, TEXT_BYTES = 1_500_000, 1_500_000, 8_000_000, 8_000_000
#: documents whose elements are dealt out together
BATCH_ROWS = 2500
#: sets whose counts are summed in one group
SETS = 50_000
#: members of one leader that meet in one task
CHUNK = 4096
#: sets of one batch that share a shingle, above which it is counted in place
LOCAL = 64


def sizes_of_levels(num: int, den: int, most: int = 1 << 33) -> np.ndarray:
    """Bounds of the size levels: a linked set's size lies in the same level or the next."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * den // num + 1))
    return np.array(out, np.int64)


def most_apart(total: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Most elements in which two linked sets with ``total`` elements together can differ."""
    return total * (den - num) // (den + num)


def set_key(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit key of each set from the sum of its elements' hashes."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(elements), dtype=np.uint64)])
    return mix64(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64))


def _text_sets(column, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for a, b, starts, elements in shingle_sets(*text_buffer(column), k):
        yield a, b, starts, elements, set_key(elements, starts)


def _id(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def sets_of(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, id (hash of id and text), n (size) and key of every document's set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, starts, _, key in _text_sets(batch.column(2), k):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(starts).astype(np.int64)), pa.array(key.view(np.int64))],
                                                 names=["doc_id", "id", "n", "key"])

    rows = docs.select(F.col(id_col).alias("doc_id"), _id(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: giving_back(run(b)), f"doc_id {kind}, id bigint, n bigint, key bigint")


_COUNTED = pa.schema([("bucket", pa.int64()), ("shared", pa.bool_()), ("elements", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
COUNTED_ROWS = "bucket bigint, shared boolean, elements binary, keys binary, counts binary"


def _element_rows(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Per batch and bucket the elements of the sets; what many sets of the batch share is sent once and marked."""
    for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
        elements, keys, seen = [], [], np.zeros(0, np.uint64)
        for _, _, starts, e, key in _text_sets(batch.column(0), k):
            new = np.zeros(len(key), bool)  # copies of one set are one set
            new[np.unique(key, return_index=True)[1]] = True
            new &= ~np.isin(key, seen)
            seen = np.concatenate([seen, key[new]])
            elements.append(e[np.repeat(new, np.diff(starts))])
            keys.append(np.repeat(key[new], np.diff(starts)[new]))
        out: dict[str, list] = {c: [] for c in _COUNTED.names}
        if elements:
            e, key = np.concatenate(elements), np.concatenate(keys)
            order = np.argsort(e)
            starts = _runs(e[order])
            size = np.diff(np.append(starts, len(order)))
            many = np.repeat(size > LOCAL, size)
            drop = np.zeros(len(e), bool)
            drop[order] = many  # counted here as shared: the set's own count is sent along
            heads = order[starts[size > LOCAL]]
            for shared, at in ((False, np.flatnonzero(~drop)), (True, heads)):
                for bucket, own in _split((mix64(e[at]) >> np.uint64(32)) % np.uint64(buckets)):
                    own = at[own]
                    runs = _runs(key[own])
                    out["bucket"].append(bucket)
                    out["shared"].append(shared)
                    out["elements"].append(e[own].tobytes() if shared else e[own].view(np.uint8).reshape(-1, 8)[:, :7].tobytes())
                    out["keys"].append(key[own[runs]].tobytes())
                    out["counts"].append(np.diff(np.append(runs, len(own))).astype(np.uint32).tobytes())
            counted, n = np.unique(key[drop], return_counts=True)
            if len(counted):
                out["bucket"].append(int(counted[0] % np.uint64(buckets)))
                out["shared"].append(None)
                out["elements"].append(b"")
                out["keys"].append(counted.tobytes())
                out["counts"].append(n.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=_COUNTED)


SHARED_ROWS = "part bigint, keys binary, counts binary"
_SHARED = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _shared_counts(table: pa.Table, parts: int) -> pa.Table:
    """Keys and the number of their elements, of one bucket, that another set holds too, by part of the sets."""
    elements, keys, done_keys, done_n, marked = [], [], [], [], []
    for shared, e, key, n in zip(*(table.column(c).to_pylist() for c in ("shared", "elements", "keys", "counts"))):
        key, n = np.frombuffer(key, np.uint64), np.frombuffer(n, np.uint32)
        if shared is None:
            done_keys.append(key)
            done_n.append(n.astype(np.int64))
        elif shared:
            marked.append(np.frombuffer(e, np.uint64))
        else:
            wide = np.zeros((len(e) // 7, 8), np.uint8)
            wide[:, :7] = np.frombuffer(e, np.uint8).reshape(-1, 7)
            elements.append(wide.view(np.uint64).ravel())
            keys.append(np.repeat(key, n))
    if elements:
        e, key = np.concatenate(elements), np.concatenate(keys)
        order = np.argsort(e, kind="stable")
        e, key = e[order], key[order]
        starts = _runs(e)
        size = np.diff(np.append(starts, len(e)))
        open_ = (np.minimum.reduceat(key, starts) != np.maximum.reduceat(key, starts)) if len(e) else np.zeros(0, bool)
        if marked:
            open_ |= np.isin(e[starts], np.concatenate(marked))
        some = np.repeat(open_, size)
        e, key = e[some], key[some]
        order = np.lexsort((key, e))  # copies of one set count once
        e, key = e[order], key[order]
        first = np.concatenate([[True], (e[1:] != e[:-1]) | (key[1:] != key[:-1])]) if len(e) else np.zeros(0, bool)
        counted, n = np.unique(key[first], return_counts=True)
        done_keys.append(counted)
        done_n.append(n)
    key = np.concatenate(done_keys) if done_keys else np.zeros(0, np.uint64)
    n = np.concatenate(done_n) if done_n else np.zeros(0, np.int64)
    out: dict[str, list] = {c: [] for c in _SHARED.names}
    for part, own in _split(key % np.uint64(parts)):
        out["part"].append(part)
        out["keys"].append(key[own].tobytes())
        out["counts"].append(n[own].astype(np.uint32).tobytes())
    return pa.table(out, schema=_SHARED)


def _counts_of_sets(table: pa.Table) -> pa.Table:
    """key and n, its shared elements over all buckets, of one part of the sets."""
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("counts").to_pylist()])
    keys, at = np.unique(key, return_inverse=True)
    return pa.table({"key": pa.array(keys.view(np.int64)), "shared": pa.array(np.bincount(at, n, len(keys)).astype(np.int64))})


def _open_sets(texts: pa.Table, wanted: pa.Table, k: int) -> pa.Table:
    """key, n and elements of the wanted documents' sets."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("elements", pa.binary())])
    if not texts.num_rows or not wanted.num_rows:
        return schema.empty_table()
    own = texts.column("id").to_numpy()
    spots = np.flatnonzero(np.isin(own, wanted.column("id").to_numpy()))
    _, first = np.unique(own[spots], return_index=True)
    column = texts.column("text").take(pa.array(spots[first])).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    keys, sizes, blobs = [], [], []
    for _, _, starts, elements, key in _text_sets(column, k):
        keys += key.view(np.int64).tolist()
        sizes += np.diff(starts).tolist()
        blobs += [elements[s:e].tobytes() for s, e in zip(starts, starts[1:])]
    return pa.table({"key": keys, "n": sizes, "elements": blobs}, schema=schema)


def signatures(elements: np.ndarray, starts: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """set number and signature (level, part position, contents) of the parts, for the set's own level and the one below.

    A linked set differs in ``apart`` elements at most, so of more parts that hold elements one agrees: empty parts are left out then.
    Sets with fewer keep them: two such sets may agree in empty parts only.
    """
    n = np.diff(starts)
    level = np.searchsorted(bounds, n, "right") - 1
    of = np.repeat(np.arange(len(n)), n)
    value, place = mix64(elements), mix64(elements ^ np.uint64(0x6A09E667F3BCC909))
    rows, sigs = [], []
    for down in (0, 1):
        some = (level >= down) & (n > 0)
        lev = np.maximum(level - down, 0)
        parts = np.where(some, most_apart(2 * (bounds[lev + 2] - 1), num, den) + 1, 0)
        base = np.cumsum(parts) - parts
        use = some[of]
        slot = base[of[use]] + (place[use] % parts[of[use]].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, slot, value[use])
        row = np.repeat(np.arange(len(n)), parts)
        where = (lev[row] << 40) + np.arange(len(row)) - base[row]
        # in the own level's lists the set meets those of that level and the next, in the lists below those of the level below
        apart = most_apart(n + np.minimum(n * den // num, bounds[lev + 2 - down] - 1), num, den)
        holds = np.zeros(len(total), bool)
        holds[slot] = True
        kept = holds | (np.bincount(row[holds], minlength=len(n)) <= apart)[row]
        rows.append(row[kept])
        sigs.append(mix64(total + mix64(where.astype(np.uint64)))[kept])
    return np.concatenate(rows), np.concatenate(sigs)


SIGNATURE_ROWS = "bucket bigint, signatures binary, keys binary"


def _sets(keys, blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.asarray(keys, np.int64).view(np.uint64)
    arrays = [np.frombuffer(b, np.uint64) for b in blobs]
    return key, np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64), np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)


def _signature_rows(batches: Iterator[pa.RecordBatch], num: int, den: int, buckets: int) -> Iterator[pa.RecordBatch]:
    bounds = sizes_of_levels(num, den)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            key, starts, elements = _sets(part.column(0).to_numpy(), part.column(1).to_pylist())
            row, sig = signatures(elements, starts, bounds, num, den)
            out: dict[str, list] = {"bucket": [], "signatures": [], "keys": []}
            for bucket, own in _split((sig >> np.uint64(32)) % np.uint64(buckets)):
                out["bucket"].append(bucket)
                out["signatures"].append(sig[own].tobytes())
                out["keys"].append(key[row[own]].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("signatures", pa.binary()), ("keys", pa.binary())]))


def _leaders(table: pa.Table) -> pa.Table:
    """(leader, member) of every list of one bucket, each pair once."""
    sig = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("signatures").to_pylist()])
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    starts = _runs(sig)
    lead = np.repeat(key[starts], np.diff(np.append(starts, len(sig))))
    some = lead != key
    pairs = np.unique(np.stack([lead[some], key[some]], 1), axis=0)
    return pa.table({"leader": pa.array(pairs[:, 0].copy().view(np.int64)), "member": pa.array(pairs[:, 1].copy().view(np.int64))})


class _Members:
    """Members of one leader as differences from it, and the links among them."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, linked: np.ndarray, apart: list[np.ndarray], num: int, den: int):
        self.keys, self.sizes, self.linked, self.num, self.den = keys, sizes, linked, num, den
        self.count = np.array([len(a) for a in apart], np.int64)
        order = np.argsort(self.count, kind="stable")  # lists run by the size of the difference: blocks are skipped by it
        self.order, self.apart = order, apart
        flat = np.concatenate([apart[i] for i in order]) if len(order) else np.zeros(0, np.uint64)
        holder = np.repeat(order, self.count[order])
        self.tokens, inverse = np.unique(flat, return_inverse=True)
        spots = np.argsort(inverse, kind="stable")
        self.holders = holder[spots]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(self.tokens)))])

    def places(self, elements: np.ndarray) -> np.ndarray:
        """Numbers of the lists of those elements that some member holds."""
        at = np.searchsorted(self.tokens, elements)
        inside = at < len(self.tokens)
        at, elements = at[inside], elements[inside]
        return at[self.tokens[at] == elements]

    def answers(self, element_diff: np.ndarray, size: int) -> np.ndarray:
        """Members that link to a set, given its difference from the leader and its size."""
        a = len(element_diff)
        reach = int(most_apart(size + size * self.den // self.num, self.num, self.den))
        lists = self.places(element_diff)
        found = []
        if a <= reach:  # differences this small need not overlap at all
            found.append(self.order[:np.searchsorted(self.count[self.order], reach - a, "right")])
        need = max(1, a - reach)
        length = self.begin[lists + 1] - self.begin[lists]
        rare = lists[np.argsort(length, kind="stable")[:max(0, len(lists) - need + 1)]]
        single = self.begin[rare + 1] - self.begin[rare] == 1
        found.append(self.holders[self.begin[rare[single]]])
        for i in rare[~single]:
            members = self.holders[self.begin[i]:self.begin[i + 1]]
            sizes = self.count[members]
            found.append(members[np.searchsorted(sizes, max(0, a - reach)):np.searchsorted(sizes, a + reach, "right")])
        hit = np.unique(np.concatenate(found))
        if not len(hit):
            return hit
        if len(hit) <= 4:
            both = np.array([len(np.intersect1d(self.apart[h], element_diff, assume_unique=True)) for h in hit])
        else:
            held = [self.holders[self.begin[i]:self.begin[i + 1]] for i in lists] or [hit[:0]]
            both = np.bincount(np.concatenate(held), minlength=len(self.keys))[hit]
        return hit[a + self.count[hit] - 2 * both <= most_apart(size + self.sizes[hit], self.num, self.den)]


def links_among(mine: _Members, other: _Members) -> list[tuple[int, int]]:
    """A spanning set of links between members of two chunks of a leader (or of one chunk with itself), as keys.

    Members linked to the leader are one class already. Only the others ask, and one answer in a class is enough.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    for asks, answers in ((mine, other),) if mine is other else ((mine, other), (other, mine)):
        for i in np.flatnonzero(~asks.linked):
            x = int(asks.keys[i])
            for j in answers.answers(asks.apart[i], int(asks.sizes[i])):
                y = int(answers.keys[j])
                # -1 stands for the leader's class
                a, b = find(x), find(-1 if answers.linked[j] else y)
                if a != b:
                    parent[a] = b
                    out.append((x, y))
    return out


_MET = pa.schema([("leader", pa.int64()), ("member", pa.int64()), ("link", pa.int64()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("n", pa.int64()),
                  ("linked", pa.bool_()), ("apart", pa.binary())])
MET_ROWS = "leader bigint, member bigint, link bigint, chunk bigint, chunks bigint, n bigint, linked boolean, apart binary"


def _meet(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links among the members of each (leader, chunk) of one group, and the differences of leaders with several chunks."""
    out: dict[str, list] = {c: [] for c in _MET.names}

    def put(leader, member, link=None, chunk=None, chunks=None, n=None, linked=None, apart=None):
        for c, v in zip(_MET.names, (leader, member, link, chunk, chunks, n, linked, apart)):
            out[c].append(v)

    table = table.sort_by([("leader", "ascending"), ("chunk", "ascending"), ("own", "descending"), ("key", "ascending")])
    leader, chunk = table.column("leader").to_numpy(), table.column("chunk").to_numpy()
    key, size = table.column("key").to_numpy(), table.column("n").to_numpy()
    blobs, chunks = table.column("elements").to_pylist(), table.column("chunks").to_numpy()
    turn = np.flatnonzero(np.concatenate([[True], (leader[1:] != leader[:-1]) | (chunk[1:] != chunk[:-1])]))
    for s, e in zip(turn, np.append(turn[1:], len(key))):
        base = np.frombuffer(blobs[s], np.uint64)
        apart = [np.setxor1d(base, np.frombuffer(blobs[i], np.uint64), assume_unique=True) for i in range(s + 1, e)]
        sizes = size[s + 1:e]
        linked = np.array([len(a) for a in apart], np.int64) <= most_apart(sizes + size[s], num, den)
        for i in np.flatnonzero(linked):
            put(leader[s], None, key[s + 1 + i])
        if len(apart) > 1 and not linked.all():
            members = _Members(key[s + 1:e], sizes, linked, apart, num, den)
            for x, y in links_among(members, members):
                put(x, None, y)
        if chunks[s] > 1:
            for i, a in enumerate(apart):
                put(leader[s], key[s + 1 + i], None, chunk[s], chunks[s], sizes[i], bool(linked[i]), a.tobytes())
    return pa.table(out, schema=_MET)


def _meet_chunks(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links between the members of two chunks of a leader."""
    sides = []
    for side in ("a", "b"):
        part = table.filter(pa.compute.equal(table.column("side"), side))
        sides.append(_Members(part.column("member").to_numpy(), part.column("n").to_numpy(), part.column("linked").to_numpy(zero_copy_only=False).astype(bool),
                              [np.frombuffer(x, np.uint64) for x in part.column("apart").to_pylist()], num, den))
    found = links_among(*sides) if len(sides[0].keys) and len(sides[1].keys) else []
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def components(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """node, label of every node of the links (a, b): equal labels within a component.

    Each round every node points to the least node of its neighbourhood, by number and by a round's hash in turn (so
    that long paths shrink too); links are then rewritten to where their ends point. It ends when no link is left.
    """
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = stored(nodes.select("node", F.col("node").alias("label")), "labels")
    turn = 0
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        value = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(F.col(c), F.lit(t)))
        least = both.groupBy("a").agg(F.min(F.struct(value("b").alias("v"), F.col("b").alias("to"))).alias("least"))
        own = F.struct(value("a").alias("v"), F.col("a").alias("to"))
        points = stored(least.select(F.col("a").alias("from"), F.least(own, F.col("least"))["to"].alias("to")), "points")
        labels = stored(labels.join(points, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        one = edges.join(points.select(F.col("from").alias("a"), F.col("to").alias("x")), "a")
        two = one.join(points.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(two.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        turn += 1
    return labels


def near_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, id (hash of id and text), n (set size), component (smallest doc_id of the class) and keeper (the id of
    the row that has it) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    sets = stored(sets_of(docs, k, id_col, text_col), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    text = docs.select(_id(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    buckets = max(1, round(total / SHINGLES))
    counted = text.select("text").mapInArrow(lambda b: giving_back(_element_rows(b, k, buckets)), COUNTED_ROWS)
    set_parts = max(1, round(sets.count() / SETS))
    shared = counted.groupBy("bucket").applyInArrow(lambda t: _last(_shared_counts(t, set_parts)), SHARED_ROWS)
    counts = shared.groupBy("part").applyInArrow(_counts_of_sets, "key bigint, shared bigint")
    distinct = sets.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    wanted = stored(distinct.join(counts, "key").filter(F.col("shared") * den >= F.col("n") * num).select("id", "n"), "open")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, round(size / TEXT_BYTES))
    by_part = text.withColumn("part", _unsigned_mod("id", parts)).groupBy("part")
    asked = wanted.withColumn("part", _unsigned_mod("id", parts)).groupBy("part")
    held = stored(by_part.cogroup(asked).applyInArrow(lambda a, b: _last(_open_sets(a, b, k)), "key bigint, n bigint, elements binary"), "held")
    elements = held.agg(F.sum("n")).first()[0] or 0
    rate = 2 * 2 * (den - num) / (den + num)  # signatures of an element, about
    sig_buckets = max(1, round(elements * rate / SIGNATURES))
    signed = held.select("key", "elements").mapInArrow(lambda b: giving_back(_signature_rows(b, num, den, sig_buckets)), SIGNATURE_ROWS)
    pairs = stored(signed.groupBy("bucket").applyInArrow(_leaders, "leader bigint, member bigint").distinct(), "pairs")
    chunks = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("bigint").alias("chunks"))
    placed = pairs.join(chunks, "leader").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")))
    members = placed.select("leader", "chunk", "chunks", F.col("member").alias("key"), F.lit(0).alias("own"))
    leads = placed.select("leader", "chunk", "chunks", F.col("leader").alias("key"), F.lit(1).alias("own")).distinct()
    met = members.union(leads).join(held, "key")
    groups = max(1, round(8 * (pairs.count() * (elements / max(held.count(), 1))) / SET_BYTES))
    met = met.withColumn("group", F.pmod(F.xxhash64("leader", "chunk"), F.lit(groups)))
    met = stored(met.groupBy("group").applyInArrow(lambda t: _last(_meet(t, num, den)), MET_ROWS), "met")
    links = met.filter("link IS NOT NULL").select(F.col("leader").alias("a"), F.col("link").alias("b"))
    apart = met.filter("member IS NOT NULL")
    if apart.limit(1).count():
        grid = apart.withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).filter("to <> chunk")
        grid = grid.select("leader", F.least("chunk", "to").alias("i"), F.greatest("chunk", "to").alias("j"),
                           F.when(F.col("chunk") < F.col("to"), "a").otherwise("b").alias("side"), "member", "n", "linked", "apart")
        links = links.union(grid.groupBy("leader", "i", "j").applyInArrow(lambda t: _meet_chunks(t, num, den), "a bigint, b bigint"))
    labels = components(links).withColumnRenamed("node", "key")
    named = sets.join(labels, "key", "left").withColumn("class", F.when(F.col("n") > 0, F.coalesce("label", "key")).otherwise(F.col("id")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "id")
    # a written table, so that a class with a third of all rows can be split when it is joined
    smallest = stored(named.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("component"), F.min_by("id", order).alias("keeper")), "smallest")
    joined = named.join(smallest, "class", "left")
    return joined.select("doc_id", "id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component"),
                         F.when(F.col("n") > 0, F.col("keeper")).otherwise(F.col("id")).alias("keeper"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows without those that link, directly or not, to a row of smaller id; of repeated rows one stays.

    Documents without words link with nothing and all stay.
    """
    classes = stored(near_classes(docs, k, num, den, id_col, text_col), "classes")
    own = temp("id")
    kept = classes.filter(F.col("id") == F.col("keeper")).select(F.col("id").alias(own)).distinct()
    rows = docs.withColumn(own, _id(id_col, text_col)).join(kept, own, "left_semi")
    if classes.filter("n > 0").groupBy("id").count().filter("count > 1").limit(1).count():
        empty = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)) == 0
        rows = rows.filter(~empty).dropDuplicates([own]).unionByName(rows.filter(empty))
    return rows.drop(own)
