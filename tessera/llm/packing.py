"""Best-fit packing of token sequences, planned on the histogram of their lengths.

The plan needs only how many pieces there are of each length (at most ``capacity`` numbers): best fit
decreasing runs over counts, and gives each length a list of runs of slots. Pieces then take the slots
of their length by rank, with one join on (length, rank). Nothing that grows with the data passes
through the driver or one task.

Defined results: a null or empty text is the end-of-text id alone (one piece of length 1); a null id
keeps its piece under a null ``doc_id``; repeated rows are packed once each (rows that are alike in
every column may swap slots); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import giving_back, prepare, stored

CAPACITY = 2048
END_ID = 0
#: pieces that share one rank counter; a length with more pieces gets several counters
RANK_GROUP = 1024
#: words whose ids a task remembers
CACHE_WORDS = 600_000

_CACHE: dict[str, dict[str, bytes]] = {}
_TOKENIZERS: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _CACHE[path] = {}
    return _TOKENIZERS[path], _CACHE[path]


def _learn(words: list[str], path: str) -> None:
    """Encode words together, as one text, and tell their ids apart by their places in it."""
    tokenizer, cache = _tokenizer(path)
    for at in range(0, len(words), 20_000):
        part = words[at:at + 20_000]
        starts = np.cumsum([0] + [len(w) + 1 for w in part])
        got = tokenizer.encode(" ".join(part), add_special_tokens=False)
        ids = np.array(got.ids, dtype="<u4").tobytes()
        places = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids) // 4)
        cuts = (4 * np.searchsorted(places, starts)).tolist()
        cuts[-1] = len(ids)
        cache.update((w, ids[cuts[i]:cuts[i + 1]]) for i, w in enumerate(part))


@functools.cache
def _stays_letter(c: str) -> bool:
    """Whether a character is a letter, and its composed lower-case form ends in one."""
    return c.isalpha() and unicodedata.normalize("NFC", unicodedata.normalize("NFC", c).lower())[-1].isalpha()


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer never joins characters over a blank or a line break, nor a letter and a following full stop
    or comma, so the ids of a text are those of its words in turn. (Letters that its normalizer turns into a letter
    and a combining mark do join: such words are encoded whole.) Words stay known until
    ``CACHE_WORDS`` are; later ones are known for this call only.
    """
    _, cache = _tokenizer(path)
    cache[""] = b""
    split = [t.replace("\n", " ").split(" ") for t in texts]
    new = {w for words in split for w in words}.difference(cache)
    ended = [w for w in new if w[-1] in ".," and len(w) > 1 and _stays_letter(w[-2])]
    added = list(new.difference(ended).union(w[:-1] for w in ended).union(".,").difference(cache))
    room = CACHE_WORDS - len(cache)
    _learn(added, path)
    cache.update((w, cache[w[:-1]] + cache[w[-1]]) for w in ended)
    out = [b"".join([cache[w] for w in words]) for words in split]
    for w in (added + ended)[max(0, room):]:
        cache.pop(w, None)
    return out


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text as ids plus the end id, cut only where longer than ``capacity``."""
    path = tokenizer_path or default_tokenizer()
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [
        T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tokenizer(path)[1].clear()
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, start, length, crc = [], [], [], []
                for i, ids in enumerate(encode_texts([t or "" for t in part.column(1).to_pylist()], path)):
                    ids += end
                    for a in range(0, len(ids), 4 * capacity):
                        piece = ids[a:a + 4 * capacity]
                        row.append(i)
                        start.append(a // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                    names=["doc_id", "start", "length", "ids_crc32"])
        _tokenizer(path)[1].clear()  # the worker lives on

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda b: giving_back(run(b)), schema)
    return rows.select("doc_id", (F.col("start") / capacity).cast("int").alias("piece"), "start", "length", "ids_crc32")


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts: runs (length, first rank, end rank, per sequence, first sequence, offset).

    Piece number ``rank`` of a length lies in one run; its sequence is ``first sequence + (rank - first
    rank) // per sequence``. Sequences that are filled alike are kept as one group, and each length adds at
    most two groups, so the plan's size depends on the capacity alone.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, made = [], 0
    for length in sorted(counts, reverse=True):
        left, rank, space = counts[length], 0, length
        while left:
            while space <= capacity and not room[space]:
                space += 1
            if space > capacity:  # no open sequence has room: open as many as the rest needs
                space = capacity
                n = -(-left // (capacity // length))
                room[space].append((made, n))
                made += n
            first, n = room[space].pop()
            each = space // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, rank + full * each, each, first, capacity - space))
                room[space - each * length].append((first, full))
                rank, left = rank + full * each, left - full * each
            if full < n:
                some = min(left, each)  # less than a full share: the length ends here
                if some:
                    runs.append((length, rank, rank + some, some, first + full, capacity - space))
                    room[space - some * length].append((first + full, 1))
                    rank, left = rank + some, left - some
                rest = n - full - bool(some)
                if rest:
                    room[space].append((first + full + bool(some), rest))
            space = length  # a group that has just been filled may still have room
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_group: int = RANK_GROUP) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    A length's pieces are dealt by hash to groups of about ``rank_group`` rows; a piece's rank is its place in
    its group plus the sizes of the groups before, so a length that holds a third of all pieces is ranked by many tasks.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan_slots(counts, capacity)
    slots = spark.createDataFrame(runs or [(0, 0, 0, 1, 0, 0)], "at bigint, lo bigint, hi bigint, each bigint, first bigint, place bigint")
    groups = F.array(*[F.lit(-(-counts.get(n, 1) // rank_group)) for n in range(1, capacity + 1)])
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(groups, (F.col("length") - 1).cast("int")).cast("bigint")))
    before = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("local", F.row_number().over(order) - 1).join(before, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("local"))
    # the plan's size is bounded by the capacity (see plan_slots), not by the data: it can be broadcast
    hit = (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked.join(F.broadcast(slots), hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + F.pmod(F.col("rank") - F.col("lo"), F.col("each")) * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepare(docs.sparkSession)
    pieces = stored(token_pieces(docs, tokenizer_path, capacity), "pieces")
    return pack(pieces, capacity)
