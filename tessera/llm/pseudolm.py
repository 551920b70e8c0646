"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

Each token is predicted from the two tokens before and the two after it (the token itself is never an input); a document's
score is the sum of the conditional log-probabilities of all its tokens.

Tokens are lower-cased words, counted over all documents. The vocabulary follows the corpus: it holds every word with at
least tokens ** (2/3) / ``SPARSE`` occurrences (and at least the 768 most frequent), so it grows with the corpus. All other words
fall into hash classes; the score of such a word is the class's log-probability plus log(count of the word / count of its
class), from the written table of all counts (a word that training has not seen counts once). The output is a two-step
softmax: the token's class, then its place in the class; both numbers grow with the vocabulary's square root.

Training is data-parallel in numpy: in each round every partition improves the current weights on its own documents
(every position; a document takes part in one round), and the partitions' weights are averaged, weighted by
positions, as chunks of the weight vector that Spark groups and sums. What is gathered grows with the corpus: the word counts, the
vocabulary and with it the weights. A round runs in ``TASKS`` tasks per core, each with one copy of the weights.

Defined results: null and empty texts have no tokens and a log-probability of 0 (mean 0); ids play no part; repeated rows are
scored alike; an untrained model (empty corpus) spreads probability evenly; an empty table gives an empty
result; columns are kept whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, stored, temp

#: the smallest output; ``shapes`` gives that of a vocabulary
CLASSES, PLACES = 32, 32
VOCABULARY = CLASSES * PLACES
HASHED = 256
#: the id beyond a document's ends; ids above it are words, too
PAD = VOCABULARY
#: a word of the vocabulary has at least tokens ** (2/3) / SPARSE occurrences
SPARSE = 1600
SIDE = 2
WIDTH, HIDDEN = 12, 24
ROUNDS, BATCH = 2, 16_384
#: tokens that are scored together, and rows of a softmax that are computed together
SCORED, BLOCK = 65_536, 2048
#: sums of exp between these need no shift of the logits
TOTALS = 1e-26, 1e26
#: rows of one softmax that are too many for a stack, and rows of a stack
ALONE, STACKED = 512, 2048
RATE = 0.05
#: words a task counts before it passes them on
COUNTED = 400_000
#: weights of one chunk, at most
CHUNK = 1 << 18
TASKS = 2


def shapes(words: int) -> dict[str, tuple[int, ...]]:
    """Shapes of the weights for a vocabulary of so many words: as many classes as places, with room for all units."""
    side = max(CLASSES, math.isqrt(words + HASHED - 1) + 1)
    return {"E": (side * side + 1, WIDTH), "W": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "C": (HIDDEN, side), "c": (side,),
            "M": (side, HIDDEN, side), "m": (side, side)}


def size_of(shape: dict[str, tuple[int, ...]]) -> int:
    return sum(math.prod(s) for s in shape.values())


SHAPES = shapes(0)
SIZE = size_of(SHAPES)


def _unpack(vector: np.ndarray, shape: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shape.items():
        n = math.prod(s)
        out[k] = vector[at:at + n].reshape(s)
        at += n
    return out


def _id(rank: int) -> int:
    """Id of the word of a rank: the ids of the hash classes and of ``PAD`` are left out."""
    return rank if rank < VOCABULARY - HASHED else rank + HASHED + 1


def _units(target: np.ndarray) -> np.ndarray:
    """Output units of ids: ``PAD`` has none."""
    return target - (target > PAD)


class _Lookup(dict):
    """Ids of words; one outside the vocabulary has its hash class."""

    def __missing__(self, word: str) -> int:
        return VOCABULARY - HASHED + zlib.crc32(word.encode("utf-8", "replace")) % HASHED


@dataclass
class WindowModel:
    ids: dict[str, int]
    vector: np.ndarray
    #: word, n of all words outside the vocabulary; not sent to tasks
    rare: DataFrame | None = None
    #: occurrences of each hash class
    class_counts: list[int] = field(default_factory=lambda: [0] * HASHED)
    _w: dict = field(default_factory=dict)
    _lookup: _Lookup = field(default_factory=_Lookup)

    @property
    def w(self) -> dict[str, np.ndarray]:
        if not self._w:
            self._w.update(_unpack(self.vector, shapes(len(self.ids))))
        return self._w

    def __getstate__(self):
        return {"ids": self.ids, "vector": self.vector, "rare": None, "class_counts": self.class_counts, "_w": {}, "_lookup": _Lookup()}

    def tokens(self, text: str | None) -> np.ndarray:
        return self.ids_of((text or "").lower().split())

    def ids_of(self, words: list[str]) -> np.ndarray:
        if not self._lookup:
            self._lookup.update(self.ids)
        return np.fromiter(map(self._lookup.__getitem__, words), np.int32, len(words))


def contexts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Targets of all tokens in turn and their context tokens, padded at a document's ends."""
    gap = np.full(SIDE, PAD, np.int32)
    line = np.concatenate([gap] + [x for d in docs for x in (d, gap)])
    at = np.concatenate([np.arange(len(d)) for d in docs] or [np.zeros(0, int)])
    start = np.cumsum([SIDE] + [len(d) + SIDE for d in docs])[:-1]
    at = (at + np.repeat(start, [len(d) for d in docs])).astype(np.int64)
    around = np.stack([line[at + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))], 1) if len(at) else np.zeros((0, 2 * SIDE), np.int32)
    return line[at], around


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _exp_logits(h: np.ndarray, weight: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of the logits of one softmax or of a stack of them, its sums, and the logits of one column of each row.

    The sums, which are few, tell whether the logits must be shifted by their largest first.
    """
    one = np.ones(weight.shape[-1], h.dtype)
    for shifted in (False, True):
        z = h @ weight
        z += bias if bias.ndim == 1 else bias[:, None, :]
        if shifted:
            z -= z.max(-1, keepdims=True)
        own = z.reshape(-1, z.shape[-1])[np.arange(at.size), at.ravel()].reshape(at.shape)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        total = z @ one
        if not total.size or TOTALS[0] < total.min() and total.max() < TOTALS[1]:
            break
    return z, total, own


def _log_softmax_at(h: np.ndarray, weight: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One column of each row of ``_log_softmax(h @ weight + bias)``, in blocks of rows that stay in the cache."""
    out = np.empty(len(h), h.dtype)
    for a in range(0, len(h), BLOCK):
        _, total, own = _exp_logits(h[a:a + BLOCK], weight, bias, at[a:a + BLOCK])
        out[a:a + BLOCK] = own - np.log(total)
    return out


def _softmax_gradients(h: np.ndarray, weight: np.ndarray, bias: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the summed negative ``_log_softmax_at`` over ``n``: by ``h``, ``weight`` and ``bias``."""
    dh, dw, db = np.empty_like(h), np.zeros_like(weight), np.zeros_like(bias)
    for a in range(0, len(h), BLOCK):
        part = h[a:a + BLOCK]
        z, total, _ = _exp_logits(part, weight, bias, at[a:a + BLOCK])
        # rows are scaled where they are narrow
        z[np.arange(len(z)), at[a:a + BLOCK]] -= total
        scale = 1 / (n * total)
        dh[a:a + BLOCK] = (z @ weight.T) * scale[:, None]
        dw += (part * scale[:, None]).T @ z
        db += scale @ z
    return dh, dw, db


def _stacks(group: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Rows by group: large groups with their rows; and groups of about one size with their rows as a matrix, filled up with
    the number of rows, and which of these are real."""
    order = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")
    kinds = group[order]
    start = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])) if len(kinds) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(kinds)))
    large = [(int(kinds[s]), order[s:s + n]) for s, n in zip(start[size > ALONE], size[size > ALONE])]
    start, size = start[size <= ALONE], size[size <= ALONE]
    falling = np.argsort(-size, kind="stable")
    start, size = start[falling], size[falling]

    def small() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a = 0
        while a < len(size):
            widest = int(size[a])
            b = min(int(np.searchsorted(-size, -(widest * 2 // 3), "right")), a + max(1, STACKED // widest))
            col = np.arange(widest)
            real = col < size[a:b, None]
            yield kinds[start[a:b]], np.where(real, order[np.minimum(start[a:b, None] + col, len(order) - 1)], len(order)), real
            a = b
    return large, small()


def _steps(w: dict[str, np.ndarray], unit: np.ndarray) -> Iterator[tuple[str, str, np.ndarray | None, np.ndarray]]:
    """Per step of the softmax its weight and bias, the softmax that each unit's belongs to (none: there is one) and the unit's place in it."""
    kind, place = np.divmod(unit, w["m"].shape[1])
    yield "C", "c", None, kind
    yield "M", "m", kind, place


def _hidden(w: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and hidden vectors, and one hidden vector more, of zeros, that fills stacks up."""
    x = w["E"].take(around, 0).reshape(-1, 2 * SIDE * WIDTH)
    h = np.zeros((len(x) + 1, HIDDEN), x.dtype)
    np.matmul(x, w["W"], out=h[:-1])
    h[:-1] += w["b"]
    np.tanh(h[:-1], out=h[:-1])
    return x, h


def log_probabilities(w: dict[str, np.ndarray], target: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log P(target | context): class, then place in the class."""
    out = np.empty(len(target), np.float32)
    # parts of one size: a small last one would gather most weights for few rows
    size = -(-len(target) // max(1, round(len(target) / SCORED))) or 1
    for a in range(0, len(target), size):
        _, h = _hidden(w, around[a:a + size])
        lp = np.zeros(len(h), h.dtype)
        for weight, bias, group, place in _steps(w, _units(target[a:a + size])):
            if group is None:
                lp[:-1] += _log_softmax_at(h[:-1], w[weight], w[bias], place)
                continue
            place = np.append(place, 0)
            large, small = _stacks(group)
            for k, rows in large:
                lp[rows] += _log_softmax_at(h[rows], w[weight][k], w[bias][k], place[rows])
            for k, rows, _ in small:
                _, total, own = _exp_logits(h[rows], w[weight][k], w[bias][k], place[rows])
                lp[rows] += own - np.log(total)
        out[a:a + size] = lp[:-1]
    return out


def _each_gradient(w: dict[str, np.ndarray], target: np.ndarray, around: np.ndarray) -> Iterator[tuple[str, object, np.ndarray]]:
    """Weight, place and gradient of every part that a batch touches; what was passed on may be changed at once."""
    n = len(target)
    x, h = _hidden(w, around)
    dh = np.zeros_like(h)
    for weight, bias, group, place in _steps(w, _units(target)):
        if group is None:
            back, by_weight, by_bias = _softmax_gradients(h[:-1], w[weight], w[bias], place, n)
            dh[:-1] += back
            yield weight, ..., by_weight
            yield bias, ..., by_bias
            continue
        place = np.append(place, 0)
        large, small = _stacks(group)
        for k, rows in large:
            back, by_weight, by_bias = _softmax_gradients(h[rows], w[weight][k], w[bias][k], place[rows], n)
            dh[rows] += back
            yield weight, k, by_weight
            yield bias, k, by_bias
        for k, rows, real in small:
            part, own = h[rows], w[weight][k]
            z, total, _ = _exp_logits(part, own, w[bias][k], place[rows])
            z.reshape(-1, z.shape[2])[np.arange(rows.size), place[rows].ravel()] -= total.ravel()
            scale = (real / (n * total))[:, :, None]
            back = z @ own.transpose(0, 2, 1)
            back *= scale
            dh[rows] += back
            part *= scale
            yield weight, k, part.transpose(0, 2, 1) @ z
            yield bias, k, (scale.transpose(0, 2, 1) @ z)[:, 0]
    dh, h = dh[:-1], h[:-1]
    dz = dh * (1 - h * h)
    dx = np.ascontiguousarray((dz @ w["W"].T).reshape(-1, WIDTH).T, float)
    yield "W", ..., x.T @ dz
    yield "b", ..., dz.sum(0)
    flat = around.ravel()
    seen = np.bincount(flat, minlength=len(w["E"])) > 0
    ids, flat = np.flatnonzero(seen), (np.cumsum(seen) - 1)[flat]
    yield "E", ids, np.stack([np.bincount(flat, d, len(ids)) for d in dx], 1).astype(w["E"].dtype)


def gradients(w: dict[str, np.ndarray], target: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean negative log-probability of a batch."""
    out = {k: np.zeros_like(v) for k, v in w.items()}
    for k, at, g in _each_gradient(w, target, around):
        out[k][at] = g
    return out


def improve(model: WindowModel, texts: Iterator[str], turn: int) -> tuple[np.ndarray, int]:
    """Adagrad over every position of the texts, in an order drawn from ``turn``; the improved weights and the positions used."""
    vector, held, count = model.vector.copy(), [], 0
    shape = shapes(len(model.ids))
    w, seen = _unpack(vector, shape), {k: np.full(s, 1e-3, np.float32) for k, s in shape.items()}
    waiting = 0

    def step(docs: list[np.ndarray]) -> int:
        target, around = contexts(docs)
        used = 0
        pick = np.random.default_rng(turn).permutation(len(target))
        for a in range(0, len(pick), BATCH):
            at = pick[a:a + BATCH]
            rate = np.float32(RATE * np.sqrt(len(at)))
            for k, part, g in _each_gradient(w, target[at], around[at]):
                now = g * g
                now *= np.float32(len(at))
                now += seen[k][part]
                seen[k][part] = now
                g *= rate
                g /= np.sqrt(now, out=now) if isinstance(part, np.ndarray) else np.sqrt(now)
                w[k][part] -= g
            used += len(at)
        return used

    for t in texts:
        held.append(model.tokens(t))
        waiting += len(held[-1])
        if waiting > BATCH * 4:
            count += step(held)
            held, waiting = [], 0
    return vector, count + step(held)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over every document; tasks pass their counts on in parts of bounded size."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                counts.update((t or "").lower().split())
                if len(counts) > COUNTED:
                    yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                    counts = Counter()
        yield pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})
    return texts.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, seed: int = 11) -> WindowModel:
    """Learn the vocabulary and the network from all documents."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")
    counts = stored(word_counts(texts), "words")
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    ranked = counts.orderBy(F.col("n").desc(), "word")
    top = ranked.filter(F.col("n") >= tokens ** (2 / 3) / SPARSE).collect()
    if len(top) < VOCABULARY - HASHED:
        top = ranked.limit(VOCABULARY - HASHED).collect()
    ids = {r["word"]: _id(i) for i, r in enumerate(top)}
    beyond = counts.filter((F.col("n") < top[-1]["n"]) | ((F.col("n") == top[-1]["n"]) & (F.col("word") > top[-1]["word"]))) if top else counts
    classes = [0] * HASHED
    for r in beyond.groupBy(_class(F.col("word")).alias("class")).agg(F.sum("n").alias("n")).collect():
        classes[r["class"]] = r["n"]
    rng = np.random.default_rng(seed)
    shape = shapes(len(ids))
    vector = np.concatenate([(rng.normal(0, 0.1, math.prod(s)) if k in "EWCM" else np.zeros(math.prod(s))).astype(np.float32) for k, s in shape.items()])
    model = WindowModel(ids, vector, beyond.select("word", "n"), classes)
    chunks = -(-len(vector) // CHUNK)
    for turn in range(rounds):
        now = model

        def run(batches: Iterator[pd.DataFrame], now=now, turn=turn) -> Iterator[pd.DataFrame]:
            vector, n = improve(now, (t for b in batches for t in b["text"]), turn)
            if n:
                for i, p in enumerate(np.array_split(vector, chunks)):
                    yield pd.DataFrame({"chunk": [i], "n": [n], "part": [p.tobytes()]})

        own = texts.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn).coalesce(TASKS * docs.sparkSession.sparkContext.defaultParallelism)
        schema = "chunk bigint, n bigint, part binary"
        # partial averages first: no group gathers more than a share of the partitions
        learned = own.mapInPandas(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
        partial = learned.groupBy("chunk", "salt").applyInPandas(_averaged, schema)
        got = stored(partial.groupBy("chunk").applyInPandas(_averaged, schema), "weights").orderBy("chunk").collect()
        if got:
            model = WindowModel(ids, np.concatenate([np.frombuffer(r["part"], np.float32) for r in got]), model.rare, classes)
    return model


def _class(word: Column) -> Column:
    """Hash class of a word outside the vocabulary."""
    return (F.crc32(word.cast("binary")) % HASHED).cast("int")


def _averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """Average of one chunk of weights, weighted by positions."""
    rows = rows.sort_values(["n", "part"])
    total = sum(n * np.frombuffer(p, np.float32).astype(float) for n, p in zip(rows["n"], rows["part"]))
    many = int(rows["n"].sum())
    return pd.DataFrame({"chunk": [int(rows["chunk"].iloc[0])], "n": [many], "part": [(total / many).astype(np.float32).tobytes()]})


def pseudo_likelihood(model: WindowModel, text: Column) -> Column:
    """struct(n_tokens, log_prob, rare, times) of a text column; ``rare``: its words outside the vocabulary, once each, of which
    ``log_prob`` has the classes only; ``times``: how often each occurs."""
    @F.pandas_udf("n_tokens bigint, log_prob double, rare array<string>, times array<bigint>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            n, lp, values, rare, times = np.zeros(len(part), np.int64), np.zeros(len(part)), part.tolist(), [], []
            for at in range(0, len(values), 128):
                words = [(t or "").lower().split() for t in values[at:at + 128]]
                docs = [model.ids_of(x) for x in words]
                n[at:at + 128] = [len(d) for d in docs]
                # no word of the vocabulary has the id of a hash class
                for x, d in zip(words, docs):
                    found = Counter([x[i] for i in np.flatnonzero((d >= VOCABULARY - HASHED) & (d < VOCABULARY)).tolist()])
                    rare.append(list(found))
                    times.append(list(found.values()))
                each = log_probabilities(model.w, *contexts(docs)).astype(float)
                lp[at:at + 128] = np.bincount(np.repeat(np.arange(len(docs)), n[at:at + 128]), each, len(docs))
            yield pd.DataFrame({"n_tokens": n, "log_prob": lp, "rare": pd.Series(rare, dtype=object), "times": pd.Series(times, dtype=object)})
    return run(text)


def score(docs: DataFrame, model: WindowModel, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The input's rows and columns plus n_tokens, log_prob and mean (per token), under the names returned."""
    both, row, share = temp("lm"), temp("row"), temp("share")
    out = {k: temp(k) for k in ("n_tokens", "log_prob", "mean")}
    rows = stored(docs.withColumn(both, pseudo_likelihood(model, F.col(text_col))).withColumn(row, F.monotonically_increasing_id()), "scored")
    n, lp = F.col(both)["n_tokens"], F.col(both)["log_prob"]
    if model.rare is not None:
        # words of a class share its probability by their counts; a word occurs less often than any of the vocabulary, so no key is hot
        found = rows.select(row, F.col(both)["rare"].alias("word"), F.col(both)["times"].alias("times"))
        found = found.select(row, F.inline(F.arrays_zip("word", "times"))).join(model.rare, "word", "left")
        known = F.get(F.array(*[F.lit(c).cast("bigint") for c in model.class_counts]), _class(F.col("word")))
        part = F.log(F.coalesce("n", F.lit(1)) / (known + F.col("n").isNull().cast("int")))
        shares = found.groupBy(row).agg(F.sum(F.col("times") * part).alias(share))
        rows = rows.join(shares, row, "left")
        lp = lp + F.coalesce(F.col(share), F.lit(0.0))
    return rows.select(*docs.columns, n.alias(out["n_tokens"]), lp.alias(out["log_prob"]), F.when(n > 0, lp / n).otherwise(0.0).alias(out["mean"])), out
