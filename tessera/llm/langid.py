"""Language identification by hierarchical discrimination.

A linear model first picks the language family; inside it, one-versus-one linear support vector machines vote
on the language. Families are found, not listed: the learned languages' mean profiles are joined by average
linkage until half as many groups are left, so that closely related languages meet in one family.

Features: square roots of hashed byte bi- and trigram counts of the whole lower-cased text, white space, digits
and ASCII marks read as blanks, scaled to unit length.

Defined results: ``und`` with score 0 for a null text, a text without any letter, or when nothing could be learned;
rows with a null id, text or language are not learned from; a null id is predicted like any other; repeated
rows are scored alike; an empty table gives an empty result; columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import learnable, prepare, temp

DIM = 4096
UNKNOWN = "und"
#: learned rows over all languages (a documented bound)
MAX_ROWS = 4000
CHUNK = 1 << 19
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[b for b in range(128) if not chr(b).isalpha()]] = 32


def profiles(texts: list[str]) -> np.ndarray:
    """One unit-length row of ``DIM`` features for each text, read whole, piece by piece."""
    pieces: list[tuple[int, bytes]] = []
    for i, t in enumerate(texts):
        raw = t.lower().encode("utf-8", "replace") + b"  "
        pieces += [(i, raw[a:a + CHUNK + 2]) for a in range(0, max(len(raw) - 2, 1), CHUNK)]
    out = np.zeros((len(texts), DIM), np.float32)
    at = 0
    while at < len(pieces):
        stop, size = at, 0
        while stop < len(pieces) and (size < CHUNK or stop == at):
            size += len(pieces[stop][1])
            stop += 1
        part = pieces[at:stop]
        raw = _BLANK[np.frombuffer(b"".join(p for _, p in part), np.uint8)]
        first, n = part[0][0], part[-1][0] - part[0][0] + 1
        length = np.array([len(p) for _, p in part])
        own = np.ones(len(raw), bool)  # a gram belongs to the piece where it starts: a piece's last two bytes start none
        own[np.cumsum(length) - 1] = own[np.cumsum(length) - 2] = False
        own = own[:-2]
        base = (np.repeat(np.array([i for i, _ in part]) - first, length)[:-2] * DIM)[own]
        a, b, c = (x.astype(np.uint32)[own] for x in (raw[:-2], raw[1:-1], raw[2:]))
        for code in ((a << 8 | b) * np.uint32(2654435761), (a << 16 | b << 8 | c) * np.uint32(2246822519)):
            out[first:first + n] += np.bincount(base + (code >> np.uint32(20)), minlength=n * DIM).reshape(n, DIM)
        at = stop
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Squared-hinge support vector machine (y is +1 or -1), accelerated full gradient steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # both classes weigh alike
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    last = w
    rate = 1.0 / (2 * 2 + l2)  # rows have length sqrt(2) at most
    for k in range(steps):
        ahead = w + (k / (k + 3)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ ahead)) * y * share
        last, w = w, ahead - rate * (l2 * ahead - 2 * (x.T @ slack))
    return w


def families(means: np.ndarray, most: int) -> list[list[int]]:
    """Average linkage on the cosine of the languages' mean profiles until ``most`` groups are left."""
    near = means @ means.T
    groups = [[i] for i in range(len(means))]
    while len(groups) > most:
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: (np.mean([near[i, j] for i in groups[p[0]] for j in groups[p[1]]]), -p[0], -p[1]))
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    groups: list[list[int]]
    family: np.ndarray  # one row of weights per family
    pairs: dict[tuple[int, int], np.ndarray]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.names or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        x = np.hstack([profiles(texts), np.ones((len(texts), 1), np.float32)])
        if len(self.groups) > 1:
            z = 4 * (x @ self.family.T)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
        else:
            p = np.ones((len(texts), 1))
        best = p.argmax(1)
        lang, score = np.zeros(len(texts), int), p.max(1).astype(float)
        for g, members in enumerate(self.groups):
            rows = np.flatnonzero(best == g)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(members)))
            for i, j in combinations(range(len(members)), 2):
                sure = 1 / (1 + np.exp(-4 * (x[rows] @ self.pairs[members[i], members[j]])))
                votes[:, i] += sure
                votes[:, j] += 1 - sure
            lang[rows] = np.array(members)[votes.argmax(1)]
            if len(members) > 1:
                score[rows] *= votes.max(1) / (len(members) - 1)
        return [self.names[i] for i in lang], [float(min(1.0, max(0.0, s))) for s in score]


def fit(names: list[str], x: np.ndarray, y: np.ndarray) -> LanguageModel:
    """Learn from unit-length profiles ``x`` and language numbers ``y``."""
    if not names:
        return LanguageModel([], [], np.zeros((0, DIM + 1)), {})
    means = np.stack([x[y == i].mean(0) for i in range(len(names))])
    means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    groups = families(means - means.mean(0), -(-len(names) // 2))
    member = np.zeros(len(names), int)
    for g, ids in enumerate(groups):
        member[ids] = g
    family = np.stack([linear_svm(x, np.where(member[y] == g, 1, -1).astype(np.float32)) for g in range(len(groups))])
    pairs = {}
    for ids in groups:
        for i, j in combinations(ids, 2):
            rows = (y == i) | (y == j)
            pairs[i, j] = linear_svm(x[rows], np.where(y[rows] == i, 1, -1).astype(np.float32))
    return LanguageModel(names, groups, family, pairs)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> LanguageModel:
    """Learn from rows that are not held out: about ``max_rows`` in all, as many of each language, drawn by a hash of the id.

    Only the chosen rows' profiles (fixed size) reach the driver.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna().filter(learnable(F.col("id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return fit([], np.zeros((0, DIM)), np.zeros(0, int))
    share = F.create_map(*[F.lit(v) for k in names for v in (k, min(1.0, max_rows / len(names) / counts[k]))])
    drawn = rows.filter(F.pmod(F.xxhash64("id", F.lit(7919)), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at:at + 256]
                x = profiles(list(part["text"])).astype(np.float16)
                yield pd.DataFrame({"id": part["id"].values, "lang": part["lang"].values, "x": [r.tobytes() for r in x]})

    got = drawn.mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, lang string, x binary").toPandas().sort_values(["id", "lang", "x"])
    names = sorted(set(got["lang"]))
    x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32) if len(got) else np.zeros((0, DIM), np.float32)
    return fit(names, x, np.array([names.index(v) for v in got["lang"]], int))


def language(model: LanguageModel, text: Column) -> Column:
    """struct(lang, score) of a text column."""
    @F.pandas_udf("lang string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            lang, score = [UNKNOWN] * len(part), [0.0] * len(part)
            some = [i for i, t in enumerate(part) if t is not None and any(map(str.isalpha, t))]
            values = part.tolist()
            for at in range(0, len(some), 256):
                ids = some[at:at + 256]
                for i, a, b in zip(ids, *model.predict([values[i] for i in ids])):
                    lang[i], score[i] = a, b
            yield pd.DataFrame({"lang": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype=float)})
    return run(text)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The input's rows and columns plus lang and score, under the names returned."""
    both = temp("lang")
    out = {k: temp(k) for k in ("lang", "score")}
    rows = docs.withColumn(both, language(model, F.col(text_col)))
    return rows.select(*docs.columns, *[F.col(both)[k].alias(out[k]) for k in out]), out
