"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is encoded by a small learned layer;
gated attention, tanh(V h) * sigmoid(U h), weighs the passages; the weighted mean gives the document's score.
All weights are learned together in numpy from document labels alone.

Passages are runs of ``PASSAGE`` UTF-8 bytes (the last may be shorter), described by shares of byte
classes, word lengths and how concentrated their hashed trigrams are (repetition).

Defined results: null and empty texts are one empty passage and get a score; rows with a null id, label or
text and held-out rows are not learned from; with one label only (or none) every score is that label's
share of the learned rows (0.5 without any); repeated rows are scored alike; an empty table gives an empty result; columns are kept whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import learnable, prepare, row_blocks, sampled, temp

PASSAGE = 512
#: bounds of the learned sample
MAX_ROWS = 6000
MAX_CHARS = 200_000
GRAMS = 512
_CLASSES = 15


def _class_table() -> np.ndarray:
    """Byte classes: lower, upper, digit, blank, line break, then marks of their own or together, and bytes of longer characters."""
    table = np.full(256, 13, np.int64)
    for b in range(128):
        ch = chr(b)
        table[b] = (0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch in " \t" else 4 if ch in "\n\r"
                    else 5 if ch == "." else 6 if ch == "," else 7 if ch == "!" else 8 if ch == "|" else 9 if ch in "$%&#*"
                    else 10 if ch in "<>{}[]()/\\=_" else 11 if ch in ":;?'\"-" else 12)
    table[128:] = 13
    return table


_TABLE = _class_table()
WIDTH = _CLASSES + 5


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the number of passages of each text."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    count = np.maximum(1, -(-sizes // PASSAGE))
    out = np.zeros((int(count.sum()), WIDTH), np.float32)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.frombuffer(b"".join(raw), np.uint8)
    first = np.concatenate([[0], np.cumsum(count)])
    for a, b in row_blocks(offsets, 1 << 20):
        data = whole[offsets[a]:offsets[b]]
        if not len(data):
            continue
        text = np.repeat(np.arange(a, b), sizes[a:b])
        place = np.arange(len(data)) + offsets[a] - offsets[text]
        of = first[text] - first[a] + place // PASSAGE
        n = int(first[b] - first[a])
        length = np.maximum(np.bincount(of, minlength=n), 1).astype(np.float32)
        kind = _TABLE[data]
        rows = out[first[a]:first[b]]
        rows[:, :_CLASSES] = np.bincount(of * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES) / length[:, None]
        blank = (kind == 3) | (kind == 4)
        start = np.ones(len(data), bool)
        start[1:] = blank[:-1]
        words = np.bincount(of, (start & ~blank).astype(float), minlength=n)
        rows[:, _CLASSES] = np.minimum((length - np.bincount(of, blank.astype(float), minlength=n)) / np.maximum(words, 1), 40) / 10
        if len(data) > 2:
            code = (data[:-2].astype(np.uint32) << 16 | data[1:-1].astype(np.uint32) << 8 | data[2:]) * np.uint32(2654435761)
            inside = of[:-2] == of[2:]
            grams = np.bincount((of[:-2] * GRAMS + (code >> np.uint32(23)))[inside], minlength=n * GRAMS).reshape(n, GRAMS).astype(np.float32)
            many = np.maximum(grams.sum(1), 1)
            rows[:, _CLASSES + 1] = (grams > 0).sum(1) / many
            rows[:, _CLASSES + 2] = np.sqrt((grams ** 2).sum(1)) / many * 4
            rows[:, _CLASSES + 3] = grams.max(1) / many * 4
        rows[:, _CLASSES + 4] = np.log1p(length) / np.log(PASSAGE + 1)
    return out, count


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        h = np.tanh(x @ w["W"] + w["b"])
        av, au = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (av * au) @ w["a"]
        bag = np.repeat(np.arange(len(count)), count)
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        alpha = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(alpha[:, None] * h, start, axis=0)
        return {"h": h, "av": av, "au": au, "alpha": alpha, "z": z, "bag": bag, "start": start, "p": _sigmoid(z @ w["c"] + w["d"][0])}

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts or not self.weights:
            return np.full(len(texts), self.prior)
        x, count = passages(texts)
        return self.forward((x - self.mean) / self.scale, count)["p"].astype(float)


def fit(x: np.ndarray, count: np.ndarray, label: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 64, seed: int = 5) -> QualityModel:
    """Adam on the log loss of document labels, through the attention."""
    prior = float(label.mean()) if len(label) else 0.5
    if prior in (0.0, 1.0) or not len(label):
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), {}, prior)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float64)
    rng = np.random.default_rng(seed)
    w = {"W": rng.normal(0, 0.3, (WIDTH, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)),
         "a": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    model, step = QualityModel(mean, scale, w, prior), 0
    first = np.concatenate([[0], np.cumsum(count)])
    for epoch in range(epochs):
        order = rng.permutation(len(count))
        for at in range(0, len(order), batch):
            docs = order[at:at + batch]
            n = count[docs]
            rows = np.repeat(first[docs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            xb = x[rows]
            f = model.forward(xb, n)
            err = (f["p"] - label[docs]) / len(docs)
            dz = err[:, None] * w["c"]
            dalpha = (f["h"] * dz[f["bag"]]).sum(1)
            de = f["alpha"] * (dalpha - np.add.reduceat(f["alpha"] * dalpha, f["start"])[f["bag"]])
            dgate = de[:, None] * w["a"]
            dv, du = dgate * f["au"] * (1 - f["av"] ** 2), dgate * f["av"] * f["au"] * (1 - f["au"])
            dh = f["alpha"][:, None] * dz[f["bag"]] + dv @ w["V"].T + du @ w["U"].T
            dpre = dh * (1 - f["h"] ** 2)
            g = {"W": xb.T @ dpre, "b": dpre.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": (f["av"] * f["au"]).T @ de,
                 "c": f["z"].T @ err, "d": np.array([err.sum()])}
            step += 1
            rate = 0.01 * 0.9 ** epoch
            for k in w:
                grad = g[k] + 1e-5 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad ** 2
                w[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> QualityModel:
    """Learn from about ``max_rows`` labelled rows that are not held out, of at most ``max_chars`` characters, drawn by a hash of the id."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna().filter(learnable(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    known = sampled(known, F.col("id"), max_rows / max(known.count(), 1))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().filter(F.length("text") <= max_chars).join(known, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, count = passages(list(b["text"]))
            ends = np.cumsum(count)
            yield pd.DataFrame({"id": b["id"].values, "label": (b["label"] > 0).astype("int32").values, "x": [x[e - n:e].tobytes() for e, n in zip(ends, count)]})

    got = rows.mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, label int, x binary").toPandas().sort_values(["id", "x"])
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in got["x"]]
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32)
    return fit(x, np.array([len(b) for b in bags], np.int64), got["label"].to_numpy(float))


def quality(model: QualityModel, text: Column) -> Column:
    """Score (0 to 1) of a text column."""
    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            values = [t or "" for t in part]
            yield pd.Series(np.concatenate([model.score(values[a:a + 512]) for a in range(0, len(values), 512)]) if values else [], dtype=float)
    return run(text)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The input's rows and columns plus score, under the name returned."""
    out = {"score": temp("score")}
    return docs.withColumn(out["score"], quality(model, F.col(text_col))), out
