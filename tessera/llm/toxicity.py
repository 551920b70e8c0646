"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are the presence of words and of word beginnings that labelled toxic documents favour. One weight
vector is shared by all ordered thresholds: P(grade >= k) = sigmoid(w . x - t_k) with t_1 <= t_2 <= ...;
a document's severity is the expected grade, the sum of these probabilities.

Grades of the training rows: 0 for label 0; a toxic row is graded 1, 2 or 3 by how many selected features it
shows, cut at the thirds of the toxic rows.

Defined results: null and empty texts have no features and get the severity that the thresholds alone give; null
labels, ids and texts are not learned from; without both labels no feature is selected and every severity is 0;
repeated rows are scored alike; an empty table gives an empty result; columns are kept whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, sampled, temp

WORDS = re.compile(r"\w+")
STEMS = (4, 5, 6)
#: bounds of the learned sample and of the model
MAX_ROWS = 20_000
MAX_FEATURES = 4096
MIN_TOXIC = 3
#: how much more often, in nats, toxic rows show a feature
MIN_LOG_ODDS = 2.5
GRADES = 3


def features(text: str | None) -> set[str]:
    """Distinct lower-cased words of the whole text and their beginnings (``stem*``)."""
    words = set(WORDS.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def score(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        if not self.weights:
            return [0.0] * max(1, len(self.thresholds))
        w, total = self.weights, 0.0
        get = w.get
        for word in set(WORDS.findall((text or "").lower())):
            total += get(word, 0.0)
            n = len(word)
            for k in STEMS:
                if n > k:
                    total += get(word[:k] + "*", 0.0)
        return [1 / (1 + np.exp(-np.clip(total - t, -40, 40))) for t in self.thresholds]


def _statistics(rows: DataFrame) -> DataFrame:
    """feature, toxic rows and rows that show it, counted per batch before the shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toxic, every = Counter(), Counter()
            for text, label in zip(b["text"], b["label"]):
                found = features(text)
                every.update(found)
                if label:
                    toxic.update(found)
            # a feature that no toxic row of the batch shows matters only if other batches' toxic rows show it
            yield pd.DataFrame({"feature": list(every), "toxic": [toxic[f] for f in every], "n": list(every.values())})
    return rows.mapInPandas(run, "feature string, toxic bigint, n bigint").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> ToxicityModel:
    """Learn from about ``max_rows`` labelled rows, drawn by a hash of the id (a documented bound)."""
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    total = known.count()
    known = sampled(known, F.col("id"), max_rows / max(total, 1))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().join(known, "id").select("text", "label").persist()
    try:
        sizes = {r["label"] > 0: r["n"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
        pos, neg = sizes.get(True, 0), sizes.get(False, 0)
        if not pos or not neg:
            return ToxicityModel({}, (0.0,))
        odds = F.log((F.col("toxic") + 0.5) / (pos + 1.0)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (neg + 1.0))
        kept = _statistics(rows).withColumn("odds", odds).filter((F.col("toxic") >= MIN_TOXIC) & (F.col("odds") >= MIN_LOG_ODDS))
        chosen = [r["feature"] for r in kept.orderBy((F.col("odds") * F.col("toxic")).desc(), "feature").limit(max_features).collect()]
        at = {f: i for i, f in enumerate(chosen)}

        def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"label": (b["label"] > 0).astype("int32"),
                                    "at": [sorted(at[f] for f in features(t) if f in at) for t in b["text"]]})
        # rows that show the same features are one training row with a weight
        seen = rows.mapInPandas(lists, "label int, at array<int>").groupBy("label", "at").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "at").collect()
    finally:
        rows.unpersist()
    return fit(chosen, [(r["label"], r["at"], r["n"]) for r in seen])


def fit(chosen: list[str], rows: list[tuple[int, list[int], int]], steps: int = 400, l2: float = 1e-4) -> ToxicityModel:
    """Full-batch Adam on the ordinal likelihood of (label, feature numbers, weight) rows."""
    hits = np.array([len(r[1]) for r in rows], float)
    label = np.array([r[0] for r in rows])
    n = np.array([r[2] for r in rows], float)
    toxic = np.repeat(hits[label > 0], n[label > 0].astype(int))
    cuts = [np.quantile(toxic, (k + 1) / GRADES) for k in range(GRADES - 1)]
    grade = np.where(label > 0, 1 + sum((hits > c).astype(int) for c in cuts), 0)
    row = np.repeat(np.arange(len(rows)), hits.astype(int))
    col = np.array([i for r in rows for i in r[1]], np.int64)
    share = n / n.sum()
    above = (grade[:, None] >= np.arange(1, GRADES + 1)[None, :]).astype(float)
    # parameters: shared weights, the first threshold and the logarithms of the gaps between thresholds
    p = np.concatenate([np.zeros(len(chosen)), [1.0], np.zeros(GRADES - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    d = len(chosen)
    for step in range(1, steps + 1):
        gaps = np.exp(np.clip(p[d + 1:], -5, 5))
        t = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(row, p[col], len(rows))[:, None] - t[None, :]
        # P(grade >= k) as ordered binary questions with one weight vector
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - above) * share[:, None]
        dz = err.sum(1)
        dt = -err.sum(0)
        g = np.concatenate([np.bincount(col, dz[row], d) + l2 * p[:d], [dt.sum()], [dt[k + 1:].sum() * gaps[k] for k in range(GRADES - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    gaps = np.exp(np.clip(p[d + 1:], -5, 5))
    t = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
    return ToxicityModel({f: float(w) for f, w in zip(chosen, p[:d])}, tuple(float(x) for x in t))


def severity(model: ToxicityModel, text: Column) -> Column:
    """struct(severity, p_toxic): the expected grade and P(grade >= 1) of a text column."""
    @F.pandas_udf("severity double, p_toxic double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            p = np.array([model.score(t) for t in part]).reshape(len(part), -1)
            yield pd.DataFrame({"severity": p.sum(1), "p_toxic": p[:, 0] if len(part) else []})
    return run(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The input's rows and columns plus severity and p_toxic, under the names returned."""
    both = temp("tox")
    out = {k: temp(k) for k in ("severity", "p_toxic")}
    rows = docs.withColumn(both, severity(model, F.col(text_col)))
    return rows.select(*docs.columns, *[F.col(both)[k].alias(out[k]) for k in out]), out
