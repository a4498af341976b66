"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes (2^20 places) of its words, of the first four and
five bytes of its words, of its neighbouring word pairs and of its pairs with one word between. FTRL-proximal
keeps a learning rate per coordinate and an L1 penalty, so that few weights differ from zero;
these few are broadcast. The model is fitted in one task on at most ``SAMPLE_TOXIC`` +
``SAMPLE_CLEAN`` labelled rows, chosen by a hash of the id below each label's share, without a sort; the sample's share of toxic rows is
corrected for by weights. Features are made where a text is read, so that the fitting task gets places (four bytes each, 2^20 different
ones at most), and no text.

Edge cases: null and empty texts get the score of the bias alone; texts are read whole; a row
that repeats is answered each time; a document labelled both ways counts as toxic; without
labelled rows every score is 0.5's prior (bias 0); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.shared import fraction, mix, release, rolling, tidy, word_hashes, word_spans

#: Bounds of the labelled sample.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
BITS = 20
THRESHOLD = 0.3
_BIAS = 1 << BITS


def features(text: str | None) -> np.ndarray:
    """Places of a text's features, possibly repeated."""
    data = (text or "").encode().lower()
    h = word_hashes(data)
    if not len(h):
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data + b"\0" * 5, np.uint8)
    starts, ends = word_spans(data)
    size = np.minimum(ends - starts, 5)
    stem, stems = np.zeros(len(h), np.uint64), []
    for i in range(5):
        stem = stem * np.uint64(257) + np.where(i < size, raw[starts + i], 0).astype(np.uint64)
        stems.append(mix(stem + np.uint64(i << 50)))
    parts = [h, *stems[3:], rolling(h, 2) ^ np.uint64(0x5BD1E995), mix(h[:-2] * np.uint64(5) + h[2:]) if len(h) > 2 else h[:0]]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal logistic regression on binary features; the last place is the bias."""

    def __init__(self, alpha: float = 0.08, beta: float = 1.0, l1: float = 2.5, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(_BIAS + 1), np.zeros(_BIAS + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == _BIAS, 0, self.l1) if not isinstance(at, slice) else np.append(np.full(_BIAS, self.l1), 0)
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", epochs: int = 3) -> dict:
    """Fit on rows of ``docs`` labelled in ``labels``; returns {"at": places, "w": weights}, bias last."""
    marks = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in marks.groupBy("y").count().where("y in (0, 1)").collect()}
    bounds = {0: SAMPLE_CLEAN, 1: SAMPLE_TOXIC}
    below = [1.0 if counts.get(y, 0) <= bounds[y] else 1.1 * bounds[y] / counts[y] for y in (0, 1)]
    picked = marks.where("y in (0, 1)").withColumn("h", fraction(F.col("id"))).where(F.col("h") < F.when(F.col("y") == 1, below[1]).otherwise(below[0]))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tidy():
            for b in batches:
                at = [np.unique(features(t)).astype("<i4").tobytes() for t in b["text"]]
                yield pd.DataFrame({"id": b["id"], "y": b["y"], "h": b["h"], "d": b["d"], "at": at})

    kind = chosen.schema["id"].dataType.simpleString()
    # of several texts under one id the one whose hash is least (a null text's is that of nothing)
    rows = chosen.withColumn("d", F.xxhash64("text")).mapInPandas(lambda b: places(b), f"id {kind}, y int, h double, d long, at binary").groupBy("id", "y", "h").agg(F.min_by("at", "d").alias("at"))
    share = [max(1.0, counts.get(0, 0) / SAMPLE_CLEAN), max(1.0, counts.get(1, 0) / SAMPLE_TOXIC)]
    weight = [x / min(share) for x in share]

    def train(group: pd.DataFrame) -> pd.DataFrame:
        release()
        group = group.sort_values(["h", "id"])
        group = pd.concat([group[group["y"] == y].head(n) for y, n in bounds.items()])
        model, order = Ftrl(), np.random.default_rng(11)
        items = [(np.append(np.frombuffer(a, "<i4").astype(np.int64), _BIAS), y) for a, y in zip(group["at"], group["y"], strict=True)]
        for _ in range(epochs):
            for i in order.permutation(len(items)):
                at, y = items[i]
                model.learn(at, y, weight[y])
        w = model.weights(slice(None))
        at = np.append(np.flatnonzero(w[:-1]), _BIAS)
        return pd.DataFrame({"at": at, "w": w[at]})

    fitted = rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(train, "at long, w double").collect()
    return {"at": np.array([r.at for r in fitted] or [_BIAS]), "w": np.array([r.w for r in fitted] or [0.0])}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id and score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tidy():
            w = np.zeros(_BIAS + 1)
            w[shared.value["at"]] = shared.value["w"]
            known = w != 0
            known[_BIAS] = False
            for b in batches:
                total = []
                for text in b["__text"]:
                    at = features(text)
                    total.append(w[_BIAS] + w[np.unique(at[known[at]])].sum())
                yield pd.DataFrame({id_col: b[id_col], "score": 1 / (1 + np.exp(-np.clip(np.array(total, float), -35, 35)))})

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInPandas(run, schema)
