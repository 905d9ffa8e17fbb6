"""Logistic models over hashed sparse features, learned with follow-the-regularised-leader steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import small_batches

#: (indices, values) of a text: distinct indices below the model's size.
Features = tuple[np.ndarray, np.ndarray]


class Ftrl:
    """FTRL-Proximal for the logistic loss: per-coordinate rates, L1 keeps weights of chance features at zero."""

    def __init__(self, size: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.5, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, gradient: np.ndarray) -> None:
        w, before = self.weights(at), self.n[at]
        after = before + gradient * gradient
        self.z[at] += gradient - (np.sqrt(after) - np.sqrt(before)) / self.alpha * w
        self.n[at] = after


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[Features, int]], size: int, epochs: int = 4, twins: list[Features | None] | None = None, fairness: float = 0.0, seed: int = 7, **ftrl) -> np.ndarray:
    """Weights for labelled features. Index 0 is the intercept: callers leave it free in their features.

    twins: for each row None, or the features of its counterfactual. Each step adds fairness * (z - z')**2 to the loss,
    z and z' being the scores (before the sigmoid) of the row and of its twin.
    """
    model, order = Ftrl(size, **ftrl), np.random.default_rng(seed)
    zero, one = np.zeros(1, np.int64), np.ones(1)
    prepared = [(np.concatenate([zero, at.astype(np.int64)]), np.concatenate([one, x])) for (at, x), _ in rows]
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = prepared[i]
            z = model.weights(at) @ x
            model.step(at, (sigmoid(z) - rows[i][1]) * x)
            if twins and twins[i] is not None and fairness:
                both, d = _difference((at[1:], x[1:]), twins[i])
                if len(both):
                    model.step(both, 2 * fairness * (model.weights(both) @ d) * d)
    return model.weights().astype(np.float32)


def _difference(a: Features, b: Features) -> Features:
    at, where = np.unique(np.concatenate([a[0], b[0].astype(np.int64)]), return_inverse=True)
    d = np.bincount(where, np.concatenate([a[1], -b[1]]), len(at))
    return at[d != 0], d[d != 0]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: Column, most: int, features: Callable[[str], list[Features]]) -> list[tuple[int, list[Features], int]]:
    """(doc_id, features(text), label) of at most `most` labelled documents, those of the smallest hash of doc_id.

    This bound is the one thing that is sampled. A doc_id whose labels contradict one another is not learned from; of
    rows that share a doc_id, the one of smallest text hash stands for it. Features are made where the texts are, so what
    reaches the driver is bounded by `most` and the size of the feature space, whatever the texts' lengths.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & fold).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where(F.col("label") == F.col("other")).drop("other")
    ids = known.withColumn("_h", F.xxhash64("doc_id", F.lit(3))).orderBy("_h", "doc_id").limit(most).drop("_h")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [features(t) for t in pdf.text]
            pack = lambda k, kind: [[np.asarray(f[k], kind).tobytes() for f in fs] for fs in made]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "label": pdf.label, "at": pack(0, np.int32), "x": pack(1, np.float64)})

    found = texts.mapInPandas(run, "doc_id long, label int, at array<binary>, x array<binary>").toLocalIterator()
    return sorted(((r.doc_id, [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float64)) for a, x in zip(r["at"], r.x)], r.label) for r in found), key=lambda r: r[0])


def score(docs: DataFrame, features: Callable[[str], Features], weights: np.ndarray, cut: float) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text): a sparse dot product on each whole text."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = model.value
        for pdf in batches:
            out = np.empty(len(pdf))
            for i, text in enumerate(pdf.text):
                at, x = features(text or "")
                out[i] = float(w[0]) + float(w[at] @ x)
            out = sigmoid(out)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": out, "predicted": (out >= cut).astype("int32")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, score double, predicted int")
