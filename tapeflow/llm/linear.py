"""A sparse multinomial logistic model trained with follow-the-regularised-leader, and the bounded sample it is fitted on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ftrl:
    """Step size and the elastic net: l1 sets small weights to zero, l2 shrinks the rest."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    epochs: int = 3

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        big = np.abs(z) > self.l1
        return np.where(big, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, dims: int) -> np.ndarray:
        """Weights (dims + 1, classes) of sparse rows (places, values) with soft targets; the last row is the intercept."""
        z = np.zeros((dims + 1, targets.shape[1]))
        n = np.zeros_like(z)
        rng = np.random.default_rng(0)
        for _ in range(self.epochs):
            for k in rng.permutation(len(rows)):
                at, x = rows[k]
                at, x = np.append(at, dims), np.append(x, 1.0)
                zk, nk = z[at], n[at]
                w = self.weights(zk, nk)
                g = x[:, None] * (softmax(x @ w) - targets[k])
                more = nk + g * g
                z[at] = zk + g - (np.sqrt(more) - np.sqrt(nk)) / self.alpha * w
                n[at] = more
        return self.weights(z, n)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def logits(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Scores of sparse rows."""
    out = np.empty((len(rows), weights.shape[1]))
    for k, (at, x) in enumerate(rows):
        out[k] = x @ weights[at] + weights[-1]
    return out


def temperature(scores: np.ndarray, targets: np.ndarray) -> float:
    """Divisor of the scores under which held-back rows are most likely, by golden-section search on its logarithm."""
    if not len(scores):
        return 1.0

    def loss(t: float) -> float:
        return -float((targets * np.log(softmax(scores / np.exp(t)) + 1e-300)).sum())

    low, high, g = np.log(0.02), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def bounded_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows, those of the least hashes of ``key``: the same rows whatever the partitions.

    Only hashes are ordered; the wide rows are filtered by the hash that was reached.
    """
    hashed = rows.withColumn("sample_hash", F.xxhash64(F.lit("sample"), key))
    last = hashed.select("sample_hash").orderBy("sample_hash").limit(most).agg(F.max("sample_hash")).first()[0]
    return hashed.where(F.col("sample_hash") <= F.lit(last)).drop("sample_hash").limit(most)
