"""Follow-the-regularised-leader logistic regression on sparse rows, trained in shards and averaged."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Ftrl:
    """Per-coordinate learning rates with L1 and L2 penalties; one column of weights per class."""

    def __init__(self, buckets: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.z = np.zeros((buckets, classes))
        self.n = np.zeros((buckets, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, target: np.ndarray, binary: bool) -> None:
        """One row: distinct buckets, their values, and the target of each class."""
        w = self.weights(at)
        logit = values @ w
        if binary:
            guess = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
        else:
            e = np.exp(logit - logit.max())
            guess = e / e.sum()
        g = values[:, None] * (guess - target)[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: DataFrame, buckets: int, classes: int, epochs: int, **penalties: float) -> np.ndarray:
    """Weights (buckets, classes) from rows(rank, shard, target, at, values), the mean over shards.

    target is a class number, or with classes = 1 the label 0 or 1. Each shard is a task that learns
    from its own rows in the order of rank. What reaches the driver is the weights.
    """
    binary = classes == 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(buckets, classes, **penalties)
        pdf = pdf.sort_values("rank")
        hot = np.eye(max(classes, 2))
        for _ in range(epochs):
            for target, at, values in zip(pdf["target"], pdf["at"], pdf["values"]):
                model.learn(np.asarray(at), np.asarray(values, float), np.array([float(target)]) if binary else hot[target], binary)
        w = model.weights()
        at, klass = np.nonzero(w)
        return pd.DataFrame({"at": at.astype("int32"), "class": klass.astype("int32"), "w": w[at, klass], "shard": pdf["shard"].iloc[0]})

    learned = rows.groupBy("shard").applyInPandas(run, "at int, class int, w double, shard int")
    found = learned.groupBy("at", "class").agg(F.sum("w").alias("w")).toPandas()
    used = rows.select("shard").distinct().count()
    out = np.zeros((buckets, classes))
    out[found["at"].to_numpy(), found["class"].to_numpy()] = found["w"].to_numpy() / max(used, 1)
    return out
