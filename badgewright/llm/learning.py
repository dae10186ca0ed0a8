"""What the two classifiers share: labelled samples, held-out rows, logistic weights."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str) -> Column:
    """Rows no label of which is learned: crc32 of the id as text divisible by five. A null id is none of them."""
    text = F.col(doc_id).cast("string").cast("binary")
    return F.coalesce(F.pmod(F.crc32(text), F.lit(FOLDS)) == 0, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, column: str = "text") -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents that are not held out, picked by the hash of their id.

    Only the picked ids and labels are broadcast, ``rows`` of them at most, so no text is shuffled. ``column`` names
    another column than the text.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(picked), "doc_id").select(column, "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the last one the intercept, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
