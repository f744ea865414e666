"""What both classifiers share: a bounded sample of labelled texts, and score calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of each class to learn from, and how many characters their whole texts may have altogether.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000_000


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) of each class, in order of a hash of the id.

    ``train`` is a condition on ``doc_id``. An id with both labels counts as 1. Texts of any length
    are learned from, whole; rows of a class go in the same order until their texts make ``chars``
    characters, and the first that goes beyond ends the sample (all texts are scored alike).
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(train)
    one = clean.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    parts = [one.where(F.col("label") == y).orderBy(order, "doc_id").limit(rows) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 * rows pairs at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text") != "")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    in_order = Window.partitionBy("label").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = found.withColumn("so_far", F.sum(F.char_length("text")).over(in_order)).where(F.col("so_far") <= chars)
    return sorted((r["text"], r["label"]) for r in within.select("text", "label").collect())


class Logistic:
    """A calibrated probability from a few features, by Newton steps with a slight ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2):
        x = np.asarray(x, np.float64).reshape(len(y), -1)
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.maximum(x.std(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
        design = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        w = np.zeros(design.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            gradient = design.T @ (p - y) + ridge * w
            hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64).reshape(-1, len(self.mean))
        return 1 / (1 + np.exp(-np.clip(self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:], -30, 30)))
