"""A bounded sample of labelled texts for training, and the calibration of margins to probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """Rows (order, text, label) for ``docs`` (doc_id, text) with a row of ``labels`` (doc_id, label 0 or 1).

    The sample is drawn from ``labels`` alone: the ``max_rows`` doc_ids of each label with the smallest hash, so
    that the rows that reach ``docs`` by broadcast are bounded. Of their texts those of up to ``max_bytes`` bytes
    are used (a bound on what the training task holds; scoring takes whole texts of any length). Null labels, ids
    and texts are left out; an id with both labels counts as 1; one text is taken of each id.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    known = known.withColumn("order", F.xxhash64("doc_id"))
    few = known.where("label = 0").orderBy("order", "doc_id").limit(max_rows).unionByName(known.where("label = 1").orderBy("order", "doc_id").limit(max_rows))
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(few), "doc_id").where(F.octet_length("text") <= max_bytes)
    return rows.groupBy("order", "label").agg(F.min("text").alias("text")).select("order", "text", "label")


def shift(labels: DataFrame, sampled: tuple[int, int]) -> float:
    """What to add to log odds learned on ``sampled`` (rows of label 0, of label 1) to have those of all labels."""
    n = {r["label"]: r["count"] for r in labels.where("doc_id is not null and label in (0, 1)").groupBy("label").count().collect()}
    if min(sampled) == 0 or len(n) < 2:
        return 0.0
    return float(np.log(n[1] / n[0]) - np.log(sampled[1] / sampled[0]))


def calibrate(margins: np.ndarray, labels: np.ndarray, bias: float = 0.0) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of labels on margins by Newton steps, with a weak pull to (1, bias)."""
    at = np.array([1.0, bias])
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    pull = np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        g = x.T @ (labels - p) - pull @ (at - [1.0, bias])
        h = (x * (p * (1 - p))[:, None]).T @ x + pull
        step = np.linalg.solve(h, g)
        at = at + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])
