"""Bounded samples of labelled documents for fitting, and the calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelanes.llm.common import fold, whole_text

#: Fold 0 of so many is held out.
FOLDS = 5


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int) -> DataFrame:
    """``_text`` and ``_label`` of up to ``per_class`` documents of each label, never of the held-out fold.

    The smallest hashes of the identifier win, so the sample doesn't depend on
    partitioning. Only documents of up to ``most_bytes`` serve for fitting. An
    identifier labelled twice counts once, with its larger label; of several texts
    of one identifier the smallest counts.
    """
    marks = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & (fold(FOLDS, "_id") != 0))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    # sizes first, without the texts; then the texts of the chosen, 2 * per_class identifiers at most
    sizes = docs.select(F.col("doc_id").alias("_doc"), F.octet_length(whole_text()).alias("_size"))
    met = sizes.where(F.col("_size") <= most_bytes).join(marks, F.col("_doc") == F.col("_id")).select("_id", "_label").distinct()
    each = [met.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for k in (0, 1)]
    chosen = each[0].unionByName(each[1])
    return (
        docs.select("doc_id", whole_text().alias("_text"))
        .where(F.octet_length("_text") <= most_bytes)
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .groupBy("_id", "_label")
        .agg(F.min("_text").alias("_text"))
        .select("_text", "_label")
    )


def platt(x: np.ndarray, y: np.ndarray, share: float = 0.5, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset of a logistic curve through raw scores, label 1 weighing ``share`` of the whole."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
