"""Linear hinge-loss models fitted by dual coordinate descent, for bounded training sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, cost: float = 1.0,
                            epochs: int = 20, seed: int = 0, tol: float = 1e-3) -> np.ndarray:
    """Weights (the last is the bias) of an L1-loss linear SVM; ``rows`` are (indices, values), ``y`` is +1 or -1."""
    w = np.zeros(dim + 1)
    rows = [(np.append(i, dim), np.append(v, 1.0)) for i, v in rows]
    norm = [float(v @ v) for _, v in rows]
    alpha = np.zeros(len(rows))
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        worst = 0.0
        for k in order:
            i, v = rows[k]
            g = y[k] * float(w[i] @ v) - 1.0
            a = alpha[k]
            projected = min(g, 0.0) if a <= 0 else max(g, 0.0) if a >= cost else g
            worst = max(worst, abs(projected))
            if projected:
                alpha[k] = min(max(a - g / norm[k], 0.0), cost)
                w[i] += (alpha[k] - a) * y[k] * v
        if worst < tol:
            break
    return w


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def sampled(labelled: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each label, chosen by a hash of the key (all, where there are fewer).

    The labels are counted over all rows, and every label is kept.
    """
    counts = labelled.groupBy(label).count().orderBy(label).collect()
    if not counts:
        return labelled.limit(0)
    parts = [x for r in counts for x in (F.lit(r[label]), F.lit(min(1.0, per_class / r["count"])))]
    share: Column = F.create_map(*parts)[F.col(label)]
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 31)) / float(1 << 31)
    return labelled.filter(draw < share)


def with_texts(sample: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Attach whole texts to a bounded sample (the sample is broadcast; its bound is its parameter)."""
    return (docs.select(F.col(key), F.col(text)).join(F.broadcast(sample), key)
                .groupBy(*sample.columns).agg(F.min(text).alias("text")))
