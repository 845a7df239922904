"""Operator 5, quality classifier: naive Bayes support vectors.

A text's n-gram indicators are its words and the one- to three-grams of its token shapes
(lower, Capital, UPPER, number, each mark, line break; a sign tells a repeat of the token or
line before).  A shape n-gram has one indicator for being present and one for each share of
the tokens in ``SHARES`` that it reaches.  Indicators are hashed into ``2**BITS`` places.

Each indicator is scaled by its log-count ratio between the classes, and a linear hinge-loss
model is fitted on the scaled indicators by dual coordinate descent.  Ratios and model come
from about ``PER_CLASS`` labelled texts of each class, chosen by a hash of the id among all
labelled rows that may be learnt from.  Scoring reads every whole text.

Defined results: a null or empty text is scored by the bias alone; a label row without a
quality is ignored, several for one document count as the largest; without labels of both
classes every score is 0.5 (kept); repeated rows are scored alike; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import crc_mod, mix64, table
from secspark.llm.linear import dual_coordinate_descent, logistic, sampled, with_texts

PER_CLASS = 3000
BITS = 18
SHARES = (1 / 64, 1 / 16, 1 / 4)
SLOPE = 2.0
MEMO = 200_000
MULT = np.uint64(0x9E3779B97F4A7C15)


class Indicators:
    """Turns texts into sorted arrays of indicator numbers."""

    def __init__(self):
        self.cut = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]+|_+").findall
        self.memo: dict[str, tuple[int, int]] = {}

    def token(self, t: str) -> tuple[int, int]:
        """Hash of the word (0 for marks) and code of the shape."""
        if t[0].isalpha():
            shape = 1 if t.islower() else 2 if t[0].isupper() and (len(t) == 1 or t[1:].islower()) else 3 if t.isupper() else 4
            return xxhash.xxh64_intdigest(t) | 1, shape
        if t[0].isdigit():
            return 0, 5
        return 0, 16 + (xxhash.xxh32_intdigest(t) >> 4)

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = self.cut(text or "")
        if not tokens:
            return np.empty(0, np.int64)
        memo = self.memo
        for t in set(tokens):
            if t not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                    memo.update((x, self.token(x)) for x in set(tokens))
                memo[t] = self.token(t)
        pairs = np.array([memo[t] for t in tokens], np.uint64)
        words, shapes = pairs[:, 0], pairs[:, 1]
        # Signs of repetition: the same word as before, the same line as before.
        same = np.zeros(len(tokens), np.uint64)
        same[1:] = (words[1:] == words[:-1]) & (words[1:] > 0)
        breaks = np.flatnonzero(shapes == shapes[tokens.index("\n")]) if "\n" in tokens else np.empty(0, np.int64)
        if len(breaks):
            lines = text.split("\n")
            repeated = np.array([i > 0 and len(x) > 0 and x == lines[i - 1] for i, x in enumerate(lines)], bool)
            same[breaks[:len(repeated)]] = repeated[:len(breaks)]
        h1 = mix64(shapes * np.uint64(2) + same + np.uint64(1))
        found = [np.unique(words[words > 0])]
        grams = h1
        for n in (1, 2, 3):
            if n > 1:
                if len(h1) < n:
                    break
                grams = mix64(grams[:-1] * MULT + h1[n - 1:])
            kind, count = np.unique(grams, return_counts=True)
            found.append(kind)
            found += [mix64(kind[count >= s * len(tokens)] + np.uint64(k + 1)) for k, s in enumerate(SHARES)]
        return np.unique(mix64(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.int64)


def learnable() -> Column:
    return crc_mod("doc_id", 3) != 1


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> np.ndarray | None:
    """Weights of the indicators and, last, the bias; None without both classes."""
    marked = (labels.filter(F.col("quality").isin(0, 1) & learnable())
                    .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")))

    def vectors(batches):
        of = Indicators()
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"],
                                "x": [of(t).astype(np.int32).tobytes() for t in pdf["text"]]})

    sample = with_texts(sampled(marked, "doc_id", "quality", per_class), docs)
    data = sample.mapInPandas(vectors, "doc_id long, quality int, x binary").toPandas().sort_values("doc_id")
    y = np.where(data["quality"].to_numpy() == 1, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return None
    rows = [np.frombuffer(x, np.int32).astype(np.int64) for x in data["x"]]
    dim = 1 << BITS
    counts = {s: 1.0 + np.bincount(np.concatenate([r for r, c in zip(rows, y, strict=True) if c == s]), minlength=dim)
              for s in (1.0, -1.0)}
    ratio = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    scaled = [(r, ratio[r] / max(1.0, np.linalg.norm(ratio[r]))) for r in rows]
    w = dual_coordinate_descent(scaled, y, dim)
    return np.append(np.stack([w[:-1] * ratio, ratio]).ravel(), w[-1])


def margins(model: np.ndarray, x: np.ndarray) -> float:
    half = (len(model) - 1) // 2
    norm = max(1.0, float(np.linalg.norm(model[half + x])))
    return float(model[x].sum()) / norm + float(model[-1])


def score_of(spark: SparkSession, model: np.ndarray | None):
    """A column function: the score of a text."""
    if model is None:
        return lambda text: F.lit(0.5)
    held = spark.sparkContext.broadcast(model.astype(np.float32))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Indicators()
        for texts in batches:
            yield pd.Series([float(logistic(SLOPE * margins(held.value, of(t)))) for t in texts])

    return scores


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select("doc_id", "text")
    score = score_of(docs.sparkSession, fit(rows, labels.select("doc_id", "quality")))
    return (rows.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
                .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"),
                    table(spark, sf_dir, "labels", "doc_id", "quality"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier does not reject, all columns kept."""
    score = score_of(spark, fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")))
    return docs.filter(score(F.col("text")) >= 0.5)
