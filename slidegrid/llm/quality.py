"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk towards the pooled one and that towards its diagonal; a score is
the logistic of the two log densities' difference, taken from Mahalanobis distances with the classes' Cholesky
factors, which are computed once. Fitting uses a bounded sample of the labelled rows (`max_train_rows`), drawn by
a hash of the id; scoring covers every row in one pass without a shuffle.

Cases: a null text is an empty text and gets a score as any other; a null id is never learnt from and is not held
out; repeated rows are scored each; an id with contradicting labels counts with the smallest; with an empty table or
with labels of one class only, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import bucket_of, pick

MAX_TRAIN_ROWS, SHRINK_POOLED, SHRINK_DIAGONAL, CUT = 40_000, 0.05, 0.05, 0.7

_KIND = np.zeros(256, np.int64)  # 0 other signs, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence signs, 7 bytes above 127
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[32, 9, 11, 12]], _KIND[[10, 13]], _KIND[128:] = 1, 2, 3, 4, 5, 7
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 6


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(_KIND, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 8) if raw else np.zeros(8)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size = len(words), max(1, len(raw))
    letters = max(1.0, counts[1] + counts[2])
    distinct = len(set(words))
    grams = len(set(zip(words, words[1:], words[2:], strict=False)))
    share = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    return np.array(
        [
            np.log1p(n),
            np.log((len(raw) - counts[4] - counts[5] + 1) / (n + 1)),
            share(counts[2], letters),
            np.sqrt(counts[0] / size),
            np.sqrt(counts[3] / size),
            np.sqrt(counts[6] / size),
            np.sqrt(counts[7] / size),
            np.log1p(len(lines)) - np.log1p(n),
            np.sqrt(1 - (distinct + 1) / (n + 1)),
            np.sqrt(1 - (grams + 1) / (max(0, n - 2) + 1)),
            np.sqrt(1 - (len(set(lines)) + 1) / (len(lines) + 1)),
            np.sqrt(raw.count(b"|") / size),
            np.sqrt(raw.count(b"!") / size),
            np.log1p(max(map(len, words), default=0)),
        ]
    )


@F.pandas_udf(ArrayType(DoubleType()))
def statistics_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([statistics(t) for t in batch])


@dataclass
class QuadraticDiscriminant:
    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None  # inverses of the Cholesky factors
    log_dets: np.ndarray | None = None

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, pooled: float = SHRINK_POOLED, diagonal: float = SHRINK_DIAGONAL) -> "QuadraticDiscriminant":
        n1 = int(y.sum()) if len(y) else 0
        prior = n1 / len(y) if len(y) else 0.5
        if not 0 < n1 < len(y):
            return QuadraticDiscriminant(prior)
        parts = [x[y == k] for k in (0, 1)]
        means = np.array([p.mean(0) for p in parts])
        scatter = [(p - m).T @ (p - m) for p, m in zip(parts, means, strict=True)]
        both = sum(scatter) / len(y)
        spread = np.diag(np.maximum(np.diag(both), 1e-4))
        both = (1 - diagonal) * both + diagonal * spread
        factors, dets = [], []
        for p, s in zip(parts, scatter, strict=True):
            weight = len(p) / (len(p) + x.shape[1])  # few rows of a class lean on the pooled covariance
            own = (1 - diagonal) * s / len(p) + diagonal * spread
            low = np.linalg.cholesky((1 - pooled) * (weight * own + (1 - weight) * both) + pooled * both)
            factors.append(np.linalg.inv(low))
            dets.append(2 * np.log(np.diag(low)).sum())
        return QuadraticDiscriminant(prior, means, np.array(factors), np.array(dets))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        far = [(((x - m) @ f.T) ** 2).sum(1) + d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        odds = 0.5 * (far[0] - far[1]) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, max_train_rows: int = MAX_TRAIN_ROWS) -> QuadraticDiscriminant:
    """docs: doc_id, text; labels: doc_id, quality. Never sees held-out rows."""
    marks = pick(labels, key="doc_id", quality="quality").where("key is not null and quality in (0, 1)").where(~held_out(F.col("key")))
    share = min(1.0, max_train_rows / max(1, marks.count()))
    chosen = lambda c: bucket_of(c, 7) < share
    marks = marks.where(chosen(F.col("key"))).groupBy("key").agg(F.min("quality").alias("quality"))
    texts = pick(docs, key="doc_id", text="text").where("key is not null").where(~held_out(F.col("key")) & chosen(F.col("key")))
    rows = texts.select("key", statistics_udf("text").alias("x")).join(marks, "key").select("x", "quality").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(statistics(None)))
    return QuadraticDiscriminant.fit(x, rows["quality"].to_numpy(int))


def scorer(model: QuadraticDiscriminant):
    """A Column function: the score of a text column."""

    @F.pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(np.array([statistics(t) for t in batch]))) if len(batch) else pd.Series([], dtype=float)

    return score


def classify(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    score = scorer(fit(docs, labels, max_train_rows=max_train_rows))
    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, *, cut: float = CUT) -> DataFrame:
    """The rows of docs, all their columns, that the classifier accepts."""
    names, text = docs.columns, docs.columns.index("text")
    score = scorer(fit(docs, labels))
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.where(score(F.col(f"_{text}")) >= cut).toDF(*names)
