"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features (words, word beginnings, shape) is shared by all grades; ordered thresholds cut
its score: P(grade > k) = sigmoid(score - threshold_k). Training minimises the likelihood with an L1 penalty over a bounded,
grade-balanced sample of labelled rows; thresholds stay ordered because their gaps are exponentials. Two grades are the
special case of one threshold. Thresholds are then moved to the grades' frequencies among the labelled documents outside the
held-out fold (one label a document: the largest of repeated ones). Every grade that occurs there is learned.

Edge cases: null texts count as empty; with fewer than two grades in the labels every row gets that grade (or null without
labels) and is kept; repeated rows and labels do no harm; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm import features as X
from loomwell.llm.scratch import filter_documents, small_batches


@dataclass
class Ordinal:
    grades: np.ndarray
    weights: np.ndarray  # over the DIM hashed dimensions, float32: 1 MB
    cuts: np.ndarray  # len(grades) - 1 ordered thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -60, 60)))


def fit(data: dict[str, np.ndarray], l1: float = 1e-3, least: int = 5, steps: int = 150) -> Ordinal:
    grades, level = np.unique(data["y"], return_inverse=True)
    if len(grades) < 2:
        return Ordinal(grades, np.zeros(X.DIM, np.float32), np.zeros(0))
    dims = X.common_dims(data, least)
    rows = X.project(data, dims)
    ptr, dim, n, d, k = rows["x_ptr"], rows["x_dim"], len(level), len(dims), len(grades) - 1
    above = (level[:, None] > np.arange(k)[None, :]).astype(float)

    def cuts_of(p: np.ndarray) -> np.ndarray:
        return p[0] + np.concatenate(([0.0], np.cumsum(np.exp(p[1:]))))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        cuts = cuts_of(p[d:])
        score = X.row_sums(p[:d], ptr, dim)
        s = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -60, 60)))
        # likelihood of a grade: difference of neighbouring tails
        tails = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), 1)
        prob = np.maximum(tails[np.arange(n), level] - tails[np.arange(n), level + 1], 1e-12)
        ds = np.zeros((n, k + 2))
        ds[np.arange(n), level] -= 1 / prob
        ds[np.arange(n), level + 1] += 1 / prob
        dz = ds[:, 1:-1] * s * (1 - s) / n
        g_cuts = -dz.sum(0)
        tail_sums = np.cumsum(g_cuts[::-1])[::-1]
        g_p = np.concatenate(([tail_sums[0]], tail_sums[1:] * np.exp(p[d + 1 :])))
        return float(-np.log(prob).mean()), np.concatenate((X.column_sums(dz.sum(1), ptr, dim, d), g_p))

    start = np.zeros(d + k)
    start[d] = -np.log(above[:, 0].mean() / max(1e-9, 1 - above[:, 0].mean()))
    p = X.minimise(loss, start, np.concatenate((np.full(d, l1), np.zeros(k))), steps)
    weights = np.zeros(X.DIM, np.float32)
    weights[dims] = p[:d]
    return Ordinal(grades, weights, cuts_of(p[d:]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 8000, folds: int = 5, fold: int = 0) -> Ordinal:
    data = X.training_rows(docs, labels, label, sample, True, folds, fold)
    model = fit(data)
    if len(model.grades) > 1:
        # the sample is balanced; shift each threshold by the log odds between the true and the balanced tail
        n = data["sizes"][np.isin(data["grades"], model.grades)]
        each = np.bincount(np.searchsorted(model.grades, data["y"])).astype(float)
        true, seen = (np.cumsum(x[::-1])[::-1][1:] / x.sum() for x in (n, each))
        odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
        model.cuts = np.maximum.accumulate(model.cuts - (odds(true) - odds(seen)))
    return model


def rate_texts(m: Ordinal, texts: pa.Array, at_least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and tail probability of each text."""
    expected, tail = np.full(len(texts), np.nan), np.ones(len(texts))
    for i, n, doc, dim in X.batch_features(texts, True):
        s = np.bincount(doc, weights=m.weights[dim], minlength=n)
        if len(m.grades) > 1:
            t = m.tails(s)
            expected[i : i + n] = m.grades[0] + t @ np.diff(m.grades)
            k = len(m.grades) - 1 if at_least is None else int(np.searchsorted(m.grades, at_least))
            tail[i : i + n] = t[:, k - 1] if 0 < k <= len(m.cuts) else float(k == 0)
        elif len(m.grades):
            expected[i : i + n] = m.grades[0]
    return expected, tail


def score(docs: DataFrame, model: Ordinal, at_least: int | None = None) -> DataFrame:
    """Each row of docs(doc_id, text) with expected_grade, and tail_prob = P(grade >= at_least; the top grade by default)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, tail = rate_texts(shared.value, batch.column(1), at_least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, from_pandas=True), pa.array(tail)], ["doc_id", "expected_grade", "tail_prob"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, expected_grade double, tail_prob double")


def keep_documents(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5, folds: int = 5, fold: int = 0) -> DataFrame:
    """The rows of docs, with all columns, whose tail probability is at least ``keep_from``."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds=folds, fold=fold))
    return filter_documents(docs, lambda texts: rate_texts(shared.value, texts)[1] >= keep_from)


def rate_documents(docs: DataFrame, labels: DataFrame, keep_from: float = 0.5, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_prob, keep (tail_prob >= keep_from) of every row; the fold is not learned from."""
    out = score(docs, train(docs, labels, folds=folds, fold=fold))
    return out.select("doc_id", X.held_out(folds, fold).alias("held_out"), "expected_grade", "tail_prob", (F.col("tail_prob") >= keep_from).alias("keep"))
