"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled covariance and then towards a multiple of the
identity; a document's score is the logistic of the difference of the two log densities (Mahalanobis distances by
cached Cholesky factors) plus the log prior. Fitting needs only counts, sums and products, which are summed over all
labelled rows in the cluster; the driver gets one small matrix for each class.

Defined cases: a null text counts as empty and is scored like any other; rows without a label, or with a null one,
teach nothing; without labels of both classes every score is the share of label 1, or 0.5 without any; repeated rows
and null doc_ids give a row each; long texts are read whole; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_remainder, read_table, released, stored, whole_text

#: Shares of the pooled covariance and, then, of the identity.
TO_POOLED, TO_IDENTITY = 0.2, 0.02

_KIND = np.zeros(256, np.int64)  # 0 other bytes of letters beyond ASCII
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:'\"()-", "!?", "|", "#$%&*+/<=>@[\\]^_`{}~"), 1):
    _KIND[list(_chars.encode())] = _k
_KINDS = 10


def statistics(text: str) -> list[float]:
    data = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(data))
    kinds = np.bincount(_KIND[data], minlength=_KINDS) / n
    words = text.split()
    n_words = max(1, len(words))
    times = Counter(words)
    top = max(times.values(), default=0)
    lengths = np.fromiter(map(len, times), float, len(times)) if times else np.zeros(1)
    weights = np.fromiter(times.values(), float, len(times)) if times else np.ones(1)
    mean = float((lengths * weights).sum() / weights.sum())
    spread = math.sqrt(float((weights * (lengths - mean) ** 2).sum() / weights.sum()))
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    stops = text.count(".")
    return [
        math.log1p(len(text)),
        *np.sqrt(kinds).tolist(),
        math.log1p(mean),
        math.log1p(spread),
        math.log1p(float(lengths.max())),
        len(times) / n_words,
        pairs,
        math.sqrt(top / n_words),
        math.log1p(n_words / (stops + 1)),
        math.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
    ]


WIDTH = len(statistics(""))


class Model:
    """log density difference of label 1 and label 0."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY):
        n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        self.prior = (n[1] + 0.0) / (n[0] + n[1]) if n[0] + n[1] else 0.5
        self.fitted = n[0] > 0 and n[1] > 0
        if not self.fitted:
            return
        mean = {k: s / m for k, (m, s, _) in moments.items()}
        scatter = {k: p - m * np.outer(mean[k], mean[k]) for k, (m, _, p) in moments.items()}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        norm = np.outer(self.scale, self.scale)
        self.parts = []
        for k in (0, 1):
            own = ((1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled) / norm
            own = (1 - to_identity) * own + to_identity * max(np.trace(own) / len(own), 1e-6) * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.parts.append((mean[k] / self.scale, np.linalg.inv(factor), np.log(np.diag(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        z = x / self.scale
        density = [-0.5 * (((z - m) @ inverse.T) ** 2).sum(1) - log_det for m, inverse, log_det in self.parts]
        logit = density[1] - density[0] + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(logit / len(self.scale), -30, 30)))  # of each dimension, so that scores do not all round to 0 or 1


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(released(run), "doc_id long, x array<double>")


def fit(points: DataFrame, labels: DataFrame) -> Model:
    """From every labelled row of points (doc_id, x); labels: doc_id, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, WIDTH)
            y = batch.column(1).to_numpy()
            for label in np.unique(y):
                own = x[y == label]
                values = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                yield pa.record_batch([pa.array(np.full(len(values), label, np.int32)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["label", "place", "value"])

    known = points.join(labels.where("label IN (0, 1)"), "doc_id").select("x", F.col("label").cast("int").alias("label"))
    summed = known.mapInArrow(run, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    moments = {}
    for label in {r.label for r in summed}:
        values = np.zeros(1 + WIDTH + WIDTH * WIDTH)
        for r in summed:
            if r.label == label:
                values[r.place] = r.value
        moments[label] = (values[0], values[1 : 1 + WIDTH], values[1 + WIDTH :].reshape(WIDTH, WIDTH))
    return Model(moments)


def trained(points: DataFrame, labels: DataFrame) -> Model:
    """Rows whose crc32(doc_id as text) mod 3 is 1 are held out."""
    return fit(points.where(crc_remainder(3) != 1), labels.select("doc_id", F.col("quality").alias("label")))


def scored(points: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.array(batch.column(1).to_pylist()).reshape(-1, WIDTH))
            yield pa.record_batch([batch.column(0), pa.array(score)], ["doc_id", "score"])

    rows = points.mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (crc_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score 0.5 or more, with all their columns."""
    model = trained(stored(with_statistics(docs), "statistics"), labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, WIDTH)))

    return docs.where(score(whole_text()) >= 0.5)


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = stored(with_statistics(read_table(spark, sf_dir, "documents")), "statistics")
    return scored(points, trained(points, read_table(spark, sf_dir, "labels")))
