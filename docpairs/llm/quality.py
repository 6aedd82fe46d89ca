"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each whole text gives ``FEATURES`` transformed statistics. For each class the count, the
sum and the sum of outer products are added up over all labelled rows by Spark (one
short row per task reaches the next step), which gives the mean and the covariance. The
covariance is shrunk towards the pooled covariance and its diagonal, and its Cholesky
factor is computed once on the driver and sent to the tasks with the model (a few KB
whatever the data). A document's score is the posterior of label 1 from the difference
of the two Mahalanobis log-densities plus the log prior.

Cases: null and empty texts have the statistics of an empty text and get a score; a label
row without a document, or with a null label, is ignored; with one class only the score
is that class's prior with one pseudo-count per class; with no labels it is 0.5; an empty
table gives no rows; repeated rows are scored (and counted) each; extra columns are kept
by ``keep_good`` and are never inputs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_by, read, text_or_empty, written

FEATURES = ("log_words", "mean_word", "log_lines", "upper", "digit", "mark", "odd_mark", "non_ascii",
            "distinct_words", "distinct_lines", "short_words", "long_words", "top_word", "marked_words")
THRESHOLD = 0.3
#: Shrinkage towards the pooled covariance, then towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.5, 0.1


def _logit(p: float) -> float:
    p = min(max(p, 0.002), 0.998)
    return math.log(p / (1 - p))


_SPACES = bytes([9, 10, 11, 12, 13, 32])
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 usual mark, 4 other mark, 5 part of a non-ASCII letter
_CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 5
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 3


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``FEATURES``."""
    data = text.encode("utf-8")
    words = data.split()
    n, size = len(words), max(len(data), 1)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6) if data else np.zeros(6)
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    top = 0
    if n:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        top = max(counts.values())
    marked = sum(w[-1] in b"!#$%&*@~|^<>+=" for w in words)
    d = max(n, 1)
    return [math.log1p(n), math.log1p(float(lengths.mean())), math.log1p(len(lines)),
            _logit(kinds[1] / size), _logit(kinds[2] / size), _logit(kinds[3] / size), _logit(kinds[4] / size),
            _logit(kinds[5] / size), _logit(distinct / d) if n else 0.0,
            _logit(len(set(lines)) / len(lines)) if lines else 0.0,
            _logit(float((lengths <= 3).mean())), _logit(float((lengths >= 12).mean())), _logit(top / d),
            _logit(marked / d)]


#: Rows whose statistics a worker holds at once.
ROWS = 512


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, x``: the statistics of every whole text."""
    def run(batches):
        held_by("quality")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                xs = pa.array([statistics(t.as_py()) for t in part.column(1)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), xs], ["doc_id", "x"])
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, x array<double>")


def held_out(col="doc_id"):
    """Rows kept out of learning: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sums(batches):
    """Per task: for each class the count, sum and outer products, as one row."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        labels = batch.column("label").to_numpy()
        column = batch.column("x")
        if not batch.num_rows:
            continue
        x = np.hstack([np.ones((len(labels), 1)), column.flatten().to_numpy().reshape(len(labels), -1)])
        for label in (0, 1):
            part = x[labels == label]
            total[label] = total.get(label, 0) + part.T @ part
    rows = [(k, v.ravel().tolist()) for k, v in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()),
                                      pa.array([v for _, v in rows], pa.list_(pa.float64()))], ["label", "sums"])


class Model:
    """Per class: log prior, mean, inverse Cholesky factor and log determinant."""

    def __init__(self, moments: dict[int, np.ndarray], to_pooled: float = TO_POOLED,
                 to_diagonal: float = TO_DIAGONAL):
        self.n = {c: float(moments[c][0, 0]) if c in moments else 0.0 for c in (0, 1)}
        seen = [c for c in (0, 1) if self.n[c] > 0]
        self.parts = None
        if len(seen) < 2:
            return
        scatter, mean = {}, {}
        for c in seen:
            m = moments[c]
            mean[c] = m[0, 1:] / m[0, 0]
            scatter[c] = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
        pooled = (scatter[0] + scatter[1]) / max(self.n[0] + self.n[1] - 2, 1)
        scale = np.diag(np.maximum(np.diag(pooled), 1e-4))
        self.parts = {}
        for c in seen:
            own = scatter[c] / max(self.n[c] - 1, 1)
            a = max(to_pooled, len(pooled) / (self.n[c] + len(pooled)))
            cov = (1 - a) * own + a * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * scale
            factor = np.linalg.cholesky(cov)
            self.parts[c] = (mean[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for each row of ``x``."""
        prior = math.log((self.n[1] + 1) / (self.n[0] + 1))
        z = np.full(len(x), prior)
        if self.parts:
            density = {}
            for c, (mean, inverse, logdet) in self.parts.items():
                distance = (((x - mean) @ inverse.T) ** 2).sum(axis=1)
                density[c] = -0.5 * (distance + logdet)
            z = z + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(labelled: DataFrame) -> Model:
    """``labelled``: ``x, label`` (0 or 1). Two small matrices reach the driver."""
    parts = labelled.select("label", "x").mapInArrow(_sums, "label int, sums array<double>")
    summed = (parts.select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i")
              .agg(F.sum("v").alias("v")).collect())
    size = len(FEATURES) + 1
    moments: dict[int, np.ndarray] = {}
    for r in summed:
        moments.setdefault(r.label, np.zeros(size * size))[r.i] = r.v
    return Model({c: m.reshape(size, size) for c, m in moments.items()})


def training_rows(feature_table: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """Statistics with a usable label whose row is not held out."""
    usable = (labels.select(F.col("doc_id").alias("label_id"), F.col(column).cast("int").alias("label"))
              .where("label IN (0, 1)").where(~held_out("label_id")))
    return feature_table.join(usable, F.col("doc_id") == F.col("label_id")).select("x", "label")


def _scorer(model: Model):
    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        if not len(xs):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.stack(xs.to_numpy())))
    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; learns from ``labels``.
    The statistics are written once and serve learning and scoring."""
    table = written(features(docs), "quality-features")
    score = _scorer(fit(training_rows(table, labels)))
    return (table.select("doc_id", held_out("doc_id").alias("held_out"), score("x").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, columns unchanged. Texts are
    read twice and never shuffled."""
    model = fit(training_rows(written(features(docs), "quality-features"), labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        held_by("quality")
        return pd.Series(model.score(np.array([statistics(t) for t in texts])) if len(texts) else [], dtype="float64")

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    scored = row.withColumn("quality_score", score(text_or_empty(F.col("doc.text"))))
    return scored.where(F.col("quality_score") >= threshold).select("doc.*")


def op6_quality_classifier(spark, sf_dir):
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
