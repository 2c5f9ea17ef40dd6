"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, lean, quoted, slices, with_fields

STATISTICS = (
    "log characters", "log words", "log lines", "mean word length", "deviation of word length", "mean line length",
    "symbols", "digits", "capitals", "white space", "stops", "beyond ASCII", "distinct words", "repeats of the word before",
    "commonest word", "distinct lines", "words that end in a symbol", "words of three bytes or less", "words with symbols or digits within", "compressed size",
)
#: Weight of the pooled diagonal in each class's covariance, and what is added to its diagonal.
SHRINKAGE, RIDGE = 0.1, 0.01

_SYMBOLS = bytes(b"#$%&*+/<=>@[\\]^_`{|}~")
_STOPS = bytes(b".,;:!?'\"()-")
_DIGITS, _CAPITALS, _SPACE = b"0123456789", bytes(range(65, 91)), b" \t\n\r\x0b\f"
_HIGH = bytes(range(128, 256))
_LEAD = bytes(range(128, 192))
_PLAIN = bytes(range(97, 123)) + _CAPITALS + _HIGH + _STOPS


def statistics(text: bytes) -> list[float]:
    """STATISTICS of a UTF-8 text. Shares are log((k + 0.5) / (n + 1)), so that none is infinite;
    an empty text has those of k = n = 0."""
    n = len(text)
    without = lambda chars: n - len(text.translate(None, chars))
    share = lambda k, of: float(np.log((k + 0.5) / (of + 1)))
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = len(words)
    length = np.fromiter(map(len, words), np.float64, m)
    counts = Counter(words)
    ends = sum(w[-1] in _SYMBOLS for w in words)
    odd = sum(bool(w[:-1].translate(None, _PLAIN)) for w in counts) if m else 0
    return [
        float(np.log1p(n - without(_LEAD))), float(np.log1p(m)), float(np.log1p(len(lines))),
        float(np.log1p(length.mean())) if m else 0.0, float(np.log1p(length.std())) if m else 0.0, float(np.log1p(n / len(lines))) if lines else 0.0,
        share(without(_SYMBOLS), n), share(without(_DIGITS), n), share(without(_CAPITALS), n), share(without(_SPACE), n), share(without(_STOPS), n), share(without(_HIGH), n),
        share(len(counts), m), share(sum(map(bytes.__eq__, words, words[1:])), m), share(max(counts.values(), default=0), m),
        share(len(set(lines)), len(lines)), share(ends, m), share(int((length <= 3).sum()), m), share(odd, len(counts)), share(len(zlib.compress(text, 1)) - 8, n),
    ]


@dataclass
class Discriminant:
    """Two Gaussians; of each the mean, the inverse of the covariance's Cholesky factor and the
    log of its determinant, all computed once."""

    prior: float
    classes: list[tuple[np.ndarray, np.ndarray, float]] | None
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) for each row of statistics."""
        if self.classes is None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) - 0.5 * determinant for mean, inverse, determinant in self.classes]
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(count: np.ndarray, total: np.ndarray, product: np.ndarray, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Discriminant:
    """From the rows, sums and sums of outer products of each of the two classes.

    Without two rows in each class there is nothing to tell apart: every score is then the share
    of label 1, one row of each label added.
    """
    prior = float((count[1] + 1) / (count.sum() + 2))
    d = total.shape[1]
    if count.min() < 2:
        return Discriminant(prior, None, np.zeros(d), np.ones(d))
    mean = total / count[:, None]
    own = [product[k] / count[k] - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (count[0] * own[0] + count[1] * own[1]) / count.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    classes = []
    for k in (0, 1):
        s = own[k] / np.outer(scale, scale)
        s = (1 - shrinkage) * s + shrinkage * np.diag(np.diag(pooled) / scale**2) + ridge * np.eye(d)
        factor = np.linalg.cholesky(s)
        classes.append(((mean[k] - mean.mean(0)) / scale, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return Discriminant(prior, classes, mean.mean(0), scale)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): STATISTICS of each row's whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["id", "x"])

    own = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    return own.mapInArrow(lean(run), f"id {own.dtypes[0][1]}, x array<double>")


def train(rows: DataFrame) -> Discriminant:
    """Fitted on (label, x). Each task sums its rows, the sums are added by cell: what reaches the
    driver has one row for each cell of the two classes' moments, however many rows there are."""
    d = len(STATISTICS)
    width = 1 + d + d * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = np.zeros((2, width))
        for batch in batches:
            label, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for k in (0, 1):
                own = x[label == k]
                moments[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * width)), pa.array(moments.ravel())], ["cell", "v"])

    cells = rows.select(F.col("label").cast("int"), "x").mapInArrow(lean(run), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    moments = np.zeros(2 * width)
    for cell, v in cells:
        moments[cell] = v
    moments = moments.reshape(2, width)
    return fit(moments[:, 0], moments[:, 1 : 1 + d], moments[:, 1 + d :].reshape(2, d, d))


def score(statistics_: DataFrame, model: Discriminant) -> DataFrame:
    """(id, score): P(label 1) for each row of (id, x)."""
    held = statistics_.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(_matrix(batch.column(1))))], ["id", "score"])

    return statistics_.select("id", "x").mapInArrow(lean(run), f"id {statistics_.dtypes[0][1]}, score double")


def label_of(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, label): one row for each id; of differing labels the commoner, 1 on a tie. Null ids and
    labels, and labels but 0 and 1, are left out."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    return own.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))


def classify(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score): one row for each row of ``docs``, empty and null texts too.

    Fitted on the labelled rows of ``docs`` for whose ``id`` the column expression ``training``
    holds. The statistics are computed once and kept in the checkpoint folder. Repeated rows are scored
    each; a repeated label counts with the others of its id; an empty table gives an empty result.
    """
    own = checkpointed(document_statistics(docs, id_col, text_col))
    rows = own.where(training).join(label_of(labels, id_col, label_col), "id")
    return score(own, train(rows))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` with all their columns, but those that score under one half; fitted on all
    labelled rows. Only statistics are shuffled: the texts are read twice instead."""
    rows = document_statistics(docs, id_col, text_col).join(label_of(labels, id_col, label_col), "id")
    held = docs.sparkSession.sparkContext.broadcast(train(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(held.value.score(x) >= 0.5))], ["row"])

    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), as_bytes(text_col).alias("text"))
    return whole.mapInArrow(lean(run), with_fields(whole, text=None)).select("row.*")
