"""Document quality by a regularised quadratic discriminant over statistics of the text.

Each text becomes a dozen statistics, transformed so that shares and counts are nearly normal,
and standardised. Per class a mean and a covariance are summed on the executors in one pass over
the labelled rows; a class covariance is shrunk towards the pooled one and then towards a
multiple of the identity. A document's score is the logistic of the difference of the two
log-densities plus the log prior odds; densities come from Mahalanobis distances by the
inverse Cholesky factors, which are worked out once and travel with the model (a few kB).

Defined cases: a null or empty text has zero statistics and gets a score like any other; a null
doc_id counts as the empty text in the fold; label rows that repeat a doc_id each count as
evidence; without labels of both classes the score is the smoothed share of label 1; an
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import remainder, texts
from quillspark.operators.joins import fits
from quillspark.session import materialize

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>!@^~=+{}[]\\")] = True
DIGITS = np.array([48 <= b <= 57 for b in range(256)])
MARKS = np.array([b in b".,;:?!" for b in range(256)])
BLOCK = 64

NAMES = (
    "log_words", "log_word_length", "word_spread", "symbols", "upper", "digits", "marks", "distinct", "runs",
    "repeated_pairs", "repeated_lines", "log_line_words", "sentence_ends", "short_words", "worst_block",
)


def _shares(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of ``NAMES``."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    data = np.frombuffer(raw, dtype=np.uint8)
    size = max(len(data), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    small = text.lower()
    upper = (sum(map(str.__ne__, text, small)) if len(small) == len(text) else sum(c.isupper() for c in text)) / size
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=n)
    same = np.append(ids[1:] == ids[:-1], False)
    pairs = ids[1:] * n + ids[:-1]
    lines = [line for line in raw.split(b"\n") if line.strip()]
    symbolic = SYMBOLS[data]
    # Words with symbols, by the running count of symbol bytes at word ends: found in one pass over the bytes.
    odd = np.fromiter((bool(w.translate(None, _PLAIN)) for w in words), dtype=bool, count=n)
    bad = (odd | same).astype(np.float64)
    blocks = np.add.reduceat(bad, np.arange(0, n, BLOCK)) / BLOCK
    root = math.sqrt
    return [
        math.log1p(n), math.log(float(lengths.mean())), math.log1p(float(lengths.std())),
        root(float(symbolic.mean())), root(upper), root(float(DIGITS[data].mean())), root(float(MARKS[data].mean())),
        len(codes) / n, root(float(same.mean())), root(1.0 - len(np.unique(pairs)) / max(n - 1, 1)) if n > 1 else 0.0,
        root(1.0 - len(set(lines)) / len(lines)), math.log1p(n / len(lines)),
        root(sum(w.endswith((b".", b"!", b"?")) for w in words) / n), root(float((lengths <= 3).mean())),
        root(float(min(blocks.max(), 1.0))),
    ]


_PLAIN = bytes(b for b in range(256) if not SYMBOLS[b] or b == ord("!"))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, features`` in row order."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_shares(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, type=pa.list_(pa.float64()))], names=["doc_id", "features"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(measured, "doc_id long, features array<double>")


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants of two classes, on standardised statistics."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float
    fitted: bool

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(rows), 1.0 / (1.0 + math.exp(-self.log_odds)))
        z = np.clip((rows - self.center) / self.scale, -12.0, 12.0)
        density = [
            -0.5 * (((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) - 0.5 * self.log_dets[k] for k in (0, 1)]
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -700.0, 700.0)))


def fitted(sums: dict[int, np.ndarray], size: int, pooling: float, ridge: float) -> Model:
    """A model from each class's [count, sums, sums of products]."""
    count = {k: float(v[0]) for k, v in sums.items() if v[0] > 0}
    n1, n0 = count.get(1, 0.0), count.get(0, 0.0)
    odds = math.log((n1 + 1.0) / (n0 + 1.0))
    if len(count) < 2 or min(count.values()) < 2:
        zero = np.zeros(size)
        return Model(zero, zero + 1, np.zeros((2, size)), np.zeros((2, size, size)), np.zeros(2), odds, False)
    total = n0 + n1
    center = (sums[0][1 : size + 1] + sums[1][1 : size + 1]) / total
    second = {k: sums[k][size + 1 :].reshape(size, size) for k in (0, 1)}
    spread = np.diag((second[0] + second[1]) / total - np.outer(center, center))
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means, covariances = [], []
    for k in (0, 1):
        mean = sums[k][1 : size + 1] / count[k]
        means.append((mean - center) / scale)
        covariances.append((second[k] / count[k] - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = (n0 * covariances[0] + n1 * covariances[1]) / total
    factors, log_dets = [], []
    for k in (0, 1):
        shrunk = (1 - pooling) * covariances[k] + pooling * pooled
        shrunk = (1 - ridge) * shrunk + ridge * np.trace(shrunk) / size * np.eye(size) + 1e-6 * np.eye(size)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2.0 * np.log(np.diag(lower)).sum())
    return Model(center, scale, np.array(means), np.array(factors), np.array(log_dets), odds, True)


def fit(measured: DataFrame, labels: DataFrame, label: str = "quality", *, held_out: Column | None = None,
        pooling: float = 0.1, ridge: float = 0.02) -> Model:
    """Fit on every labelled row outside ``held_out`` (a condition on doc_id)."""
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    if held_out is not None:
        marks = marks.where(~held_out)
    size = len(NAMES)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: np.zeros(1 + size + size * size), 1: np.zeros(1 + size + size * size)}
        for batch in batches:
            rows = np.array(batch.column("features").to_pylist(), dtype=np.float64).reshape(-1, size)
            kinds = batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = rows[kinds == k]
                sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], type=pa.int32()), pa.array([sums[0], sums[1]], type=pa.list_(pa.float64()))],
            names=["label", "sums"])

    partial = measured.join(marks, "doc_id").select("features", "label").mapInArrow(
        summed, "label int, sums array<double>")
    # Summed on the executors by place: what comes back has two rows per place, whatever the input.
    places = partial.select("label", F.posexplode("sums").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x"))
    found = {k: np.zeros(1 + size + size * size) for k in (0, 1)}
    for row in places.collect():
        found[row["label"]][row["at"]] = row["x"]
    return fitted(found, size, pooling, ridge)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", *, threshold: float = 0.3,
           **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; rows with crc32(doc_id) mod 5 = 0 teach nothing."""
    measured = materialize(features(docs), "quality-features")
    model = fit(measured, labels, label, held_out=remainder("doc_id") == 0, **settings)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column("features").to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.scores(rows))], names=["doc_id", "score"])

    return measured.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", (remainder("doc_id") == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def passing(docs: DataFrame, labels: DataFrame, label: str = "quality", *, threshold: float = 0.3,
            **settings) -> DataFrame:
    """The documents that the classifier accepts, with all their columns.

    The model is fitted as in ``scored``, on the labelled rows, whose texts alone are measured for it if the ids
    of the labels can be broadcast, else all texts are. All texts are measured where they stand to be filtered, so no text moves.
    """
    marks = labels.select("doc_id").distinct()
    known = docs.join(F.broadcast(marks), "doc_id", "left_semi") if fits(marks) else docs
    measured = materialize(features(known), "quality-features")
    model = fit(measured, labels, label, held_out=remainder("doc_id") == 0, **settings)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([_shares(t) for t in texts(batch)]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.scores(rows) >= threshold))

    return docs.mapInArrow(kept, docs.schema)
