"""Text quality by regularised quadratic discriminant analysis over transformed statistics of each document.

Each class has a Gaussian whose covariance is shrunk towards the pooled one and that towards its diagonal. Scores are the
difference of the classes' log densities, from Mahalanobis distances through the cached Cholesky factors, put on the scale
of probabilities by two numbers fitted on the training rows. What is fitted comes from sums over all training rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import MIX_A, column, drop_stored, mix, only, segments, stored, text_bytes, word_hashes, words

CLASSES = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "high": range(0x80, 0x100), "stop": b".,;:", "shout": b"!?",
    "bar": b"|<>\\/_=~^", "sign": b"#$%&*@+", "line": b"\n", "quote": b"'\"()[]{}-`",
}
FEATURES = ("words", "word_length", "word_spread", "short_words", "long_words", "distinct_words", "closed_words", "line_words", *CLASSES)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text: logarithms of counts and smoothed log shares, finite for any text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, len(FEATURES)))
    share = lambda part, whole: np.log((part + 0.25) / (whole + 1.0))
    for j, (name, letters) in enumerate(CLASSES.items()):
        table = np.zeros(256, np.int32)
        table[list(letters)] = 1
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=sums[1:])
        out[:, len(FEATURES) - len(CLASSES) + j] = share((sums[offsets[1:]] - sums[offsets[:-1]]).astype(float), size)
        if name == "line":
            lines = (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float) + 1
    starts, ends, first = words(data, offsets)
    length = (ends - starts).astype(float)
    count = np.diff(first).astype(float)
    upto = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    of = lambda x: (s := upto(x))[first[1:]] - s[first[:-1]]
    mean = of(length) / np.maximum(count, 1)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.log1p(mean)
    out[:, 2] = np.log1p(np.sqrt(np.maximum(of(length**2) / np.maximum(count, 1) - mean**2, 0)))
    out[:, 3] = share(of((length <= 3).astype(float)), count)
    out[:, 4] = share(of((length >= 16).astype(float)), count)
    row = np.repeat(np.arange(n), np.diff(first))
    seen = np.unique(word_hashes(data, starts, ends) ^ mix(row.astype(np.uint64) * MIX_A), return_index=True)[1]
    out[:, 5] = share(np.bincount(row[seen], minlength=n).astype(float), count)
    closed = ~((data[ends - 1] | 0x20 >= 0x61) & (data[ends - 1] | 0x20 <= 0x7A) | (data[ends - 1] >= 0x80)) if len(ends) else np.zeros(0, bool)
    out[:, 6] = share(of(closed.astype(float)), count)
    out[:, 7] = np.log1p(count / lines)
    return out


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, x: the transformed statistics of each whole text (a null is empty), nothing else of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, text, 2 << 20):
            x = statistics(*text_bytes(column(batch, text)))
            yield pa.RecordBatch.from_arrays([column(batch, doc_id), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=[doc_id, "x"])

    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return only(docs, doc_id, text).mapInArrow(run, schema)


def matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Discriminant:
    """Two shrunk Gaussians, the prior log odds of label 1, and the scale and shift of the logistic link."""

    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    prior: float
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """log density of label 1 less that of label 0, and the prior, tempered so that its order is kept."""
        if self.means is None or self.factors is None:
            return np.full(len(x), self.prior)
        dens = []
        for mean, inverse in zip(self.means, self.factors, strict=True):
            z = (x - mean) @ inverse.T
            dens.append(-0.5 * (z * z).sum(1) + np.log(np.diag(inverse)).sum())
        d = dens[1] - dens[0] + self.prior
        return np.sign(d) * np.log1p(np.abs(d))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -40, 40)))


def class_sums(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """n, sum of x and sum of x x' of each label over all rows (label, x); two rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = len(FEATURES)
        total = {y: np.zeros(1 + p + p * p) for y in (0, 1)}
        for batch in batches:
            x, y = matrix(column(batch, "x")), column(batch, "label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                part = x[y == k]
                total[k] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        flat = [(y, i, v) for y, t in total.items() for i, v in enumerate(t.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["label", "i", "v"])

    out, p = {}, len(FEATURES)
    sums = rows.select("label", "x").mapInArrow(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    for y in (0, 1):
        v = np.array([r.v for r in sorted((r for r in sums if r.label == y), key=lambda r: r.i)]) if sums else np.zeros(1 + p + p * p)
        out[y] = (int(v[0]), v[1 : 1 + p], v[1 + p :].reshape(p, p)) if len(v) else (0, np.zeros(p), np.zeros((p, p)))
    return out


def fit(rows: DataFrame, shrink: float = 0.1, ridge: float = 1e-3) -> Discriminant:
    """Fit on all rows (label 0 or 1, x). A class with under two rows leaves the other's share as the score of all texts."""
    sums = class_sums(rows)
    n0, n1 = sums[0][0], sums[1][0]
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if min(n0, n1) < 2:
        return Discriminant(None, None, prior)
    means, covs = [], []
    for y in (0, 1):
        n, s, ss = sums[y]
        means.append(s / n)
        covs.append(ss / n - np.outer(s / n, s / n))
    pooled = (n0 * covs[0] + n1 * covs[1]) / (n0 + n1)
    factors = []
    for n, cov in ((n0, covs[0]), (n1, covs[1])):
        a = min(1.0, shrink + len(FEATURES) / (n + len(FEATURES)))  # the fewer rows, the nearer to the pooled covariance
        c = (1 - a) * cov + a * pooled
        c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + ridge * np.eye(len(c))
        factors.append(np.linalg.inv(np.linalg.cholesky(c)))
    raw = Discriminant((means[0], means[1]), (factors[0], factors[1]), prior)
    return calibrated(raw, rows)


def calibrated(model: Discriminant, rows: DataFrame, bins: int = 400) -> Discriminant:
    """Scale and shift by logistic regression of the label on the margin, from counts in `bins` intervals of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, bins), np.int64)
        for batch in batches:
            m = np.clip(((model.margin(matrix(column(batch, "x"))) + 10) / 20 * bins).astype(int), 0, bins - 1)
            np.add.at(count, (column(batch, "label").to_numpy(zero_copy_only=False).astype(int), m), 1)
        y, b = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(b, pa.int32()), pa.array(count[y, b])], names=["label", "bin", "n"])

    got = rows.select("label", "x").mapInArrow(run, "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).orderBy("label", "bin").collect()
    m = np.array([(r["bin"] + 0.5) / bins * 20 - 10 for r in got])
    y, n = np.array([r.label for r in got]), np.array([float(r.n) for r in got])
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps with a small penalty
        q = 1 / (1 + np.exp(-np.clip(w[0] * m + w[1], -30, 30)))
        g = np.array([(n * (q - y) * m).sum() + 0.1 * (w[0] - 1), (n * (q - y)).sum() + 0.1 * w[1]])
        v = n * q * (1 - q)
        w = w - np.linalg.solve(np.array([[(v * m * m).sum() + 0.1, (v * m).sum()], [(v * m).sum(), v.sum() + 0.1]]), g)
    return Discriminant(model.means, model.factors, model.prior, max(float(w[0]), 0.05), float(w[1]))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text is divisible by 5; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, target: str = "quality", cut: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs: the probability of label 1, and 1 where it is at least `cut`.

    Learns from the labelled rows of docs that aren't held out, all of them; labels (doc_id, target) with null targets are
    left out, of several for one id the least holds. Empty and null texts have the statistics of an empty text. Repeated
    rows give a row each and count as often in training. Nothing but the text enters a score.
    """
    x = stored(document_statistics(docs, doc_id, text), "statistics")
    return scored(x, fitted(x, labels, target, doc_id), cut, doc_id)


def fitted(x: DataFrame, labels: DataFrame, target: str = "quality", doc_id: str = "doc_id") -> Discriminant:
    """The model of the labelled rows of document_statistics() that aren't held out."""
    y = labels.where(F.col(target).isNotNull()).groupBy(F.col(doc_id).alias("_label_id")).agg(F.min(target).cast("int").alias("label"))
    train = x.where(~held_out(F.col(doc_id))).join(y, F.col(doc_id) == F.col("_label_id")).select("label", "x")
    train = stored(train.where("label in (0, 1)"), "training")
    model = fit(train)
    drop_stored(train)
    return model


def scored(x: DataFrame, model: Discriminant, cut: float, doc_id: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(matrix(column(batch, "x")))
            yield pa.RecordBatch.from_arrays([column(batch, doc_id), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[doc_id, "score", "predicted"])

    schema = T.StructType([T.StructField(doc_id, x.schema[doc_id].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return x.mapInArrow(run, schema).select(doc_id, held_out(F.col(f"`{doc_id}`")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, whose text scores at least `cut` under the model that quality_scores() fits.

    Null and empty texts have the statistics of an empty one; repeated rows stay or go together; without labels of both kinds
    all stay or all go. Texts are taken whole, some MB of them at a time."""
    model = fitted(document_statistics(docs, doc_id, text), labels, "quality", doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, text, 2 << 20):
            yield batch.filter(pa.array(model.score(statistics(*text_bytes(column(batch, text)))) >= cut))

    return docs.mapInArrow(run, docs.schema)


def described(model: Discriminant) -> str:
    """The model as JSON, for a report."""
    return json.dumps({"features": FEATURES, "prior": model.prior, "scale": model.scale, "shift": model.shift})


