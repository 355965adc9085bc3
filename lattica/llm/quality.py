"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each text gives a few statistics (lengths, shares of kinds of characters, repetition), transformed so that ordinary texts are
near normal. Each class has a mean and a covariance, shrunk towards the pooled one and towards its diagonal; a text's score is
the posterior from the difference of the two log densities, whose Mahalanobis terms use Cholesky factors that are computed
once and sent to all executors.

The statistics of all documents are computed in one pass and kept as a narrow table (a row is about 100 bytes); the moments
of the classes come from all labelled rows outside the held-out fold: sums of each task, which Spark adds up before two classes'
worth of them reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import bytewords
from lattica.llm.labelled import held_out, training
from lattica.session import cut

NAMES = ("chars", "words", "word_len", "word_spread", "upper", "digits", "marks", "odd", "pipes", "high", "types", "repeats", "lines", "line_repeats", "twice", "thrice")
_KIND = {
    "upper": lambda c: c.isascii() and c.isupper(),
    "digits": lambda c: c.isascii() and c.isdigit(),
    "marks": lambda c: c in ".,;:?'\"()-",
    "odd": lambda c: c in "!#$%&*+<=>@[]^_`{}~\\/",
    "pipes": lambda c: c == "|",
}
_TABLES = {k: np.array([f(chr(b)) if b < 128 else False for b in range(256)]) for k, f in _KIND.items()}
_LINES = np.zeros(256, bool)
_LINES[[0x0A, 0x0D]] = True


def statistics(column: pa.Array) -> np.ndarray:
    """A row of NAMES for each text."""
    data, at = bytewords.utf8(column)
    n = len(at) - 1
    size = np.diff(at).astype(float)

    def per(x, ends):  # sums of x between ends
        total = np.concatenate([[0], np.cumsum(x)])
        return total[ends[1:]] - total[ends[:-1]]

    def ratio(a, b):
        return a / np.maximum(b, 1)

    shares = {k: ratio(per(t[data], at), size) for k, t in _TABLES.items()}
    chars = size - per((data & 0xC0) == 0x80, at)
    starts, ends = bytewords.spans(data, at)
    h, word_at = bytewords.span_hashes(data, starts, ends), np.searchsorted(starts, at)
    count, length = np.diff(word_at).astype(float), (ends - starts).astype(float)
    mean = ratio(per(length, word_at), count)
    spread = np.sqrt(np.maximum(ratio(per(length**2, word_at), count) - mean**2, 0))
    types = np.diff(bytewords.distinct(h, word_at)[1])
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[word_at[:-1][np.diff(word_at) > 0]] = False
    ls, le = bytewords.spans(data, at, _LINES)
    lh, line_at = bytewords.span_hashes(data, ls, le), np.searchsorted(ls, at)
    lines = np.diff(line_at).astype(float)
    own = np.diff(bytewords.distinct(lh, line_at)[1])
    s2, a2 = bytewords.shingles(h, word_at, 2)
    s3, a3 = bytewords.shingles(h, word_at, 3)
    pairs, triples = (1 - ratio(np.diff(bytewords.distinct(s, a)[1]), np.diff(a)) for s, a in ((s2, a2), (s3, a3)))
    root = np.sqrt
    out = np.column_stack([
        np.log1p(chars), np.log1p(count), np.log1p(mean), np.log1p(spread),
        root(shares["upper"]), root(shares["digits"]), root(shares["marks"]), root(shares["odd"]), root(shares["pipes"]),
        ratio(per(data >= 128, at), size),
        ratio(types, count) + 0.13 * np.log1p(count),  # distinct words thin out with length
        root(ratio(per(same, word_at), count)), np.log1p(lines) - 0.5 * np.log1p(count), root(1 - ratio(own, lines)) * (lines > 0),
        root(np.where(count > 1, pairs, 0)), root(np.where(count > 2, triples, 0)),
    ])
    return out.reshape(n, len(NAMES))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in bytewords.pieces(whole, "text"):
            x = statistics(batch.column("text")).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, sums) of a partition: its rows, the sums of the statistics and those of their products, in one list."""
    d = len(NAMES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x, y = _matrix(batch.column("x")), batch.column("y").to_numpy()
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sums.tolist())], ["y", "sums"])


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the classes; the log odds of label 1 before any evidence."""

    means: np.ndarray
    factors: np.ndarray
    dets: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        far = [((x - m) @ f.T) ** 2 for m, f in zip(self.means, self.factors, strict=True)]
        z = self.prior + 0.5 * (far[0].sum(1) - far[1].sum(1)) + 0.5 * (self.dets[0] - self.dets[1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = 0.05, diagonal: float = 0.05) -> Discriminant:
    """From the classes' counts, sums and products. Without rows of both classes the score is the share of label 1, or 0.5."""
    d = sums.shape[1]
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if min(n) < 2:
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), prior)
    means = sums / n[:, None]
    covs = [products[c] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    both = (n[0] * covs[0] + n[1] * covs[1]) / n.sum()
    covs = [(1 - pooled) * c + pooled * both for c in covs]
    covs = [(1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-6 * np.eye(d) for c in covs]
    lower = [np.linalg.cholesky(c) for c in covs]
    dets = np.array([2 * np.log(np.diag(c)).sum() for c in lower])
    return Discriminant(means, np.stack([np.linalg.inv(c) for c in lower]), dets, prior)


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, held_out, score, predicted), a row for each row.

    Null and empty texts have statistics of 0 and are scored by them. Without labels of both classes every score is the same.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = cut(docs.mapInArrow(_measure, "doc_id long, x array<float>"))
    known = measured.join(training(labels, label), "doc_id").select("x", "y")
    d = len(NAMES)
    sums = np.zeros((2, 1 + d + d * d))
    added = known.mapInArrow(_moments, "y int, sums array<double>").select("y", F.posexplode("sums").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"))
    for row in added.collect():  # 2 * (1 + 16 + 256) rows
        sums[row.y, row.i] = row.v
    n, s, p = sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d)
    sent = docs.sparkSession.sparkContext.broadcast(discriminant(n, s, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sent.value.scores(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = measured.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
