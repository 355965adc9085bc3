"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words (A-Z as a-z, punctuation off) and the first 4 to 7 bytes of each longer word, hashed into 2^20
buckets; a document has the features "bucket occurs", "bucket occurs twice or more" and one for the power of two of its length,
so repetition beyond that doesn't matter. The score is ``sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` over the features the
machine knows: linear weights as well as pairwise interactions, so that a term can weigh more, or less, beside another one or in
a long text.

The fit uses a bounded sample of labelled rows (``sample``, those with the smallest hash of their key), one of each group of
near copies of one label, and the features that occur in at least ``LEAST`` of them and help to tell the classes apart, alone or in
pairs. Alone: their rows' share of label 1 is ``SURE`` standard errors from that of all rows; Spark counts these, the ``MOST`` surest are
taken. In pairs: among the ``PAIRED`` most frequent features, those with a partner beside which their rows' share of label 1 is ``SURE_PAIR`` standard errors
from what both give alone and added up; ``MOST_PAIRED`` of them at most. So a term counts that is harmless alone. These bounds are the model's size, whatever the
corpus's. The fit itself runs in numpy on the driver, on a bounded number of rows and features. Scoring reads all texts once, whole.
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

BITS = 20
LEVEL = 1 << BITS
BEGINNINGS = (4, 5, 6, 7)
SAMPLE = 8_000
#: A feature must occur in so many sampled documents, and tell the classes apart by so many standard errors; so many are kept.
LEAST, SURE, MOST = 5, 3.5, 4096
#: So many of the most frequent features are looked at in pairs; a pair must deviate by so many standard errors, of half a million
#: pairs hardly one does by chance; so many features are kept.
PAIRED, SURE_PAIR, MOST_PAIRED = 1024, 6.5, 512
#: Terms are runs of letters and digits; all bytes above 127 belong to letters.
STOPS = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all words and beginnings, their documents, word hashes, words before each document)."""
    data, offsets = bytewords.utf8(column)
    starts, ends = bytewords.spans(data, offsets, STOPS)
    h, at = bytewords.span_hashes(data, starts, ends), np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    found, docs = [h], [doc]
    for n in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > n)
        found.append(bytewords.span_hashes(data, starts[longer], starts[longer] + n) ^ np.uint64(n))
        docs.append(doc[longer])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(docs), h, at


def _lengths(at: np.ndarray) -> np.ndarray:
    """The length feature of each document."""
    return LEVEL * 2 + np.ceil(np.log2(np.diff(at) + 1)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, sketch, terms): features of each text; sketch: two minima over its shingles, equal for most near copies."""
    for whole in batches:
        for batch in bytewords.pieces(whole, "text"):
            b, doc, h, at = _terms(batch.column("text"))
            s, sat = bytewords.shingles(h, at, 3)
            sketch = [[int(bytewords.mix(s[p:q] + c).min().view(np.int64)) for c in bytewords.seeds(2, 53)] if q > p else [0, 0] for p, q in zip(sat[:-1], sat[1:], strict=True)]
            cell, count = np.unique(doc.astype(np.int64) * LEVEL + b, return_counts=True)
            own, bucket = cell // LEVEL, cell % LEVEL
            own, bucket = np.concatenate([own, own[count > 1], np.arange(len(at) - 1)]), np.concatenate([bucket, bucket[count > 1] + LEVEL, _lengths(at)])
            order = np.argsort(own, kind="stable")
            terms = np.split(bucket[order].astype(np.int32), np.searchsorted(own[order], np.arange(1, len(at) - 1)))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(sketch, pa.list_(pa.int64())), pa.array(terms[: len(at) - 1], pa.list_(pa.int32()))], ["y", "sketch", "terms"])


@dataclass
class Machine:
    """Known features (ascending), their weights w and factors V, the bias."""

    known: np.ndarray
    w: np.ndarray
    V: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if not len(self.known):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        bucket, doc, _, at = _terms(column)
        wanted = np.zeros(LEVEL, bool)
        wanted[self.known[self.known < 2 * LEVEL] % LEVEL] = True
        hit = np.flatnonzero(wanted[bucket])
        cell, count = np.unique(doc[hit].astype(np.int64) * LEVEL + bucket[hit], return_counts=True)
        doc, feature = cell // LEVEL, cell % LEVEL
        doc, feature = np.concatenate([doc, doc[count > 1], np.arange(n)]), np.concatenate([feature, feature[count > 1] + LEVEL, _lengths(at)])
        place = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
        on = self.known[place] == feature
        doc, term = doc[on], place[on]
        z = self.bias + np.bincount(doc, self.w[term], n)
        for f in range(self.V.shape[1]):
            v = self.V[term, f]
            z += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pair_features(y: np.ndarray, doc: np.ndarray, term: np.ndarray, candidates: np.ndarray, least: int = LEAST, sure: float = SURE_PAIR, most: int = MOST_PAIRED) -> np.ndarray:
    """Those of the ``candidates`` (ascending) that, beside another of them, change the share of label 1 by more than both alone do."""
    n, share = len(y), y.mean()
    place = np.searchsorted(candidates, term)
    on = (place < len(candidates)) & (candidates[np.minimum(place, len(candidates) - 1)] == term)
    doc, place = doc[on], place[on]
    both, toxic = np.zeros((2, len(candidates), len(candidates)), np.float32)
    for rows in np.array_split(np.concatenate([np.flatnonzero(y == 0), np.flatnonzero(y == 1)]), range(1000, n, 1000)):
        at = np.full(n, -1)
        at[rows] = np.arange(len(rows))
        here = at[doc] >= 0
        x = np.zeros((len(rows), len(candidates)), np.float32)
        x[at[doc[here]], place[here]] = 1
        both += x.T @ x
        x = x[y[rows] == 1]
        toxic += x.T @ x
    own = np.diag(toxic) / np.maximum(np.diag(both), 1) - share
    expected = np.clip(share + own[:, None] + own[None, :], share / 20, 1 - (1 - share) / 20)
    z = np.abs(toxic - both * expected) / np.sqrt(np.maximum(both, 1) * expected * (1 - expected))
    z[both < least] = 0
    np.fill_diagonal(z, 0)
    best = z.max(1, initial=0)
    chosen = np.argsort(-best, kind="stable")[:most]
    return np.sort(candidates[chosen[best[chosen] >= sure]])


def fit(y: np.ndarray, doc: np.ndarray, term: np.ndarray, factors: int = 4, least: int = LEAST, z: float = SURE, most: int = MOST, rounds: int = 300, l2: float = 2e-4, seed: int = 1) -> Machine:
    """From labels and (document, feature) pairs, each once: Adam on the mean log loss with an L2 penalty; deterministic."""
    n, pos = len(y), float(y.sum())
    prior = float(np.log((pos + 0.5) / (n - pos + 0.5))) if n else -3.0
    empty = Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)), prior)
    if not n or pos in (0, n):
        return empty
    size = 2 * LEVEL + 64
    df = np.bincount(term, minlength=size)
    toxic = np.bincount(term[y[doc] == 1], minlength=size)
    share = pos / n
    sure = (toxic - df * share) / np.sqrt(np.maximum(df, 1) * share * (1 - share))
    frequent = np.flatnonzero((df >= least) & (df < n))
    frequent = frequent[frequent < 2 * LEVEL]
    known = frequent[np.abs(sure[frequent]) >= z]
    known = known[np.argsort(-np.abs(sure[known]), kind="stable")[:most]]
    paired = np.sort(frequent[np.argsort(-np.minimum(df, n - df)[frequent], kind="stable")[:PAIRED]])
    known = np.union1d(known, pair_features(y, doc, term, paired)) if len(paired) else known
    if not len(known):
        return empty
    known = np.concatenate([known, np.arange(2 * LEVEL, size)])
    place = np.full(size, -1, np.int32)
    place[known] = np.arange(len(known))
    term = place[term]
    doc, term = doc[term >= 0].astype(np.int64), term[term >= 0].astype(np.int64)
    rng = np.random.default_rng(seed)
    params = [np.zeros(len(known)), rng.normal(0, 0.05, (len(known), factors)), np.array([prior])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        w, V, b = params
        sums = [np.bincount(doc, V[term, f], n) for f in range(factors)]
        out = b[0] + np.bincount(doc, w[term], n)
        for f in range(factors):
            out += 0.5 * (sums[f] ** 2 - np.bincount(doc, V[term, f] ** 2, n))
        e = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / n
        gw = np.bincount(term, e[doc], len(known)) + l2 * w / len(known) ** 0.5
        gV = np.stack([np.bincount(term, e[doc] * (sums[f][doc] - V[term, f]), len(known)) for f in range(factors)], 1) + l2 * V / len(known) ** 0.5
        for p, g, a, c in zip(params, (gw, gV, np.array([e.sum()])), m, v, strict=True):
            a += 0.1 * (g - a)
            c += 0.01 * (g * g - c)
            p -= 0.05 * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.99**t)) + 1e-8)
    return Machine(known, *params[:2], float(params[2][0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine fitted to at most ``sample`` labelled documents outside the held-out fold. Of rows that repeat a doc_id the one
    whose text has the smallest hash is learnt from. Null texts are empty; null doc_ids and labels other than 0 and 1 aren't
    learnt from. Without rows of both labels, every score is the share of label 1."""
    chosen = training(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id"), F.struct(F.xxhash64("text").alias("h"), "text").alias("t")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("t")["text"].alias("text")).select("y", "text")
    rows = cut(rows.mapInArrow(_features, "y int, sketch array<long>, terms array<int>"))
    rows = cut(rows.groupBy("y", "sketch").agg(F.min("terms").alias("terms")))  # one of each group of near copies
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = min(max(pos / max(n, 1), 1e-9), 1 - 1e-9)
    counts = cut(rows.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"), F.sum("y").alias("toxic")).filter((F.col("df") >= LEAST) & (F.col("df") < n) | (F.col("t") >= 2 * LEVEL)))
    sure = F.abs(F.col("toxic") - F.col("df") * share) / F.sqrt(F.col("df") * (share * (1 - share)))
    word = F.col("t") < 2 * LEVEL
    best = [r.t for r in counts.filter(~word | (sure >= SURE)).orderBy(word, sure.desc(), "t").limit(MOST + 64).select("t").collect()]
    often = [r.t for r in counts.filter(word).orderBy(F.least("df", n - F.col("df")).desc(), "t").limit(PAIRED).select("t").collect()]
    known = np.unique(np.array(best + often, np.int32))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [x[np.isin(x, known)] for x in (np.array(t, np.int32) for t in batch.column("terms").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("sketch"), pa.array(terms, pa.list_(pa.int32()))], ["y", "sketch", "terms"])

    got = rows.select("y", "sketch", "terms").mapInArrow(prune, "y int, sketch array<long>, terms array<int>").toArrow().combine_chunks()  # some features of at most ``sample`` rows
    if not got.num_rows:
        return fit(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    y, terms = got["y"].to_numpy().astype(float), got["terms"].chunk(0)
    number = np.diff(terms.offsets.to_numpy())
    flat = terms.flatten().to_numpy()
    sketch = got["sketch"].chunk(0).flatten().to_numpy().reshape(len(y), 2)
    rank = np.empty(len(y), np.int64)
    rank[order := np.lexsort((y, sketch[:, 1], sketch[:, 0]))] = np.arange(len(y))
    cell = np.repeat(rank * (4 * LEVEL), number) + flat  # document and feature in one, so that one sort orders both
    del got, terms, flat
    cell.sort()
    return fit(y[order], (cell // (4 * LEVEL)).astype(np.int32), (cell % (4 * LEVEL)).astype(np.int32))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, held_out, score, predicted). Null and empty texts get the score of no terms."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for batch in bytewords.pieces(whole, "text"):
                p = own.scores(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that the machine doesn't call toxic, columns as before, whatever their names; one pass, no shuffle. Null and empty
    texts have the score of no terms; repeated rows stay or go together; an empty table gives an empty result."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for whole in batches:
            for batch in bytewords.pieces(whole, "text"):
                yield batch.filter(pa.array(own.scores(batch.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
