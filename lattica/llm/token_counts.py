"""Token counts of a sentencepiece model, without materialising ids.

No piece of the vocabulary has the space mark inside or at its end after another character (checked when the model is
loaded), so no merge crosses from a character to a following space mark: a text's pieces are those of its pre-tokens, each a
run of space marks with the characters up to the next one. The pieces of each distinct pre-token are counted once.

1. Recurring pre-tokens (twice or more in some megabyte of text) with their frequency: counted where they lie, added up by a
   shuffle of those counts alone.
2. Each of the ``known`` most frequent ones is encoded once and gives (128-bit hash, pieces). These 20 bytes each, a fixed bound,
   are broadcast and joined with every document's pre-token frequencies where these are computed.
3. The other pre-tokens, mostly words that occur once or twice in the corpus, are encoded once in each megabyte that has them:
   that costs less than to shuffle them. Every pre-token of every text is counted one way or the other, and no ids are kept.

To shuffle all distinct pre-tokens and all frequencies of the rare ones, so that the rare ones too are encoded once only, needs
3.4 times the input on disk (projected to 30 GB from 0.5). Within one megabyte 64 bits tell pre-tokens apart: in 10^8 megabytes of
10^5 distinct ones, two share them with a probability of 3%.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import bytewords
from lattica.session import cut

MARK = "▁"
#: Most counts that are broadcast: 10 MB.
KNOWN = 500_000
_STOP = np.zeros(256, bool)
_STOP[0x20] = True


@lru_cache(maxsize=2)
def model(path: str):
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in found.id_to_piece(i).lstrip(MARK) for i in range(found.get_piece_size())):
        raise ValueError("the model has pieces that cross from a character to a space mark")
    return found


def _spaces(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")


def _encode(sp, spaced: list[str]) -> np.ndarray:
    """Pieces of pre-tokens with their marks as spaces. The model puts a mark before what it encodes, but not before nothing."""
    n = [len(x) for x in sp.encode([t[1:] for t in spaced], num_threads=1)]
    return np.array([k if k else len(sp.encode(" ")) for k in n], np.int64)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pre-tokens in texts that each begin with a space: spaces and what follows them."""
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data))


def _read(batch: pa.RecordBatch):
    """(sizes, bytes with a space first, starts, ends, hashes of the pre-tokens, their number before each document)."""
    text = pc.fill_null(batch.column("text"), "")
    size = pc.cast(pc.binary_length(text), pa.int64())
    data, at = bytewords.utf8(pc.if_else(pc.equal(size, 0), "", pc.binary_join_element_wise("", _spaces(text), " ")))
    starts, ends = _spans(data, at)
    return size, data, starts, ends, bytewords.span_hashes(data, starts, ends, fold=False), np.searchsorted(starts, at)


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    whole = data.tobytes()
    return [whole[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, token, freq) of the pre-tokens that recur within a megabyte."""
    for whole in batches:
        for batch in bytewords.pieces(whole, "text", 1 << 20):
            _, data, starts, ends, h, _ = _read(batch)
            distinct, first, count = np.unique(h, return_index=True, return_counts=True)
            on = count > 1
            tokens = _texts(data, starts[first[on]], ends[first[on]])
            second = bytewords.second_hashes(data, starts[first[on]], ends[first[on]])
            yield pa.RecordBatch.from_arrays([pa.array(distinct[on].view(np.int64)), pa.array(second.view(np.int64)), pa.array(tokens, pa.string()), pa.array(count[on])], ["hash", "second", "token", "freq"])


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("second"), pa.array(_encode(sp, batch.column("token").to_pylist()))], ["hash", "second", "pieces"])

    return run


def _sum(path: str, hashes, seconds, counts):
    """Documents -> bytes and pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, known, other, pieces = model(path), hashes.value, seconds.value, counts.value
        for whole in batches:
            for batch in bytewords.pieces(whole, "text", 1 << 20):
                size, data, starts, ends, h, doc = _read(batch)
                distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
                place = np.searchsorted(known, distinct)
                hit = place < len(known)
                hit[hit] = known[place[hit]] == distinct[hit]
                at = first[hit]
                hit[hit] = other[place[hit]] == bytewords.second_hashes(data, starts[at], ends[at])
                n = np.zeros(len(distinct), np.int64)
                n[hit] = pieces[place[hit]]
                n[~hit] = _encode(sp, _texts(data, starts[first[~hit]], ends[first[~hit]]))
                sums = np.concatenate([[0], np.cumsum(n[back])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array((sums[doc[1:]] - sums[doc[:-1]]).astype(np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, known: int = KNOWN) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of ``docs`` (doc_id, text), repeated ones too.

    As the model's library encodes whole texts, without begin, end or added tokens. Null and empty texts have 0 bytes and
    tokens. A null doc_id stays null.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.mapInArrow(_recurring, "hash long, second long, token string, freq long")
    found = cut(found.groupBy("hash", "second").agg(F.min("token").alias("token"), F.sum("freq").alias("freq")))
    # frequencies from the smallest on for which all that are as frequent still fit
    ranks = found.groupBy("freq").agg(F.count("*").alias("c")).withColumn("above", F.sum("c").over(Window.orderBy(F.desc("freq"))))
    least = ranks.filter(F.col("above") <= known).agg(F.min("freq")).first()[0]
    top = found.filter(F.col("freq") >= F.lit(1 << 62 if least is None else least))
    got = top.select("hash", "second", "token").mapInArrow(_pieces(path), "hash long, second long, pieces long").toArrow()  # at most ``known`` rows
    h, h2, n = got["hash"].to_numpy().view(np.uint64), got["second"].to_numpy().view(np.uint64), got["pieces"].to_numpy().astype(np.int32)
    order = np.argsort(h)
    send = spark.sparkContext.broadcast
    counted = docs.mapInArrow(_sum(path, send(h[order]), send(h2[order]), send(n[order])), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
