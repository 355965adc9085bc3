"""Words and their hashes, straight from the bytes of an Arrow string column with numpy.

A batch's texts lie end to end in one buffer; words, hashes and shingles of all its documents come from a few array
operations over it. Work goes in segments of ``SEGMENT`` bytes, so memory follows the segment and the words, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three xor-shifts, two multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _MULT + np.uint64(salt)) | np.uint64(1)


_BYTE = seeds(256, 11)
#: The same with A-Z as a-z.
_FOLD = _BYTE.copy()
_FOLD[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
#: Independent of these, where 64 bits are too few.
_OTHER = seeds(256, 13)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        m = max(n, SEGMENT + 1)
        for i, base in enumerate((_MULT, _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def spans(data: np.ndarray, offsets: np.ndarray, stops: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of bytes that aren't in ``stops``; no run crosses documents."""
    word = ~stops[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial from running sums, then mixed. fold: A-Z count as a-z. table: each byte's number."""
    out, i = np.empty(len(starts), np.uint64), 0
    table = table if table is not None else _FOLD if fold else _BYTE
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        base = starts[i]
        size = int(ends[j - 1] - base)
        up, down = _powers(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(table[data[base : base + size]] * up[:size], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Another 64 bits of each span's bytes; spans in any order."""
    order, out = np.argsort(starts, kind="stable"), np.empty(len(starts), np.uint64)
    out[order] = span_hashes(data, starts[order], ends[order], table=_OTHER)
    return out


def words(column, stops: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words before each document)."""
    data, offsets = utf8(column)
    starts, ends = spans(data, offsets, stops)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, number before each document): ``size`` words each; of fewer words, the whole sequence."""
    counts = np.diff(at)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    before = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(before[-1]) + np.repeat(at[:-1] - before[:-1], n)
    have = np.repeat(np.minimum(counts, size), n)
    out = np.zeros(len(first), np.uint64)
    for k, c in enumerate(seeds(size, 23)):
        on = have > k
        if on.all():
            out += hashes[first + k] * c if k else hashes[first] * c
        else:
            out[on] += hashes[first[on] + k] * c
    return mix(out + have.astype(np.uint64)), before


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes, ascending, and their number before each document."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    n = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(n)])


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in slices of about ``most`` bytes of ``column``."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j
