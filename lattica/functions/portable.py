"""Functions that give the same values in Spark and in plain SQL engines."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus and multiplier of the gather checksum (fixed values).
PRIME = 3690948119
MULTIPLIER = 2646891621


def keyed(*parts) -> Column:
    """The parts as text with ':' between them."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *cols)


def u32(text: Column) -> Column:
    """The first 32 bits of a text's md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


_SINES = [int(abs(math.sin(t + 1)) * 4294967296) for t in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def u32_of_numbers(before: bytes, digits: list[np.ndarray], after: bytes) -> np.ndarray:
    """``u32`` of texts of up to 55 bytes that differ in a number: ``before``, the number's decimal digits (an array a place, the
    first place first), ``after``. md5 on arrays, up to the step that gives the first 32 bits."""
    size = len(before) + len(digits) + len(after)
    if size > 55:
        raise ValueError("a text of one block has 55 bytes at most")
    block = before + bytes(len(digits)) + after + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
    words: list = [int.from_bytes(block[x : x + 4], "little") for x in range(0, 64, 4)]
    for at, digit in enumerate(digits, len(before)):
        words[at // 4] = words[at // 4] + ((digit.astype(np.uint32) + np.uint32(48)) << np.uint32(8 * (at % 4)))
    n = len(digits[0])
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for t in range(61):
        if t < 16:
            at = t
            np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=f), out=f), out=f)
        elif t < 32:
            at = (5 * t + 1) % 16
            np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=f), out=f), out=f)
        elif t < 48:
            at = (3 * t + 5) % 16
            np.bitwise_xor(d, np.bitwise_xor(b, c, out=f), out=f)
        else:
            at = 7 * t % 16
            np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=f), out=f), out=f)
        f += a
        if isinstance(words[at], int):
            f += np.uint32((words[at] + _SINES[t]) & 0xFFFFFFFF)
        else:
            f += words[at]
            f += np.uint32(_SINES[t])
        turn = _TURNS[t // 16][t % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(0x67452301)).byteswap()


def coin(p: float, *parts) -> Column:
    """True with probability p, decided by the parts alone."""
    return u32(keyed(*parts)) < F.lit(round(p * (1 << 32)))


def mix32(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser (three xor-shifts, two multiplications) of integers below 2^32, in 64-bit arithmetic."""
    x = np.asarray(x, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x7FEB352D)) & low
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x846CA68B)) & low
    return x ^ (x >> np.uint64(16))


def pack(index: Column, pes: int) -> Column:
    """An index of a cyclic layout in one word: local index above 16 bits of process number (so at most 65,536 processes)."""
    return F.shiftleft(F.floor(index / pes).cast("long"), 16).bitwiseOR(index % pes)


def unpack(word: Column, pes: int) -> Column:
    return F.shiftright(word, 16) * pes + word.bitwiseAND(F.lit(0xFFFF))


def log_factorial(n: Column) -> Column:
    """ln(n!): exact up to 20, Stirling's series beyond."""
    n = n.cast("double")
    series = n * F.log(n) - n + 0.5 * F.log(2 * F.lit(3.141592653589793) * n) + 1 / (12 * n) - 1 / (360 * n**3)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


def poisson_tail(mean: Column, at: Column, terms: int = 10) -> Column:
    """The probability of the first ``terms`` counts from ``at`` on."""
    one = lambda i: F.exp(-mean + (at + i) * F.log(mean) - log_factorial(at + i))
    return reduce(lambda a, b: a + b, (one(i) for i in range(terms)))
