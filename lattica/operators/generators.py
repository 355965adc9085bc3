"""Random permutations and graphs, stars and Kronecker products. All are functions of their seed, whatever the layout."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.portable import keyed, mix32, u32, u32_of_numbers
from lattica.operators.matrix import Matrix
from lattica.operators.numbering import numbered


def rand_perm(ids: DataFrame, seed: int) -> DataFrame:
    """(idx, newpos): a permutation of 0 .. n - 1 over ``ids`` (idx), by the order of md5(idx:seed). Buckets are the first
    16 bits of the digest, so no task sorts more than a 65,536th of the rows."""
    digest = ids.select("idx", F.md5(keyed(F.col("idx"), seed)).alias("m"))
    return numbered(digest, "newpos", [F.col("m"), F.col("idx")], F.substring("m", 1, 4)).select("idx", "newpos")


def rand_perm_bucketed(ids: DataFrame, seed: int, buckets: int = 64) -> DataFrame:
    """The same by throwing each element into a random bucket and shuffling the buckets; each is numbered in 256 runs."""
    thrown = ids.select("idx", (u32(keyed(F.col("idx"), seed, "b")) % buckets).alias("b"), F.md5(keyed(F.col("idx"), seed, "s")).alias("m"))
    return numbered(thrown, "newpos", [F.col("m"), F.col("idx")], F.struct(F.col("b"), F.substring("m", 1, 2))).select("idx", "newpos")


def _dealt(spark: SparkSession, n: int) -> DataFrame:
    """(id): 0 .. n - 1, dealt out at random."""
    return spark.range(n).repartition(max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions")))), F.xxhash64("id"))


def er_naive(spark: SparkSession, n: int, p: float, seed: int, lower: bool = True, diagonal: bool = False) -> Matrix:
    """A coin for each cell of a triangle: row i tosses for its own cells, so no pairs are formed that aren't tossed for. Rows are dealt
    out at random, as row i has i cells; coins are ``portable.coin(p, i, j, seed)``, on arrays of ``most`` cells."""
    below, after = round(p * (1 << 32)), f":{seed}".encode()

    def run(batches: Iterator[pa.RecordBatch], most: int = 1 << 13) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, length = sorted(batch.column("id").to_pylist()), 0, 1
            while ids and at < ids[-1]:
                to = min(at + most, 10**length, ids[-1])
                js = np.arange(at, to)
                digits = [js // 10**k % 10 for k in reversed(range(length))]
                for i in ids[bisect_right(ids, at) :]:
                    n = min(i, to) - at
                    cols = js[:n][u32_of_numbers(f"{i}:".encode(), [x[:n] for x in digits], after) < below]
                    if len(cols):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols), i)), pa.array(cols)], ["i", "j"])
                at, length = to, length + (to == 10**length)

    cells = _dealt(spark, n).mapInArrow(run, "i long, j long")
    entries = cells.select(F.col("i").alias("row"), F.col("j").alias("col")) if lower else cells.select(F.col("j").alias("row"), F.col("i").alias("col"))
    if diagonal:
        entries = entries.union(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col")))
    return Matrix(entries, n, n)


def er_triangle(spark: SparkSession, n: int, p: float, seed: int, lower: bool = True, diagonal: bool = False, most: int = 1 << 16) -> Matrix:
    """The same distribution by geometric gaps: work for the entries made, not for the cells. Gap k of row i is a function of
    (seed, i, k), so the graph doesn't depend on the layout; rows are dealt out at random, as row i has i cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                at, k = -1, 0
                start = mix32((i + seed * 2654435769) & 0xFFFFFFFF)
                while at < i:
                    if p >= 1:
                        cols = np.arange(i)
                        at = i
                    else:
                        some = np.arange(k, k + min(most, int((i - at) * p * 1.2) + 16), dtype=np.uint64)
                        k += len(some)
                        coins = (mix32(start ^ some).astype(float) + 0.5) / 4294967296
                        gaps = np.minimum(np.floor(np.log(coins) / np.log(1 - p)) + 1, i + 1).astype(np.int64)
                        cols = at + np.cumsum(gaps)
                        at = int(cols[-1])
                        cols = cols[cols < i]
                    if len(cols):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols), i)), pa.array(cols.astype(np.int64))], ["row", "col"])

    entries = _dealt(spark, n).mapInArrow(run, "row long, col long") if p > 0 and n > 1 else spark.createDataFrame([], "row long, col long")
    if not lower:
        entries = entries.select(F.col("col").alias("row"), F.col("row").alias("col"))
    if diagonal:
        entries = entries.union(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col")))
    return Matrix(entries, n, n)


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int, mode: int, diagonal: bool = False, make=er_triangle) -> Matrix:
    """mode 0: symmetric; 1: lower; 2: upper; 3: upper and an independent lower. The diagonal comes once."""
    if mode in (1, 2):
        return make(spark, n, p, seed, lower=mode == 1, diagonal=diagonal)
    upper = make(spark, n, p, seed, lower=False, diagonal=diagonal)
    lower = make(spark, n, p, seed, lower=True) if mode == 0 else make(spark, n, p, seed + 1, lower=True)
    return Matrix(upper.entries.union(lower.entries), n, n)


def star(spark: SparkSession, m: int, mode: int) -> Matrix:
    """K(1, m) with hub 0. mode 1: a loop at the hub; mode 2: a loop at vertex m."""
    leaves = spark.range(1, m + 1).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("col"))
    entries = leaves.union(leaves.select("col", "row"))
    if mode:
        at = 0 if mode == 1 else m
        entries = entries.union(spark.range(at, at + 1).select(F.col("id").alias("row"), F.col("id").alias("col")))
    return Matrix(entries, m + 1, m + 1)


def kron(b: Matrix, c: Matrix, lower: bool = False) -> Matrix:
    """Every pair of entries is an entry of the product, so its rows are the output, not an intermediate. The smaller factor is
    broadcast if Spark finds it small."""
    x, y = b.entries.select(F.col("row").alias("rb"), F.col("col").alias("cb")), c.entries.select(F.col("row").alias("rc"), F.col("col").alias("cc"))
    entries = x.crossJoin(y).select((F.col("rb") * c.numrows + F.col("rc")).alias("row"), (F.col("cb") * c.numcols + F.col("cc")).alias("col"))
    return Matrix(entries.filter("col < row") if lower else entries, b.numrows * c.numrows, b.numcols * c.numcols)


def kron_stars(spark: SparkSession, sizes: list[int], mode: int, lower: bool = False) -> Matrix:
    """The Kronecker product of stars, left to right."""
    made = reduce(kron, (star(spark, m, mode) for m in sizes))
    return Matrix(made.entries.filter("col < row"), made.numrows, made.numcols) if lower else made


def parse_spec(spec: str) -> tuple[int, list[int], list[int]]:
    """"mode m1 m2 ..." -> mode and the sizes, cut in half for the two factors."""
    mode, *sizes = map(int, spec.split())
    if mode not in (0, 1, 2) or not sizes or min(sizes) < 1:
        raise ValueError(f"not a mode from 0 to 2 and star sizes: {spec!r}")
    half = len(sizes) // 2
    return mode, sizes[:half], sizes[half:]


def kron_triangles(mode: int, sizes: list[int]) -> int:
    """Triangles of a Kronecker product of stars, in closed form."""
    if mode == 0:
        return 0
    if mode == 1:
        a = reduce(lambda x, m: x * (3 * m + 1), sizes, 1) / 6
        return round(a - reduce(lambda x, m: x * (m + 1), sizes, 1) / 2 + 1 / 3)
    return round(4 ** len(sizes) / 6 - 2 ** (len(sizes) - 1) + 1 / 3)


def morally_triangular(upper: Matrix, ids: DataFrame, seed: int) -> Matrix:
    """An upper triangular matrix with full diagonal, rows and columns permuted at random."""
    return upper.permute(rand_perm(ids, seed), rand_perm(ids, seed + 1))
