"""Positional sparse matrices: an edge table of distinct (row, col), with its shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.numbering import numbered
from lattica.session import small


@dataclass
class Matrix:
    entries: DataFrame
    numrows: int
    numcols: int

    @classmethod
    def of(cls, entries: DataFrame, numrows: int, numcols: int) -> Matrix:
        """From pairs that may repeat."""
        return cls(entries.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct(), numrows, numcols)

    def nnz(self) -> int:
        return self.entries.count()

    def transpose(self) -> Matrix:
        """A projection: no exchange."""
        return Matrix(self.entries.select(F.col("col").alias("row"), F.col("row").alias("col")), self.numcols, self.numrows)

    def permute(self, rows: DataFrame, cols: DataFrame) -> Matrix:
        """Entry (i, j) goes to (rows[i], cols[j]); permutations are (idx, newpos), broadcast where the shape says they are small."""
        r = rows.select(F.col("idx").alias("row"), F.col("newpos").alias("nr"))
        c = cols.select(F.col("idx").alias("col"), F.col("newpos").alias("nc"))
        moved = self.entries.join(small(r, self.numrows), "row").join(small(c, self.numcols), "col")
        return Matrix(moved.select(F.col("nr").alias("row"), F.col("nc").alias("col")), self.numrows, self.numcols)

    def tril(self, k: int = 0) -> Matrix:
        return Matrix(self.entries.filter(F.col("col") - F.col("row") <= k), self.numrows, self.numcols)

    def triu(self, k: int = 0) -> Matrix:
        return Matrix(self.entries.filter(F.col("col") - F.col("row") >= k), self.numrows, self.numcols)

    def union(self, other: Matrix) -> Matrix:
        return Matrix(self.entries.union(other.entries).distinct(), max(self.numrows, other.numrows), max(self.numcols, other.numcols))

    def csr(self) -> DataFrame:
        """(row, cols): the column ids of each row that has any, ascending."""
        return self.entries.groupBy("row").agg(F.sort_array(F.collect_list("col")).alias("cols"))

    def row_counts(self) -> DataFrame:
        """(row, cnt) of all rows, empty ones too."""
        return _all(self.entries.groupBy("row").agg(F.count("*").alias("cnt")), "row", self.numrows)

    def col_counts(self) -> DataFrame:
        return _all(self.entries.groupBy("col").agg(F.count("*").alias("cnt")), "col", self.numcols)

    def triangular(self, upper: bool, unit: bool = False) -> DataFrame:
        """One row: 1 if no entry is on the wrong side and, if ``unit``, every row has its diagonal entry."""
        gap = F.col("col") - F.col("row")
        wrong = F.count_if(gap < 0 if upper else gap > 0)
        ok = (wrong == 0) & ((F.count_if(gap == 0) == self.numrows) if unit else F.lit(True))
        return self.entries.agg(ok.cast("long").alias("ok"))

    def compare(self, other: Matrix) -> DataFrame:
        """One row: 0 if both have the same shape and entries, else 1. One aggregation, no order."""
        both = self.entries.select("row", "col", F.lit(1).alias("d")).union(other.entries.select("row", "col", F.lit(-1).alias("d")))
        apart = both.groupBy("row", "col").agg(F.sum("d").alias("d")).filter("d <> 0")
        shape = (self.numrows, self.numcols) == (other.numrows, other.numcols)
        return apart.agg(F.when((F.count("*") == 0) & F.lit(shape), 0).otherwise(1).cast("long").alias("differs"))


def _all(counts: DataFrame, name: str, n: int) -> DataFrame:
    every = counts.sparkSession.range(n).withColumnRenamed("id", name)
    return every.join(counts, name, "left").select(name, F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def invert(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("newpos").alias("idx"), F.col("idx").alias("newpos"))


def is_perm(perm: DataFrame, n: int, column: str = "newpos") -> DataFrame:
    """One row: 1 if the column takes each of 0 .. n - 1 once."""
    inside = F.col(column).between(0, n - 1)
    counts = perm.groupBy(column).agg(F.count("*").alias("c"))
    ok = (F.count("*") == n) & (F.count_if((F.col("c") == 1) & inside) == n)
    return counts.agg(ok.cast("long").alias("ok"))


def row_explode(matrix: Matrix) -> DataFrame:
    """(row, pos, col): the row iterator. Positions are numbered in runs of columns, so a hub's row is never one array or one task's."""
    return numbered(matrix.entries, "pos", [F.col("col")], F.floor(F.col("col") / (1 << 16)), by=["row"]).select("row", "pos", "col")


def degree_one(matrix: Matrix) -> DataFrame:
    """(row, col) of the rows with a single entry."""
    return matrix.entries.groupBy("row").agg(F.count("*").alias("c"), F.sum("col").alias("col")).filter("c = 1").select("row", "col")
