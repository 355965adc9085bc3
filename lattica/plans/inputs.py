"""What the queries take from the test tables: updates, a matrix, a graph, messages."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.matrix import Matrix
from lattica.operators.numbering import numbered
from lattica.session import table

PES = 8
#: All columns of lineitem, as it has no key; rows equal in all are interchangeable.
EVERY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@lru_cache(maxsize=64)
def rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """A table's rows, from the files' footers."""
    return table(spark, sf_dir, name).count()


@lru_cache(maxsize=64)
def part_bounds(spark: SparkSession, sf_dir: str) -> tuple[int | None, int | None]:
    """The least and the greatest part key of lineitem."""
    return tuple(table(spark, sf_dir, "lineitem").agg(F.min("l_partkey"), F.max("l_partkey")).first())


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("idx"))


def part_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"))


def supplier_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"))


def matrix(spark: SparkSession, sf_dir: str) -> Matrix:
    """Parts by suppliers."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"))
    return Matrix.of(pairs, rows(spark, sf_dir, "part"), rows(spark, sf_dir, "supplier"))


def graph(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """(row, col), row > col: parts that share an order. Lines are exchanged once, by order; pairs as one long where part
    keys have 31 bits, so that fewer bytes are. ``repeats``: pairs may repeat, and are not exchanged."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    pairs = lines.select("l_orderkey", F.col("l_partkey").alias("row")).join(lines.select("l_orderkey", F.col("l_partkey").alias("col")), "l_orderkey")
    pairs = pairs.filter("row > col")
    low, high = part_bounds(spark, sf_dir)
    if low is None or low < 0 or high >= 1 << 31:
        return pairs.select("row", "col").distinct()
    packed = pairs.select(F.shiftleft("row", 32).bitwiseOR(F.col("col")).alias("k"))
    packed = packed if repeats else packed.distinct()
    return packed.select(F.shiftright("k", 32).alias("row"), F.col("k").bitwiseAND(F.lit(0xFFFFFFFF)).alias("col"))


def edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """(u, v), u < v: all edges of the graph."""
    return graph(spark, sf_dir, repeats).select(F.col("col").alias("u"), F.col("row").alias("v"))


def dag(spark: SparkSession, sf_dir: str, repeats: bool = False) -> Matrix:
    """The graph as an upper triangular matrix with full diagonal. ``repeats``: entries may repeat, for ``toposort_levels``."""
    n = rows(spark, sf_dir, "part")
    diagonal = spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"))
    return Matrix(edges(spark, sf_dir, repeats).select(F.col("u").alias("row"), F.col("v").alias("col")).union(diagonal), n, n)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as messages: src, dest, and seq in an order over all columns."""
    sent = table(spark, sf_dir, "lineitem").withColumns({"src": F.col("l_suppkey") % PES, "dest": F.col("l_partkey") % PES})
    return numbered(sent, "seq", [F.col(c) for c in EVERY], F.floor(F.col("l_orderkey") / 1024), by=["src"])
