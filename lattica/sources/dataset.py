"""Sparse matrices as a dataset: Parquet in row blocks, and a metadata table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.matrix import Matrix


def block_sizes(spark: SparkSession, numrows: int, writers: int) -> DataFrame:
    """(writer, first_row, rows): consecutive blocks of rows, (numrows + writers - writer - 1) div writers each."""
    size = lambda i: F.floor((F.lit(numrows) + writers - i - 1) / writers)
    base, more = divmod(numrows, writers)
    first = F.col("id") * base + F.least("id", F.lit(more))
    return spark.range(writers).select(F.col("id").alias("writer"), first.cast("long").alias("first_row"), size(F.col("id")).cast("long").alias("rows"))


def write(matrix: Matrix, path: str, writers: int) -> None:
    base, more = divmod(matrix.numrows, writers)
    edge = more * (base + 1)
    writer = F.when(F.col("row") < edge, F.floor(F.col("row") / (base + 1))).otherwise(more + F.floor((F.col("row") - edge) / max(1, base)))
    entries = matrix.entries.withColumn("writer", writer.cast("int"))
    entries.repartitionByRange(writers, "row").sortWithinPartitions("writer", "row", "col").write.mode("overwrite").partitionBy("writer").parquet(f"{path}/nonzero")
    meta = [(matrix.numrows, matrix.numcols, matrix.nnz(), writers)]
    matrix.entries.sparkSession.createDataFrame(meta, "numrows long, numcols long, nnz long, writers int").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def metadata(spark: SparkSession, path: str) -> tuple[int, int, int, int]:
    return tuple(spark.read.parquet(f"{path}/metadata").first())


def read(spark: SparkSession, path: str) -> Matrix:
    """Raises ValueError if the entries aren't as many as the metadata says."""
    numrows, numcols, nnz, _ = metadata(spark, path)
    entries = spark.read.schema("row long, col long, writer int").parquet(f"{path}/nonzero").select("row", "col")
    if entries.count() != nnz:
        raise ValueError(f"{nnz} entries declared, others found")
    return Matrix(entries, numrows, numcols)


def row_counts(matrix: Matrix) -> DataFrame:
    """(row, cnt): what the row-count files hold."""
    return matrix.row_counts()
