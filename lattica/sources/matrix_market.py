"""MatrixMarket coordinate files: ``pattern`` or ``integer`` fields (values are dropped), general or symmetric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.matrix import Matrix


def read(spark: SparkSession, path: str) -> Matrix:
    """The file may be split over many tasks: the size line is the first that isn't a comment, found by offset, and entries are
    parsed where they lie. Raises ValueError on another banner or if the entries aren't as many as declared."""
    lines = spark.read.text(path)
    head = lines.limit(1).first()
    banner = (head[0] if head else "").lower().split()
    if banner[:3] != ["%%matrixmarket", "matrix", "coordinate"] or len(banner) < 4 or banner[3] not in ("pattern", "integer"):
        raise ValueError(f"not a MatrixMarket coordinate matrix of pattern or integer: {head and head[0]!r}")
    symmetric = len(banner) > 4 and banner[4] == "symmetric"
    if len(banner) > 4 and banner[4] not in ("general", "symmetric"):
        raise ValueError(f"symmetry {banner[4]!r} is not supported")
    body = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = body.limit(1).first()
    numrows, numcols, declared = map(int, size[0].split())
    parts = F.split(F.trim("value"), r"\s+")
    rows = body.select(F.get(parts, 0).cast("long").alias("row"), F.get(parts, 1).cast("long").alias("col"), F.monotonically_increasing_id().alias("at"))
    first = rows.agg(F.min("at")).first()[0]
    entries = rows.filter(F.col("at") != first).select((F.col("row") - 1).alias("row"), (F.col("col") - 1).alias("col"))
    found, low, high, wide = entries.agg(F.count("*"), F.min(F.least("row", "col")), F.max("row"), F.max("col")).first()
    if found != declared:
        raise ValueError(f"{declared} entries declared, {found} found")
    if found and (low < 0 or high >= numrows or wide >= numcols):
        raise ValueError("an entry is outside of the matrix")
    if symmetric:
        entries = entries.union(entries.select("col", "row"))
    return Matrix.of(entries, numrows, numcols)


def lines(matrix: Matrix) -> DataFrame:
    """The file's lines (value) with their place: banner, size, then 1-based pairs in order."""
    spark = matrix.entries.sparkSession
    nnz = matrix.nnz()
    head = spark.createDataFrame([(0, 0, "%%MatrixMarket matrix coordinate pattern general"), (0, 1, f"{matrix.numrows} {matrix.numcols} {nnz}")], "row long, col long, value string")
    body = matrix.entries.select((F.col("row") + 1).alias("row"), F.col("col"), F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string")).alias("value"))
    return head.union(body)


def write(matrix: Matrix, path: str) -> None:
    """One text file. A single file is the format, so a single task writes it, after a sort that many tasks share."""
    lines(matrix).orderBy("row", "col").coalesce(1).select("value").write.mode("overwrite").text(path)
