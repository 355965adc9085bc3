"""Global numbers and running sums without an order over all rows in one task.

Rows are cut into buckets that follow the order; counts (or sums) by bucket are few and are added up in a window, and the rest
is a window within a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _starts(df: DataFrame, by: list[str], bucket: str, value: Column) -> DataFrame:
    ahead = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, bucket).agg(value.alias("__sum"))
    return sums.withColumn("__start", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")


def numbered(df: DataFrame, name: str, order: list[Column], bucket: Column, by: list[str] | None = None, cap: int = 0) -> DataFrame:
    """``df`` with 0, 1, 2, ... in ``order`` (within ``by``). ``bucket`` must not fall along the order; null buckets go first."""
    by = by or []
    rows = df.withColumn("__bucket", bucket)
    starts = _starts(rows, by, "__bucket", F.count("*")).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bucket").alias("__at"), "__start")
    place = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(*order)) - 1
    same = F.col("__bucket").eqNullSafe(F.col("__at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.withColumn("__place", place).join(starts, same).withColumn(name, (F.col("__start") + F.col("__place")).cast("long")).drop("__bucket", "__at", "__start", "__place", *[f"__{c}" for c in by])


def running_sum(df: DataFrame, name: str, value: str, index: str, size: int = 1 << 16, inclusive: bool = True) -> DataFrame:
    """The sum of ``value`` over all rows up to each ``index`` (unique integers)."""
    rows = df.withColumn("__bucket", F.floor(F.col(index) / size))
    starts = _starts(rows, [], "__bucket", F.sum(value))
    within = F.sum(value).over(Window.partitionBy("__bucket").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    total = F.col("__start") + F.col("__within") - (0 if inclusive else F.col(value))
    return rows.withColumn("__within", within).join(starts, "__bucket").withColumn(name, total.cast("long")).drop("__bucket", "__start", "__within")


def fewer(keys: DataFrame, most: int = 1 << 21) -> DataFrame:
    """One column of longs without the repeats among ``most`` of a task at a time: what a distinct leaves out ahead of its exchange,
    for results that are exchanged, and made distinct, by something else."""
    name = keys.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy())
            n += batch.num_rows
            if n >= most:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], [name])
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], [name])

    return keys.mapInArrow(run, f"{name} long")
