"""Which labelled rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: Column) -> Column:
    """crc32 of the key as text, mod 5, is 0: never learnt from. A null key counts as the text ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """(key, y): labelled rows outside the held-out fold; keys whose rows contradict each other are left out."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    return rows.groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("y1")).filter("y = y1").select(key, F.col("y").cast("int").alias("y"))
