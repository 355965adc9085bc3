"""Scatter, gather, reductions and atomics on indexed arrays: DataFrames of (idx, ...)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.portable import MULTIPLIER, PRIME, poisson_tail
from lattica.operators.numbering import numbered


def histogram(updates: DataFrame, idx: str = "idx") -> DataFrame:
    """(idx, cnt) of the bins that are hit. Partial counts are added up before the exchange, so a hot bin costs one row a task."""
    return updates.groupBy(F.col(idx).cast("long").alias("idx")).agg(F.count("*").alias("cnt"))


def histogram_dense(updates: DataFrame, bins: int, idx: str = "idx") -> DataFrame:
    """(idx, cnt) of all bins 0 .. bins - 1; an update outside of them is an error in the input and is not counted."""
    counts = histogram(updates, idx)
    every = updates.sparkSession.range(bins).withColumnRenamed("id", "idx")
    return every.join(counts, "idx", "left").select("idx", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def scatter_add(updates: DataFrame, value: str, idx: str = "idx") -> DataFrame:
    return updates.groupBy(F.col(idx).cast("long").alias("idx")).agg(F.sum(value).alias("total"))


def peak(counts: DataFrame, bins: int) -> DataFrame:
    """(idx, cnt, significance): the fullest bin, the first of equals; how many such peaks chance gives among all bins."""
    top = counts.agg(F.max(F.struct("cnt", (-F.col("idx")).alias("back"))).alias("m"), F.sum("cnt").alias("load"))
    mean = F.col("load") / F.lit(float(bins))
    return top.select((-F.col("m.back")).alias("idx"), F.col("m.cnt").alias("cnt"), (poisson_tail(mean, F.col("m.cnt")) * bins).alias("significance"))


def gather(requests: DataFrame, values: DataFrame, idx: str = "idx") -> DataFrame:
    """Each request with the value at its index: an equi-join on the unique index of ``values``; requests may repeat. Spark
    broadcasts a small side and else shuffles both; AQE splits hot indices."""
    return requests.join(values, idx)


def gather_checksum(slot: Column, index: Column) -> Column:
    """(sum of (slot + 1) * index, mod PRIME) * MULTIPLIER mod PRIME, in decimals as 64 bits would overflow."""
    total = F.sum(((slot + 1).cast("decimal(20,0)") * index.cast("decimal(17,0)")).cast("decimal(38,0)"))
    return ((total % PRIME).cast("decimal(19,0)") * MULTIPLIER % PRIME).cast("long")


def exchange_checksum(seq: Column, source: Column, word: Column) -> Column:
    """Sum of (2 seq + 2 source + 1) * word, mod 2^64, the same for any order of the rows; decimal(20,0), as it is unsigned."""
    total = F.sum(((2 * seq + 2 * source + 1).cast("decimal(18,0)") * word.cast("decimal(19,0)")).cast("decimal(38,0)"))
    return F.pmod(total, F.lit(Decimal(1 << 64))).cast("decimal(20,0)")


def min_avg_max(df: DataFrame, value: str, among: int) -> DataFrame:
    """Least, average and greatest; the average of integers is a whole division by ``among``, next to the true one."""
    total = F.sum(value)
    return df.agg(F.min(value).alias("min"), F.floor(total / among).cast("long").alias("avg_int"), (total / F.lit(float(among))).alias("avg"), F.max(value).alias("max"))


def claim(requests: DataFrame, slot: str, key: str) -> DataFrame:
    """The first claimant (smallest key) of each empty slot: compare-and-swap without a race. One minimum a slot, no sort."""
    return requests.groupBy(slot).agg(F.min(key).alias(key), F.count("*").alias("claims"))


def put(array: DataFrame, writes: DataFrame, idx: str = "idx", value: str = "val") -> DataFrame:
    """``array`` with ``writes`` (unique idx) stored over it."""
    new = writes.select(idx, F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    return array.join(new, idx, "left").select(idx, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(value)).alias(value))


def block(array: DataFrame, start: int, length: int, idx: str = "idx") -> DataFrame:
    """A block get: the elements start .. start + length - 1; the range is pushed down to the scan."""
    return array.filter((F.col(idx) >= start) & (F.col(idx) < start + length))


def tickets(df: DataFrame, counter: str, order: list[Column], bucket: Column) -> DataFrame:
    """Fetch-and-add: each row gets the number of rows before it on the same counter. ``bucket`` must not fall along the order: it
    cuts a hot counter's rows into runs that are numbered apart."""
    return numbered(df, "ticket", order, bucket, by=[counter])
