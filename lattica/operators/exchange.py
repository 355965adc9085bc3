"""Keyed all-to-all delivery: a shuffle by destination, with an order per (source, destination) that the rows carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lattica.functions.portable import keyed, u32
from lattica.operators.numbering import numbered


def deliver(messages: DataFrame, dest: str = "dest") -> DataFrame:
    """Every message once, with those of one destination together."""
    return messages.repartition(dest)


def fifo(messages: DataFrame, order: list[Column], bucket: Column) -> DataFrame:
    """Messages with the place each has among those of its (src, dest) in the order they were sent. A shuffle delivers a
    multiset; the place, not the arrival, is the order."""
    return numbered(messages, "place", order, bucket, by=["src", "dest"])


def counts(messages: DataFrame) -> DataFrame:
    """(src, dest, items)."""
    return messages.groupBy("src", "dest").agg(F.count("*").alias("items"))


def volumes(messages: DataFrame, payload: str) -> DataFrame:
    """(dest, items, bytes) of messages with a payload of any length."""
    return messages.groupBy("dest").agg(F.count("*").alias("items"), F.sum(F.octet_length(payload).cast("long")).alias("bytes"))


def statistics(messages: DataFrame, dest: str = "dest") -> DataFrame:
    """One row: pushes, destinations, most and fewest items of a destination."""
    by = messages.groupBy(dest).agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").cast("long").alias("pushes"), F.count("*").alias("destinations"), F.max("n").alias("most"), F.min("n").alias("fewest"))


def observed(messages: DataFrame, payload: str, dest: str = "dest") -> tuple[DataFrame, Observation, Observation]:
    """The delivered messages with counters that any action on them fills on the way: pushes and bytes before the exchange, pulls and
    bytes after it."""
    size = F.coalesce(F.sum(F.octet_length(payload).cast("long")), F.lit(0))
    sent, got = Observation(), Observation()
    pushed = messages.observe(sent, F.count("*").alias("pushes"), size.alias("bytes"))
    return deliver(pushed, dest).observe(got, F.count("*").alias("pulls"), size.alias("bytes")), sent, got


def rejections(key: list[Column], share: float, seed: int, most: int = 16) -> Column:
    """How often a receiver puts a message back before it keeps it: a coin an attempt, ``most`` times at most."""
    put_back = lambda i: (u32(keyed(*key, i, F.lit(str(seed)))) < F.lit(round(share * (1 << 32)))) & (i < most)
    return (F.array_position(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: ~put_back(i)), True) - 1).cast("long")


def pulls(messages: DataFrame, key: list[Column], share: float, seed: int) -> DataFrame:
    """(dest, items, pulls, unpulls) where receivers put back a share of what they pull: every message is kept once in the end."""
    tried = messages.withColumn("__back", rejections(key, share, seed))
    return tried.groupBy("dest").agg(F.count("*").alias("items"), (F.count("*") + F.sum("__back")).alias("pulls"), F.sum("__back").alias("unpulls"))
