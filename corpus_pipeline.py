"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

All stages take any rows: nulls in any column, empty and very long texts, repeated doc_ids and rows, an empty table, further
columns. What each makes of them is said below; columns stay as they are in all but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontamination, mixing, near_dedup, sharding, toxicity
from lattica.session import delete, drop, scratch, table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine doesn't reject. It learns from ``labels`` of these documents; without any, or with one label
    only, all stay unless that label is 1. Null and empty texts have the score of no terms. Rows equal in text stay or go together."""
    machine = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, machine)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, with all rows that repeat it. Rows without words or
    without a doc_id stay."""
    return near_dedup.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay; without items all do."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each row as often as it is taken, those without words never. Null is a source like others."""
    return mixing.take(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of documents with size, text_crc32, shard and slot, which replace columns of these names. A null text counts as empty."""
    return sharding.place(docs)


STAGES = [("toxicity", toxic), ("near_dedup", near_copies), ("decontamination", leaks), ("mixing", mix), ("sharding", shards)]

#: The toxicity machine is fitted and the mix solves for tilts: SQL can't express them. tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``. Each stage's result is a table in this application's part of the
    shared folder, which is deleted, with the operators' own tables, once the next stage is written; the last stage's input stays."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        since, path = written(), scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        drop(spark, since)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
