"""Steady exchanges: results that follow a stream of updates without an end to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.graph import components_incremental
from lattica.session import scratch


def steady_histogram(spark: SparkSession, path: str, schema, key: str, files: int = 1) -> DataFrame:
    """(key, cnt) of a Parquet file, or of a folder of them, read as a stream in micro-batches until all that is there is counted. The state is
    a count a key; each micro-batch writes all counts to its own folder, so a replayed batch replaces itself."""
    folder = scratch(spark, "steady")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    parent, _, name = path.rpartition("/")
    one = all(f.rstrip("/").endswith(f"/{name}") for f in spark.read.parquet(path).inputFiles())
    stream = reader.option("pathGlobFilter", name).parquet(parent) if one else reader.parquet(path)
    counts = stream.groupBy(key).agg(F.count("*").alias("cnt"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number:09d}")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    done = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    return spark.read.parquet(f"{folder}/out/{max(done, default=0):09d}")


def component_waves(spark: SparkSession, waves: list[DataFrame]) -> DataFrame:
    """(node, component) after waves of edges (u, v), one after another."""
    labels = spark.createDataFrame([], "node long, component long")
    for wave in waves:
        labels = components_incremental(labels, wave)
    return labels
