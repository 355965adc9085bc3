"""Session set-up, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rows of two numbers (about 60 bytes each) are broadcast.
BROADCAST_ROWS = 1 << 21
#: Counted rows that are worth a task, and a file, of their own (beyond a task for each core).
TASK_ROWS = 1 << 14
#: Paths of the tables that ``cut`` has written, in order.
_written: list[str] = []


def local_session(cores: int | str = "*", app: str = "lattica") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder stands in on a local master
    (tests); a cluster's executors could not see one, so there that is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
    return sc.getCheckpointDir()


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; ``discard`` deletes it."""
    return f"{shared_folder(spark)}/lattica-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder and read again: its lineage ends there, so lost executors cost no
    recomputation of a loop, and its size is known (a checkpoint keeps the estimate of the plan it came from, which joins in a
    loop multiply until it has millions of digits). The tables stay until ``drop`` or ``discard``."""
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def kept(df: DataFrame) -> bool:
    """Whether a table that ``cut`` has written is still there."""
    return df.cut_path in _written


def written() -> int:
    """How many tables ``cut`` has written so far, for ``drop``."""
    return len(_written)


def drop(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the tables that ``cut`` has written after ``since`` tables, but for the last ``keep``; results that still read them
    are lost. Shuffle files of what is no longer referenced go too, which else waits for the driver's next garbage collection."""
    last = _written[len(_written) - keep :]
    for path in _written[since : len(_written) - keep]:
        delete(spark, path)
    _written[since:] = last
    free(spark)


def remove(df: DataFrame) -> None:
    """Deletes one table that ``cut`` has written, and what shuffle files are no longer referenced."""
    _written.remove(df.cut_path)
    delete(df.sparkSession, df.cut_path)
    free(df.sparkSession)


def small(df: DataFrame, n: int) -> DataFrame:
    """A side of a join that has ``n`` rows of two numbers: broadcast up to ``BROADCAST_ROWS``; else never, nor the other side, whose
    size Spark may guess far too low."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which comes from an exchange and has at most so many rows, in no more tasks and files than are worth it, however many
    partitions the exchange has. A file costs an executor several processes where Hadoop sets its mode by ``chmod``."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def free(spark: SparkSession) -> None:
    """Has the shuffle files of what is no longer referenced deleted."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(spark: SparkSession) -> None:
    """Deletes all that this application's operators have written; results that still read it are lost."""
    _written.clear()
    delete(spark, own_folder(spark))
