"""Groups of equal rows that are too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import cut

#: Rows that are numbered in one task.
HOT = 1 << 16
#: Groups of more than ``HOT`` rows are broadcast up to this many (under 100 bytes each); beyond, Spark shuffles.
BROADCAST = 100_000


def divided(rows: DataFrame, by: list[str], among: DataFrame | None = None) -> DataFrame | None:
    """``rows`` with ``turn``, a number of its own for each row of groups (equal in ``by``) of more than ``HOT`` rows, and ``turns``, in how
    many parts of about ``HOT`` rows ``turn`` mod ``turns`` divides the group; null for all other rows. None if there is no such group.
    ``among``: rows (at least ``by``) that hold all such groups.

    Rows equal in ``by`` must be interchangeable. The result is a written table: which of them gets which number depends on the
    layout, so it must not be computed twice.
    """
    groups = (rows if among is None else among).groupBy(*by).agg(F.count("*").alias("__c")).filter(F.col("__c") > HOT)
    groups = cut(groups.select(*[F.col(c).alias(f"__{c}") for c in by], F.ceil(F.col("__c") / HOT).alias("__turns")))
    n = groups.count()
    if not n:
        return None
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    found = rows.withColumn("__at", F.monotonically_increasing_id()).join(F.broadcast(groups) if n <= BROADCAST else groups, same, "left")
    turn = F.when(F.col("__turns").isNotNull(), F.col("__at")).alias("turn")
    return cut(found.select(*rows.columns, turn, F.col("__turns").alias("turns")))
