"""Members of posting lists dealt out to blocks of bounded size, so that no list meets in one task.

A list is open while its members lie in more than one component. Its members are spread over blocks by a hash. The members of its
largest component need no comparison with each other, so only the others (minor members) go to further blocks than their own: each
of them to all, where all members of that block wait. So rows grow with the members, and with blocks times minor members, not
with the square of a group of copies that is one component already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a row's role in its block: to be compared with the right rows, a right row, outside of the list's largest component.
LEFT, RIGHT, MINOR = 1, 2, 4


def open_lists(members: DataFrame, block: int, across: bool) -> DataFrame:
    """(list, major, xs, ys) of the open lists of ``members`` (list, node, component, weight): the largest component, blocks of its
    minor members and of all members, each of about the weight ``block``. across: False leaves out pairs of different blocks."""
    sums = members.groupBy("list", "component").agg(F.sum("weight").alias("w")).groupBy("list").agg(F.count("*").alias("parts"), F.sum("w").alias("w"), F.max(F.struct("w", "component")).alias("top"))
    blocks = lambda w: F.ceil(w / block).cast("int")
    return sums.filter("parts > 1").select("list", F.col("top.component").alias("major"), blocks(F.col("w")).alias("ys"), (blocks(F.col("w") - F.col("top.w")) if across else F.lit(1)).alias("xs"))


def places(across: bool):
    """For a row of ``node``, ``component``, ``list`` and the list's ``major``, ``xs``, ``ys``: an array of (x, y, role), the blocks it goes to."""
    minor = F.col("component") != F.col("major")
    # another spread for each list, so that members that miss each other in one meet in the next
    ownx, owny = F.pmod(F.xxhash64("node", "list", F.lit(1)), F.col("xs")).cast("int"), F.pmod(F.xxhash64("node", "list"), F.col("ys")).cast("int")
    role = lambda left: F.when(minor & left, F.lit(LEFT | RIGHT | MINOR)).when(minor, F.lit(RIGHT | MINOR)).otherwise(F.lit(RIGHT))
    found = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda x: F.struct(x.alias("x"), owny.alias("y"), role(x == ownx).alias("role")))
    if not across:
        return found
    others = F.filter(F.sequence(F.lit(0), F.col("ys") - 1), lambda y: y != owny)
    return F.concat(found, F.when(minor, F.transform(others, lambda y: F.struct(ownx.alias("x"), y.alias("y"), F.lit(LEFT | MINOR).alias("role")))).otherwise(F.slice(found, 1, 0)))
