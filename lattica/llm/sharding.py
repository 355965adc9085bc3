"""Sharding by a consistent-hash ring with virtual nodes and bounded loads [native].

A text's 64-bit hash is its place on a ring of 2^16 cells; each shard owns ``virtual`` points of it. A unit (the rows of one
cell, or one heavy text) goes to the first point clockwise whose shard still has room under the bound ``(1 + slack) *
total / shards``; what overflows continues clockwise. Equal texts share a place and so a shard, unless one text alone is
larger than the bound: it is split into the fewest pieces that fit.

The walk needs the units' sizes alone, at most 2^16 cells and, as each holds a fixed share of the total, a bounded number of
heavy texts: it runs on the driver over that bounded table, and the rows find their shard by a broadcast join with it. If no
shard has room (documents are indivisible), the least loaded takes the unit.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import hot

CELLS = 1 << 16
#: A text is heavy from this share of a shard's mean load; at most ``shards * HEAVY`` texts are.
HEAVY = 64
#: Rows of a unit numbered in one task.
RUN = 256


def points(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; a shard's points don't depend on the number of shards."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"{s}:{v}".encode()).digest()[:4], "big") % CELLS
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual))


@dataclass
class Ring:
    """Shards with bounded loads; ``seat`` walks clockwise from a cell."""

    shards: int
    virtual: int
    bound: int

    def __post_init__(self):
        self.points = points(self.shards, self.virtual)
        self.cells = [c for c, _ in self.points]
        self.loads = [0] * self.shards
        n = len(self.points)
        self.order = []
        for i in range(n):  # distinct shards clockwise from each point
            seen: dict[int, None] = {}
            j = i
            while len(seen) < self.shards and j < i + n:
                seen.setdefault(self.points[j % n][1])
                j += 1
            self.order.append(list(seen))

    def seat(self, cell: int, size: int) -> int:
        walk = self.order[bisect.bisect_left(self.cells, cell) % len(self.points)]
        shard = next((s for s in walk if self.loads[s] + size <= self.bound), None)
        if shard is None:
            shard = min(walk, key=lambda s: (self.loads[s], walk.index(s)))
        self.loads[shard] += size
        return shard


def cell_of(mark):
    return F.shiftrightunsigned(mark, 48).cast("int")


def place(docs: DataFrame, shards: int = 40, virtual: int = 64, slack: float = 0.0005, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with size, text_crc32, shard and slot (gapless from 0 in each shard).

    Size: UTF-8 bytes of the text plus 16. A null text counts as empty (crc32 0) and shares the empty text's place. Repeated
    rows and ties are numbered in an order of key, then text hash; rows equal in both are interchangeable and, if too many for a
    task, divided (``hot``). An empty table gives an empty result. All input columns are kept; those with names of the result's
    own are replaced.
    """
    spark = docs.sparkSession
    own = ["size", "text_crc32", "shard", "slot"]
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(
        F.struct(*[c for c in docs.columns if c not in own]).alias("row"), F.col(key).alias("key"),
        (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("mark"),
    ).withColumn("cell", cell_of(F.col("mark")))
    rows, narrow = named.withColumn("turn", F.lit(0)), named.select("key", "size", "mark", "cell", F.lit(0).alias("turn"))

    cells = {r[0]: [r[1], r[2]] for r in narrow.groupBy("cell").agg(F.sum("size"), F.count("*")).collect()}  # at most CELLS rows
    total = sum(b for b, _ in cells.values())
    many = [(c,) for c, (_, n) in cells.items() if n > hot.HOT]
    if many:  # a group of rows equal in key and text can't be larger than its cell
        wanted = F.broadcast(spark.createDataFrame(many, "cell int"))
        divided = hot.divided(named, ["key", "mark"], named.select("key", "mark", "cell").join(wanted, "cell"))
        if divided is not None:
            rows = divided.withColumn("turn", F.coalesce("turn", F.lit(0)))
            narrow = rows.select("key", "size", "mark", "cell", "turn")
    heavy_from = max(1, total // (shards * HEAVY))
    ring = Ring(shards, virtual, int(total / shards * (1 + slack)))

    full = [c for c, (b, _) in cells.items() if b >= heavy_from]
    heavy = []
    if full:  # at most shards * HEAVY cells, and as many texts
        wanted = F.broadcast(spark.createDataFrame([(c,) for c in full], "cell int"))
        heavy = narrow.join(wanted, "cell").groupBy("cell", "mark").agg(F.sum("size"), F.count("*")).filter(F.col("sum(size)") >= heavy_from).collect()
    units = []  # cell, mark (null: the rest of the cell), piece, pieces, bytes, rows
    split = {m: -(-b // max(1, ring.bound)) for _, m, b, _ in heavy if b > ring.bound}
    if split:
        cut = F.broadcast(spark.createDataFrame(list(split.items()), "mark long, pieces int"))
        piece = F.pmod(F.xxhash64("key", "turn"), F.col("pieces")).cast("int")
        for c, m, p, k, b, n in narrow.join(cut, "mark").withColumn("piece", piece).groupBy("cell", "mark", "piece", "pieces").agg(F.sum("size"), F.count("*")).collect():
            units.append((c, m, p, k, b, n))
    for c, m, b, n in heavy:
        cells[c][0] -= b
        cells[c][1] -= n
        if m not in split:
            units.append((c, m, 0, 1, b, n))
    units.sort(key=lambda u: (-u[4], u[0], u[1], u[2]))
    units += sorted((c, None, 0, 1, b, n) for c, (b, n) in cells.items() if n)
    runs = max(RUN, 4 * sum(u[5] for u in units) // CELLS)
    seated = [(i, c, m, p, k, ring.seat(c, b), max(1, -(-n // runs))) for i, (c, m, p, k, b, n) in enumerate(units)]

    texts = spark.createDataFrame([(m, k, p, i, s, r) for i, c, m, p, k, s, r in seated if m is not None], "mark long, pieces int, piece int, unit int, shard int, runs int")
    rest = spark.createDataFrame([(c, i, s, r) for i, c, m, _, _, s, r in seated if m is None], "cell int, unit int, shard int, runs int")
    pieces = texts.select("mark", "pieces").distinct()
    texts = texts.select(F.col("mark").alias("m"), F.col("piece").alias("p"), F.struct("unit", "shard", "runs").alias("a"))
    rest = rest.select(F.col("cell").alias("c"), F.struct("unit", "shard", "runs").alias("b"))

    def seat(df: DataFrame) -> DataFrame:
        split = df.join(F.broadcast(pieces), "mark", "left")
        piece = F.pmod(F.xxhash64("key", "turn"), F.col("pieces")).cast("int")
        seat = F.coalesce(F.col("a"), F.col("b"))
        return (
            split.join(F.broadcast(texts), (F.col("mark") == F.col("m")) & (piece == F.col("p")), "left")
            .join(F.broadcast(rest), F.col("cell") == F.col("c"), "left")
            .withColumn("unit", seat["unit"]).withColumn("shard", seat["shard"])
            .withColumn("run", F.pmod(F.xxhash64("key", "mark", "turn", F.lit(7)), seat["runs"]).cast("int"))
        )

    ahead = Window.partitionBy("shard").orderBy("unit", "run").rowsBetween(Window.unboundedPreceding, -1)
    starts = seat(narrow).groupBy("shard", "unit", "run").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    starts = F.broadcast(starts.select(F.col("unit").alias("u"), F.col("run").alias("r"), "start"))  # at most units + rows / runs
    number = F.row_number().over(Window.partitionBy("unit", "run").orderBy("key", "mark")) - 1
    return (
        seat(rows).withColumn("number", number)
        .join(starts, (F.col("unit") == F.col("u")) & (F.col("run") == F.col("r")))
        .select("row.*", "size", "text_crc32", "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"))
    )
