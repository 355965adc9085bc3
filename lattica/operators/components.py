"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import cut

#: Up to so many edges (16 bytes each) are solved in one task; beyond, rounds of contraction make them fewer.
LOCAL = 1 << 21


def flatten(parents: DataFrame) -> DataFrame:
    """(node, parent) as (node, root): pointer jumping, a cut a step. parent <= node; a root is its own parent."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        jumped = cut(parents.join(up, "parent").select("node", F.col("root").alias("parent"), (F.col("root") < F.col("parent")).alias("moved")))
        done = jumped.filter("moved").isEmpty()
        parents = jumped.select("node", "parent")
        if done:
            return parents


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of edges in memory: every root hooks to the smallest root next to it, then
    pointers jump, until all edges lie within a component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        rx, ry = up[x], up[y]
        apart = rx != ry
        if not apart.any():
            return nodes, nodes[up]
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(up, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            jumped = up[up]
            if np.array_equal(jumped, up):
                break
            up = jumped


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of a partition as stars, a batch at a time: the same components from fewer edges."""
    for batch in batches:
        if batch.num_rows:
            node, root = roots(batch.column("a").to_numpy(), batch.column("b").to_numpy())
            on = node != root
            yield pa.RecordBatch.from_arrays([pa.array(root[on]), pa.array(node[on])], ["a", "b"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if held:
        node, root = roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame, u: str = "u", v: str = "v", local: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Each task first turns its edges into stars. While more than ``local`` edges are left (``LOCAL``), a round hooks every node to its
    smallest neighbour, flattens the trees by pointer jumping and contracts the edges; what is left then is solved in one task, whose
    memory the count bounds. Rounds and jumps grow with the logarithm of a component's size, also on long chains; all state is in
    tables on shared storage. Minima are pre-aggregated, so a hub costs one row a task.
    """
    local = LOCAL if local is None else local
    left = edges.select(F.least(u, v).cast("long").alias("a"), F.greatest(u, v).cast("long").alias("b")).filter("a is not null")
    own = cut(left)
    left = own.filter("a < b").mapInArrow(_forest, "a long, b long")
    left = cut(left.distinct())
    rest, moves = left.count(), []
    while rest > local:
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e"))
        hooked = both.groupBy("e.node").agg(F.least(F.min("e.to"), F.first("e.node")).alias("parent"))
        moves.append(flatten(cut(hooked)).withColumnRenamed("parent", "root"))
        to = lambda name: moves[-1].select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
        left = left.join(to("a"), "a").join(to("b"), "b").filter("ra <> rb")
        left = cut(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        rest = left.count()
    if rest:
        moves.append(cut(left.coalesce(1).mapInArrow(_solve, "node long, root long")))
    labels = own.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    for move in moves:
        labels = labels.join(move.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return cut(labels)
