"""MinHash near-dedup by an inverted join on signature coordinates.

Documents with equal shingle sets form one class (a 128-bit key of the set), so copies cost one row each. Every class, not every
doc_id, is a node: rows that repeat a doc_id with different texts are different nodes. Each node carries K MinHash coordinates.
Each (coordinate, value) pair is a posting list; two nodes collide once for each list both are in.

Prefix: two nodes with T of K collisions share at least one of the K - T + 1 rarest coordinates of either, in an order of
rarity common to all. So lists of one node are dropped, a node with fewer than T shared coordinates is skipped, and the rest post
under their rarest coordinates only; frequent lines and passages come last and mostly aren't posted.

Skip merging: lists whose members are all in one component are skipped. Of the others, the members are compared by their whole
signatures in blocks (``blocks``), each pair in the first list that both are posted in. Those with a partner above the match threshold
in another component go, with their texts, to the task that verifies them; there a union-find over the group's components skips
what is joined already, best partners first, and only links that join two components leave the task. So neither candidates nor
links of a group of near copies are ever rows: a list of m members gives m - 1 links at most. The first round takes the ``WIDE``
largest lists of each node, each block by itself; the second all lists that are still open, with the pairs of different blocks. So
no pair that could join two components is left out.

The posted coordinates are K = 64 with T = 32; whole signatures have ``MORE`` = 128 further ones (a byte each) and a threshold of
``TOTAL`` = 120 of 192. Two documents at similarity 0.75 fall below T with a probability of about 2e-6, below the other with 2e-5
(binomial tails). Verification reads both full texts and compares the full shingle sets: 100 * intersection >= 75 * union.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import blocks, bytewords
from lattica.llm.blocks import LEFT, MINOR, RIGHT
from lattica.operators.components import components, roots
from lattica.session import cut

COORDINATES = 64
MATCHES = 32
MORE = 128
TOTAL = 120
#: The first round takes so many lists of each node, the largest.
WIDE = 4
#: A block has members of this weight; a member weighs 1 for every ``HEAVY`` shingles begun. So a block has 4 MB of shingles, give or take.
BLOCK = 1024
HEAVY = 512
#: Texts to verify are found by a broadcast of their keys up to this many (24 bytes each), by a shuffle beyond.
BROADCAST_IDS = 2_000_000
_NO_ID = -(1 << 63)


def _signatures(shingle: int, coordinates: int):
    a, b = bytewords.seeds(coordinates + MORE, 41), bytewords.seeds(coordinates + MORE, 43)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bytewords.pieces(whole, "text"):
                s, at = bytewords.distinct(*bytewords.shingles(*bytewords.words(batch.column("text")), shingle))
                n, full = np.diff(at), np.flatnonzero(np.diff(at))
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(bytewords.mix(s + c), dtype=np.uint64)]) for c in bytewords.seeds(2, 31)]
                k1, k2 = ((x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums)
                sig, more = np.zeros((batch.num_rows, coordinates), np.int32), np.zeros((batch.num_rows, MORE), np.uint8)
                step = 1 << 16
                i = 0
                while i < len(full):  # documents in blocks of about 2^16 shingles
                    j = max(i + 1, int(np.searchsorted(at[full], at[full[i]] + step)))
                    lo, hi = at[full[i]], at[full[j - 1] + 1]
                    part, heads = s[lo:hi], at[full[i:j]] - lo
                    for k in range(coordinates + MORE):
                        low = np.minimum.reduceat(part * a[k] + b[k], heads)
                        if k < coordinates:
                            sig[full[i:j], k] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
                        else:
                            more[full[i:j], k - coordinates] = (bytewords.mix(low) >> np.uint64(56)).astype(np.uint8)
                    i = j
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, coordinates, dtype=np.int32)), pa.array(sig.ravel()))
                packed = pa.Array.from_buffers(pa.binary(), len(more), [None, pa.py_buffer(np.arange(0, more.size + 1, MORE, dtype=np.int32)), pa.py_buffer(more.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), flat, packed], ["doc_id", "mark", "n", "k1", "k2", "sig", "more"])

    return run


def _table(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: batch.column(c).to_numpy() for c in ("list", "x", "y", "role", "node", "component")}
    out["mask"] = batch.column("mask").to_numpy().view(np.uint64)
    out["sig"] = batch.column("sig").flatten().to_numpy().reshape(batch.num_rows, -1)
    out["more"] = np.frombuffer(b"".join(batch.column("more").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return out


def _alike(block: dict[str, np.ndarray], total: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, collisions) of a block: pairs of different components with enough collisions whose first list in common is this
    one; some left rows at a time. Two members outside of the largest component meet twice and are paired the first time."""
    node, component, sig, more, mask, role = (block[c] for c in ("node", "component", "sig", "more", "mask", "role"))
    here, right = int(block["list"][0] >> 32), np.flatnonzero(role & RIGHT)
    left, minor = np.flatnonzero(role & LEFT), (role[right] & MINOR) > 0
    for i in range(0, len(left) if len(right) else 0, 256):
        p = left[i : i + 256]
        if len(p) * len(right) < 2000:
            hits = (sig[p][:, None] == sig[right][None]).sum(2) + (more[p][:, None] == more[right][None]).sum(2)
        else:
            hits = np.zeros((len(p), len(right)), np.int16)
            for columns in (sig, more):
                for k in range(columns.shape[1]):
                    hits += columns[p, k][:, None] == columns[right, k][None, :]
        on = (hits >= total) & (component[p][:, None] != component[right][None, :]) & (~minor[None, :] | (node[p][:, None] < node[right][None, :]))
        a, b = np.nonzero(on)
        n, a, b = hits[a, b], p[a], right[b]
        shared = (sig[a] == sig[b]) & ((((mask[a] & mask[b])[:, None] >> np.arange(sig.shape[1], dtype=np.uint64)[None, :]) & np.uint64(1)) == 1)
        first = shared.argmax(1) == here
        yield a[first], b[first], n[first]


_BLOCK = "list long, x int, y int, sub long, role int, node long, component long, mask long, sig array<int>, more binary"


def _partners(total: int):
    """Rows in order of list, x, y -> those with a partner, ``sub`` being the group of all that partners connect. One block is held
    at a time."""

    def out(block: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x, y, _ in _alike(block, total):
            if len(x):
                node, root = roots(np.concatenate([a, x]), np.concatenate([b, y]))  # stars: no more than a row a member
                a, b = root, node
        if not len(a):
            return None
        n, k = len(b), block["sig"].shape[1]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(block["sig"][b].ravel()))
        packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * MORE + 1, MORE, dtype=np.int32)), pa.py_buffer(block["more"][b].tobytes())])
        columns = [pa.array(block["list"][b]), pa.array(block["x"][b]), pa.array(block["y"][b]), pa.array(a), pa.array(block["role"][b]), pa.array(block["node"][b]), pa.array(block["component"][b]), pa.array(block["mask"][b].view(np.int64)), flat, packed]
        return pa.RecordBatch.from_arrays(columns, ["list", "x", "y", "sub", "role", "node", "component", "mask", "sig", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def done():
            block = {c: np.concatenate([h[c] for h in held]) if len(held) > 1 else held[0][c] for c in held[0]}
            held.clear()
            return out(block)

        for batch in batches:
            if not batch.num_rows:
                continue
            now, found = _table(batch), []
            moved = (np.diff(now["list"]) != 0) | (np.diff(now["x"]) != 0) | (np.diff(now["y"]) != 0)
            edges = np.concatenate([[0], np.flatnonzero(moved) + 1, [batch.num_rows]])
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                part = {c: v[i:j] for c, v in now.items()}
                if held and any(held[0][c][0] != part[c][0] for c in ("list", "x", "y")):
                    found.append(done())
                held.append(part)
            yield from (f for f in found if f is not None)
        if held and (last := done()) is not None:
            yield last

    return run


def _links(group: list[dict], sets: list[np.ndarray], total: int, percent: int) -> list[tuple[int, int]]:
    """Of the members of a group, with their shingle sets, the links that join two components; partners with most collisions first."""
    block = {c: np.concatenate([g[c] for g in group]) for c in group[0]}
    size = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(size)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own, label, found = np.zeros(int(ids.max(initial=-1)) + 1, bool), np.unique(block["component"], return_inverse=True)[1], []
    for a, b, n in _alike(block, total):
        order = np.lexsort((-n, a))
        a, b = a[order], b[order]
        for i, j in zip(heads := np.flatnonzero(np.diff(a, prepend=-1)), np.append(heads[1:], len(a)), strict=True):
            me, others, step = a[i], b[i:j], 4
            own[ids[ends[me] - size[me] : ends[me]]] = True
            while len(others := others[label[others] != label[me]]):
                now, others, step = others[:step], others[step:], 64
                m = size[now]
                at = np.repeat(ends[now] - np.cumsum(m), m) + np.arange(m.sum())
                both = np.add.reduceat(own[ids[at]], np.cumsum(m) - m, dtype=np.int64)
                for k in now[100 * both >= percent * (size[me] + m - both)]:
                    if label[k] != label[me]:
                        label[label == label[k]] = label[me]
                        found.append((int(block["node"][me]), int(block["node"][k])))
            own[ids[ends[me] - size[me] : ends[me]]] = False
    return found


def _verify(shingle: int, total: int, percent: int):
    """Rows in order of list, x, y, sub, with texts -> (u, v): links that join two components of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, sets = None, [], []
        for whole in batches:
            for batch in bytewords.pieces(whole, "text"):
                if not batch.num_rows:
                    continue
                s, at = bytewords.distinct(*bytewords.shingles(*bytewords.words(batch.column("text")), shingle))
                now, sub, found = _table(batch), batch.column("sub").to_numpy(), []
                moved = (np.diff(now["list"]) != 0) | (np.diff(now["x"]) != 0) | (np.diff(now["y"]) != 0) | (np.diff(sub) != 0)
                edges = np.concatenate([[0], np.flatnonzero(moved) + 1, [batch.num_rows]])
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    mine = tuple(now[c][i] for c in ("list", "x", "y")) + (sub[i],)
                    if group and key != mine:
                        found += _links(group, sets, total, percent)
                        group, sets = [], []
                    key = mine
                    group.append({c: v[i:j] for c, v in now.items()})
                    sets += [s[at[k] : at[k + 1]].copy() for k in range(i, j)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])
        if group and (found := _links(group, sets, total, percent)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"])

    return run


def _with_texts(wanted: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (node, ...) with the node's text: that of the row whose key it is."""
    keys = cut(rows.select(F.col("at").alias("node"), "id_", "mark").join(wanted.select("node").distinct(), "node"))
    small = F.broadcast if keys.count() <= BROADCAST_IDS else (lambda x: x)
    texts = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id_"), F.xxhash64("text").alias("mark"), "text").join(small(keys), ["id_", "mark"])
    return wanted.join(texts.select("node", "text").dropDuplicates(["node"]), "node")  # rows equal in both are copies


def link(docs: DataFrame, shingle: int = 5, percent: int = 75, matches: int = MATCHES, total: int = TOTAL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links) of ``docs`` (doc_id, text).

    rows: (doc_id, n, k1, k2) a row for each row of ``docs``. classes: (k1, k2, node, rep) a row for each shingle set that isn't empty; rep is its
    smallest doc_id. links: (u, v), links of nodes that connect every component: verified pairs, and classes that share a doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(_signatures(shingle, COORDINATES), "doc_id long, mark long, n long, k1 long, k2 long, sig array<int>, more binary")
    rows = cut(made.withColumn("at", F.monotonically_increasing_id()).withColumn("id_", F.coalesce("doc_id", F.lit(_NO_ID))))
    classes = cut(rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("at").alias("node"), F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    signed = rows.join(classes.filter("n > 1").select(F.col("node").alias("at")), "at", "left_semi").select(F.col("at").alias("node"), "n", "sig", "more")

    # posting lists: (coordinate, value) in one long
    posts = signed.select("node", "n", F.posexplode("sig").alias("k", "value")).select("node", "n", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("value").bitwiseAND(F.lit(0xFFFFFFFF))).alias("list"))
    shared = posts.groupBy("list").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = posts.join(shared, "list").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "list"))).alias("lists"))
    keep = F.size("lists") - F.lit(matches - 1)  # the rarest K - T + 1, less the lists of one node
    kept = ranked.filter(keep > 0).select("node", "n", F.transform(F.slice("lists", F.lit(1), keep), lambda p: p["list"]).alias("lists"))
    # the posted coordinates as bits: a pair is judged in the first list that both are posted in
    bit = lambda acc, p: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(p, 32).cast("int")))
    masks = [F.aggregate(x, F.lit(0).cast("long"), bit) for x in (F.col("lists"), F.slice("lists", F.greatest(F.lit(1), F.size("lists") - (WIDE - 1)), F.lit(WIDE)))]
    weight = F.ceil(F.col("n") / HEAVY).cast("int").alias("weight")
    posted = kept.select("node", weight, masks[0].alias("mask"), masks[1].alias("wide_mask"), F.size("lists").alias("n"), F.posexplode("lists").alias("at", "list"))
    posted = cut(posted.select("node", "weight", "mask", "wide_mask", "list", (F.col("at") >= F.col("n") - WIDE).alias("wide")))

    # classes that share a doc_id
    ids = rows.filter("n > 0 and doc_id is not null").join(classes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node")
    twice = ids.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("hi")).filter("u <> hi").select("doc_id", "u")
    links = cut(ids.join(twice, "doc_id").filter("u <> node").select("u", F.col("node").alias("v")).distinct())

    for wide in (True, False):
        found = components(links)
        members = (posted.filter("wide").withColumn("mask", F.col("wide_mask")) if wide else posted).select("node", "weight", "mask", "list")
        at = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_lists = blocks.open_lists(at, BLOCK, across=not wide)
        sides = (
            at.join(open_lists, "list").select("node", "component", "mask", F.struct("list", blocks.places(across=not wide).alias("places")).alias("p"))
            .groupBy("node", "component", "mask").agg(F.collect_list("p").alias("lists"))
            .join(signed.drop("n"), "node")  # a row a node; its lists come apart after it
            .withColumn("p", F.explode("lists")).withColumn("q", F.explode("p.places"))
            .select("p.list", "q.x", "q.y", "q.role", "node", "component", "mask", "sig", "more")
        )
        sides = sides.repartition("list", "x", "y").sortWithinPartitions("list", "x", "y")
        wanted = cut(sides.mapInArrow(_partners(total), _BLOCK))
        order = ["list", "x", "y", "sub"]
        groups = _with_texts(wanted, rows, docs).repartition(*order).sortWithinPartitions(*order)
        links = cut(links.union(groups.mapInArrow(_verify(shingle, total, percent), "u long, v long")))
    return rows.select("doc_id", "n", "k1", "k2"), classes.drop("n"), links


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Null, empty and blank texts have no shingles and are linked with nothing; texts of fewer words than a shingle count as one
    shingle, so they are linked with equals only. Rows that repeat a doc_id with the same text share a class; with different
    texts each has its own class, and a link of any of them counts for that doc_id, which joins their components. A null doc_id gets the component of
    its class (null, if no member of that has a doc_id) and is not kept. An empty table gives an empty result.
    """
    rows, classes, links = link(docs, shingle, percent)
    found = components(links)
    least = found.join(classes, "node").groupBy("component").agg(F.min("rep").alias("least"))
    named = classes.join(found.join(least, "component").select("node", "least"), "node", "left").select("k1", "k2", F.coalesce("least", "rep").alias("least"))
    return (
        rows.join(named, ["k1", "k2"], "left")
        .withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component (all rows that repeat its doc_id) and all rows without a
    doc_id, which nothing could name. Columns as before."""
    stays = dedup(docs.select("doc_id", "text"), shingle, percent).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").cast("long").alias("__id"))
    kept = rows.join(stays, "__id", "left_semi").select("__row.*")
    return kept.union(docs.filter("doc_id is null"))
