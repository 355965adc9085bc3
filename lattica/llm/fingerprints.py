"""Document fingerprints by a randomised edit embedding.

The embedding of a string is the trace of a random walk over it: at step j the walk reads the character under its pointer and
moves on by ``r_j(character)``, 0 or 1, with random bits ``r`` shared by all documents; 2 n steps lead over n characters. Walks
over two strings that differ by few edits fall into step again after each edit, so edit distance becomes Hamming distance
between the traces. A walk goes over the whole text, so order counts; only texts longer than ``SHORTEST`` characters are cut into
segments, each walked from its start, where the hash of a few characters says so (and after ``LONGEST`` at the latest), which any
two documents do alike around the same characters.

A fingerprint has ``PLACES`` times ``WALKS`` bytes. A place is a step of the trace: of all units of ``UNIT`` steps of all segments
the one of smallest hash, and in it the step of smallest hash, so that it seldom depends on a text's length. Each of ``WALKS``
independent walks writes there a byte of the four characters under its pointer. An edit throws the walks off at different
lengths, so two texts agree in a place if one of the walks agrees; ``likeness`` is the share of text in common that the share a of
such places stands for, 2a / (1 + a), less what chance gives.

``near_groups`` finds similar documents: bands of bits, sampled from one walk each, are posting lists; members of a list that lie in
different components are compared by their whole fingerprints in blocks (``blocks``), and links that join components are kept.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import blocks, bytewords
from lattica.llm.bytewords import mix, seeds
from lattica.operators.components import components
from lattica.session import cut, drop, written

PLACES, WALKS = 64, 4
SLOTS = PLACES * WALKS
UNIT = 512
#: A text is cut at characters that one in ``EVERY`` runs of ``WINDOW`` names, into segments of so many characters.
WINDOW, EVERY, SHORTEST, LONGEST = 8, 512, 3072, 5120
#: A band has so many places of one walk; there are PLACES / BAND bands.
BAND = 4
#: Fingerprints of one band that are compared in one block.
BLOCK = 1024
#: Documents in groups are broadcast up to this many (40 bytes each); beyond, Spark shuffles.
BROADCAST = 1_000_000
#: Bytes of text that a part of the order of documents holds, and the most parts.
PART, MOST_PARTS = 4 << 20, 1 << 14
_LAST = -(1 << 63)
#: Agreement of unrelated places: one of the walks' bytes is equal by chance.
_CHANCE = 1 - (255 / 256) ** WALKS


@lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """steps[p, n]: the step that place p samples of a unit of n steps, the one of smallest hash."""
    h = mix(seeds(PLACES, 71)[:, None] * np.arange(1, UNIT + 1, dtype=np.uint64)[None, :])
    low = np.minimum.accumulate(h, axis=1)
    at = np.maximum.accumulate(np.where(h == low, np.arange(UNIT), 0), axis=1)
    return np.concatenate([np.zeros((PLACES, 1), np.int64), at], axis=1)


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """moves[j // 64, walk, kind of character]: 64 steps' bits."""
    n = 2 * LONGEST // 64
    return mix(np.arange(n * WALKS * 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(977)).reshape(n, WALKS * 256)


def _kinds(points: np.ndarray) -> np.ndarray:
    """One of 256 kinds of each character."""
    return (points * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def _segments(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, anchors) of all segments; every document that isn't empty starts one."""
    starts, anchors = [], []
    long = np.flatnonzero(np.diff(offsets) > SHORTEST)
    for d in np.flatnonzero(np.diff(offsets) > 0):
        starts.append(offsets[d])
        anchors.append(1)
        if len(long) and d == long[0]:
            long = long[1:]
            lo, n = int(offsets[d]), int(offsets[d + 1] - offsets[d])
            h = np.zeros(n - WINDOW + 1, np.uint64)
            for k, c in enumerate(seeds(WINDOW, 83)):
                h += points[lo + k : lo + k + len(h)].astype(np.uint64) * c
            h = mix(h)
            named, at, nth = np.flatnonzero(h % np.uint64(EVERY) == 0), 0, 1
            while n - at > SHORTEST:
                i = np.searchsorted(named, at + SHORTEST)
                at = int(min(named[i] if i < len(named) else n, at + LONGEST))
                if at >= n:
                    break
                starts.append(lo + at)
                anchors.append(int(h[at]) if at < len(h) else nth)
                nth += 1
    return np.array(starts, np.int64), np.array(anchors, np.uint64)


def _pointers(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: np.ndarray, step: np.ndarray) -> np.ndarray:
    """pointers[i, walk]: where each walk over segment ``lane[i]`` stands before ``step[i]``; all segments walk together."""
    out = np.empty((len(lane), WALKS), np.int64)
    if not len(lane):
        return out
    used, lane = np.unique(lane, return_inverse=True)
    steps = np.zeros(len(used), np.int64)
    np.maximum.at(steps, lane, step + 1)
    order = np.argsort(-steps, kind="stable")
    rank = np.empty(len(used), np.int64)
    rank[order] = np.arange(len(used))
    lane, live = rank[lane], np.searchsorted(-steps[order], -np.arange(steps.max()), "left")
    code = np.concatenate([_kinds(points), np.zeros(2 * LONGEST + 1, np.uint8)])
    at = np.repeat(starts[used][order][:, None], WALKS, 1)
    kind, moved, byte = np.empty_like(at), np.empty_like(at), np.empty(at.shape, np.uint8)
    by_step = np.argsort(step, kind="stable")
    ends_at = np.searchsorted(step[by_step], np.arange(len(live) + 1))
    first = np.arange(WALKS) * 256
    for j in range(len(live)):
        wanted = by_step[ends_at[j] : ends_at[j + 1]]
        if len(wanted):
            out[wanted] = at[lane[wanted]]
        if j % 64 == 0:
            words = _moves()[j // 64]
        bits = ((words >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        n = live[j]
        code.take(at[:n], out=byte[:n], mode="clip")
        np.add(byte[:n], first, out=kind[:n])
        bits.take(kind[:n], out=moved[:n], mode="clip")
        at[:n] += moved[:n]
    return np.minimum(out, (ends[used][order] - 1)[lane][:, None])


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of SLOTS bytes for each text, a place's walks together; zeros for an empty one."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    total, i = np.cumsum(size), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 21), "right")))
        points = np.frombuffer("".join(texts[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points):
            out[i:j] = _fingerprints(points, np.concatenate([[0], np.cumsum(size[i:j])]))
        i = j
    return out


def _fingerprints(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, SLOTS), np.uint8)
    full = np.flatnonzero(np.diff(offsets))
    starts, anchors = _segments(points, offsets)
    ends = np.append(starts[1:], len(points))
    units = -(-2 * (ends - starts) // UNIT)
    before = np.concatenate([[0], np.cumsum(units)])
    segment = np.repeat(np.arange(len(starts)), units)
    nth = np.arange(before[-1]) - before[segment]
    key = mix(anchors[segment] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    width = np.minimum(UNIT, 2 * (ends - starts)[segment] - nth * UNIT)
    bits = np.uint64(max(1, int(len(key)).bit_length()))
    number, heads = np.arange(len(key), dtype=np.uint64), before[np.searchsorted(starts, offsets[full])]
    lane, step = np.empty((2, len(full), PLACES), np.int64)
    for p, c in enumerate(seeds(PLACES, 61)):
        low = np.minimum.reduceat((mix(key * c) >> bits << bits) | number, heads)
        unit = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        lane[:, p], step[:, p] = segment[unit], nth[unit] * UNIT + _steps()[p, width[unit]]
    at = _pointers(points, starts, ends, lane.ravel(), step.ravel())
    last = np.repeat(offsets[full + 1] - 1, PLACES)[:, None]
    seen = np.zeros(at.shape, np.uint64)
    for k, c in enumerate(seeds(4, 67)):
        on = at + k <= last
        seen += np.where(on, points[np.minimum(at + k, last)].astype(np.uint64) + np.uint64(1), np.uint64(0)) * c
    out[full] = (mix(seen) >> np.uint64(56)).astype(np.uint8).reshape(len(full), SLOTS)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 to 1 for each row of x and y; 1 for equal fingerprints."""
    places = (x == y).reshape(*np.broadcast_shapes(x.shape, y.shape)[:-1], PLACES, WALKS).any(-1).mean(-1)
    a = np.maximum(0, (places - _CHANCE) / (1 - _CHANCE))
    return 2 * a / (1 + a)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of ``text`` replaced by as many first characters of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(bounds: list[tuple[int, int]], heads: dict[tuple[int, int], list[int]] | None):
    """Rows with their part, in order of falling key, then mark. Rows of a pair that is a bound several times take turns in the
    parts it begins, as they are all alike. heads: (key, mark) -> parts that a row of that pair follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip((~batch.column("key").to_numpy()).tolist(), batch.column("mark").to_pylist(), strict=True))
            part = np.empty(len(rows), np.int32)
            for i, r in enumerate(rows):
                lo, hi = bisect.bisect_left(bounds, r), bisect.bisect_right(bounds, r)
                part[i] = hi if hi - lo < 2 else lo + 1 + turn % (hi - lo)
                turn += hi - lo >= 2
            if heads is None:
                yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("key"), batch.column("mark")], ["part", "key", "mark"])
                continue
            names = ["part", "halo", *batch.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(part), np.int32)), *batch.columns], names)
            seen = set()
            for i, r in enumerate(rows):
                if r in heads and r not in seen:
                    seen.add(r)
                    for p in heads[r]:
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([1], pa.int32()), *batch.slice(i, 1).columns], names)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, halo, key (descending), mark -> the result. The row before waits for the one after it."""
    held = None  # part, halo, doc_id, mark, text, fingerprint

    def done(rows):
        changed = [edited(r[4], n[4]) for r, n in rows]
        own, after, new = np.stack([r[5] for r, _ in rows]), np.stack([n[5] for _, n in rows]), fingerprints(changed)
        return pa.RecordBatch.from_arrays([
            pa.array([r[2] for r, _ in rows], pa.int64()), pa.array([r[3] for r, _ in rows], pa.int64()), pa.array([len(r[4]) for r, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array([x.tobytes().hex() for x in own]), pa.array([x.tobytes().hex() for x in new]),
            pa.array(likeness(own, new)), pa.array(likeness(own, after)),
        ], ["doc_id", "mark", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for whole in batches:
        for batch in bytewords.pieces(whole, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            prints = fingerprints(texts)
            ready = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "halo", "doc_id", "mark")), texts, prints, strict=True):
                if held is not None and held[0] == row[0] and not held[1]:
                    ready.append((held, row))
                held = row
            if ready:
                yield done(ready)


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, mark, text): key is the doc_id, or one below all for null; mark a hash of the text."""
    id_, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(id_, F.lit(_LAST)).alias("key"), id_.alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def compare_next(docs: DataFrame, parts: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness: a row for each row of ``docs`` (doc_id, text). With
    ``groups`` (of ``near_groups``) also near_class: the smallest doc_id of the document's group, or its own.

    The next document is the next in descending doc_id, after the last the first; a null doc_id comes last, rows that repeat one
    follow each other in an order of their texts' hash. A single document is its own next. Null texts are empty; empty ones
    have a fingerprint of zeros. Ranges of that order, of about equal rows and about ``PART`` bytes (``MOST_PARTS`` at most), go to
    one part each, found from a sample of the keys; equal rows can be split between parts. The first row of the next part goes along.
    """
    rows = _keyed(docs)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = parts or max(1, min(MOST_PARTS, -(-size // PART)))
    some = rows.select(F.bitwise_not("key").alias("key"), "mark").sample(min(1.0, 40 * parts / max(n, 1)), 7).toArrow()  # about 40 a part
    key, mark = some["key"].to_numpy(), some["mark"].to_numpy()
    order = np.lexsort((mark, key))[[i * len(key) // parts for i in range(1, parts)]] if len(key) else []
    bounds = [(int(key[i]), int(mark[i])) for i in order]
    first = {r.part: (~r.k, r.m) for r in rows.select("key", "mark").mapInArrow(_dealt(bounds, None), "part int, key long, mark long").groupBy("part").agg(F.max("key").alias("k"), F.min_by("mark", F.struct(F.bitwise_not("key").alias("k"), "mark")).alias("m")).collect()}
    full = sorted(first)  # at most ``parts``
    heads: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(full):
        heads.setdefault(first[full[(i + 1) % len(full)]], []).append(p)
    dealt = rows.mapInArrow(_dealt(bounds, heads), "part int, halo int, key long, doc_id long, mark long, text string")
    dealt = dealt.repartition(max(1, parts // 4), "part").sortWithinPartitions("part", "halo", F.desc("key"), "mark", "text")
    result = "doc_id long, mark long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    found = dealt.select("part", "halo", "doc_id", "mark", "text").mapInArrow(_compare, result)
    if groups is None:
        return found.drop("mark")
    groups = groups.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "near_class")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))
    found = found.join(F.broadcast(groups) if groups.count() <= BROADCAST else groups, same, "left")
    return found.withColumn("near_class", F.coalesce("near_class", "doc_id")).drop("mark", "d", "m")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in bytewords.pieces(whole, "text"):
            found = [x.tobytes() for x in fingerprints([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(found, pa.binary())], ["doc_id", "mark", "print"])


def _joining(least: float):
    """Rows (list, x, y, role, node, component, print) in order of list, x, y -> (u, v, near): of each block, verified links that
    join two components. A block is held at a time."""

    def links(block: list[tuple]) -> Iterator[tuple[int, int, float]]:
        role, node = np.array([r[3] for r in block]), np.array([r[4] for r in block])
        label = np.unique([r[5] for r in block], return_inverse=True)[1]
        prints = np.frombuffer(b"".join(r[6] for r in block), np.uint8).reshape(-1, SLOTS)
        right = np.flatnonzero(role & blocks.RIGHT)
        minor = (role[right] & blocks.MINOR) > 0
        for i in np.flatnonzero(role & blocks.LEFT):
            others = right[(label[right] != label[i]) & (~minor | (node[i] < node[right]))]
            near = likeness(prints[i][None, :], prints[others])
            for k in np.argsort(-near, kind="stable"):
                j = others[k]
                if near[k] < least:
                    break
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    yield min(node[i], node[j]), max(node[i], node[j]), float(near[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(block):
            found = list(links(block))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["u", "v", "near"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("list", "x", "y", "role", "node", "component", "print")), strict=True):
                if held and held[0][:3] != row[:3]:
                    yield from out(held)
                    held = []
                held.append(row)
        if held:
            yield from out(held)

    return run


def near_links(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(u, v, near) of ``prints`` (node, print): links that connect all that pairs connect which share a band and are that alike by
    their whole fingerprints. The first round compares, block by block, the members of the first band of each walk, the second
    those of all bands that are still in different components. A group of copies gives some rows a member, not all its pairs."""
    order = [p * WALKS + i % WALKS for i in range(PLACES // BAND) for p in range(i * BAND, (i + 1) * BAND)]  # of each band, the bytes
    band = lambda i: F.xxhash64(F.lit(i), *[F.substring("print", order[i * BAND + k] + 1, 1) for k in range(BAND)])
    links = prints.sparkSession.createDataFrame([], "u long, v long, near double")
    for bands in (range(WALKS), range(PLACES // BAND)):
        across = len(bands) > WALKS
        posted = prints.select("node", F.explode(F.array(*map(band, bands))).alias("list"))
        found = components(links)
        if across:  # only bands of members that could still be joined
            at = posted.join(found, "node", "left").select("node", "list", F.coalesce("component", "node").alias("component"), F.lit(1).alias("weight"))
        else:
            at = posted.select("node", "list", F.col("node").alias("component"), F.lit(1).alias("weight"))
        lists = blocks.open_lists(at, BLOCK, across)
        sides = (
            at.join(lists, "list").select("node", "component", F.struct("list", blocks.places(across).alias("places")).alias("p"))
            .groupBy("node", "component").agg(F.collect_list("p").alias("lists")).join(prints.select("node", "print"), "node")
            .withColumn("p", F.explode("lists")).withColumn("q", F.explode("p.places"))
            .select("p.list", "q.x", "q.y", "q.role", "node", "component", "print")
        )
        sides = sides.repartition("list", "x", "y").sortWithinPartitions("list", "x", "y")
        links = cut(links.union(sides.mapInArrow(_joining(least), "u long, v long, near double")))
    return links


def near_groups(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, mark, near_class) of the rows of ``docs`` (doc_id, text) that are like another one: near_class is the smallest doc_id
    of the group (null, if none of it has a doc_id); mark is a hash of the text. Rows equal in doc_id and text are one."""
    spark, since = docs.sparkSession, written()
    made = _keyed(docs).select("doc_id", "mark", "text").mapInArrow(_prints, "doc_id long, mark long, print binary")
    prints = cut(made.filter(F.length("print") > 0).withColumn("node", F.monotonically_increasing_id()))
    found = components(near_links(prints.filter(F.col("print") != F.lit(bytes(SLOTS))), least))
    named = prints.select("node", "doc_id", "mark").join(found, "node")
    least_id = named.groupBy("component").agg(F.min("doc_id").alias("near_class"))
    result = named.join(least_id, "component").select("doc_id", "mark", "near_class").distinct()
    kept = cut(result)
    drop(spark, since, keep=1)
    return kept
