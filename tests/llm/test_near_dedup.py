"""Near-dedup against brute force over exact shingle sets."""

import random
import re

from pyspark.sql import functions as F

from lattica.llm import near_dedup
from tests.llm.common import documents, empty, odd_rows, text, widened

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{doc_id: smallest doc_id reachable}; doc_ids unique."""
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def edited(t, seed, k):
    r, w = random.Random(seed), t.split()
    for _ in range(k):
        i = r.randrange(len(w))
        w[i : i + r.choice((0, 1))] = r.choice(([], [f"new{seed}"]))
    return " ".join(w)


def check(spark, rows):
    got = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, sizes = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_families_of_copies(spark):
    rows, n = [], 0
    for family in range(12):
        base = text(family, 30 + 25 * family)
        for k in (0, 0, 1, 1, 2, 3, 5, 8, 13, 20):
            rows.append((n * 37 % 1009, edited(base, n, k) if k else base.upper() if n % 2 else base))
            n += 1
    check(spark, rows)


def test_a_centre_that_is_not_the_smallest(spark):
    """Near copies that are linked through one document only, whose doc_id is the largest."""
    base = text(99, 200)
    check(spark, [(i, edited(base, i, 4)) for i in range(40)] + [(500, base)])


def test_chains_and_a_shared_passage(spark):
    passage, words = text(5, 60), text(6, 100).split()
    chain = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(12)]
    check(spark, chain + [(100 + i, f"{passage} {text(200 + i, 30 + i)}") for i in range(40)])


def test_blocks_of_a_large_list(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "HEAVY", 100)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    base = text(77, 150)
    check(spark, [(i, edited(base, i, 5)) for i in range(30)])
    check(spark, [(i, edited(base, i, 9 + i % 5)) for i in range(45)])  # some links are missing


def test_a_group_gives_no_more_links_than_members(spark):
    base = text(78, 120)
    _, classes, links = near_dedup.link(spark.createDataFrame([(i, edited(base, i, 3)) for i in range(80)], "doc_id long, text string"))
    assert links.count() <= 33 * classes.count()


def test_repeated_ids_with_different_texts(spark):
    """doc_id 7 stands on two texts; 8 is near one, 9 near the other."""
    a, b = text(50, 40), text(51, 40)
    docs = spark.createDataFrame([(7, a), (7, b), (8, a + " end"), (9, b + " end"), (3, text(52, 40))], "doc_id long, text string")
    for parts in (1, 3):
        got = near_dedup.dedup(docs.repartition(parts, "text")).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (7, 7), (7, 7), (8, 7), (9, 7)]
    low = docs.union(spark.createDataFrame([(2, b + " tail")], docs.schema))  # what reaches one text of 7 reaches the other
    assert {(r.doc_id, r.component_id) for r in near_dedup.dedup(low).collect()} == {(2, 2), (3, 3), (7, 2), (8, 2), (9, 2)}
    widened_, kept = widened(docs), near_dedup.keep_one(widened(docs))
    assert kept.columns == widened_.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 7]


def test_odd_rows(spark):
    docs = documents(spark)
    got = near_dedup.dedup(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    for blank in (1, 2, 3):
        assert by[blank] == [(0, blank, True)]
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 5, True)]
    assert [x[1] for x in by[6]] == [6, 6] and [x[1] for x in by[7]] == [6, 6] and by[8][0][1] == 6  # what reaches one text of 7 reaches the other
    assert {(x[1], x[2]) for x in by[None]} == {(6, False), (None, False)}
    assert by[9][0][0] == len(shingle_set(dict((r[0], r[1]) for r in odd_rows())[9]))
    assert near_dedup.dedup(empty(spark)).count() == 0
    clashing = docs.withColumns({c: F.lit("clash") for c in ("n", "k1", "k2", "at", "id_", "mark", "node", "rep", "least", "component", "component_id", "kept", "list", "sig")})
    key = lambda r: (r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept)
    assert sorted(map(key, near_dedup.dedup(widened(clashing)).collect())) == sorted(map(key, got))


def test_keep_one(spark):
    docs = widened(documents(spark))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(6) == 2 and 8 not in ids and ids.count(None) == 2 and {1, 2, 3, 4, 5, 9, 10, 11, 12} <= set(ids)
