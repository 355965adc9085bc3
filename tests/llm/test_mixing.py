"""Mixing sources: targets, rates and rounding against a plain computation."""

import math

import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing
from tests.llm.common import documents, empty, widened


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares by weight; those above the cap stop there and the excess is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        share = {s: cap * sizes[s] if s in capped else w[s] * rest / free for s in names}
        over = {s for s in names if s not in capped and share[s] > cap * sizes[s]}
        if not over:
            return share
        capped |= over


def plain_tilt(sizes, target, cap=3):
    """The tilt by bisection."""
    mean = sum(sizes) / len(sizes)
    got = lambda t: sum(s * min(cap, math.exp(min(20, t * s / mean))) for s in sizes)
    lo, hi = -200.0, 200.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if got(mid) < target else (lo, mid)
    return lambda s: min(cap, math.exp(min(20, lo * s / mean)))


@pytest.fixture(scope="module")
def corpus(spark):
    def rows():
        for i in range(1200):
            source = None if i % 41 == 0 else f"s{min(i % 17, 5)}" if i % 3 else "s0"
            yield i, " ".join(["w"] * (i * 7919 % 97)), source

    return spark.createDataFrame(list(rows()), "doc_id long, text string, source string")


def test_against_plain(spark, corpus):
    got = mixing.mix(corpus).toPandas().astype({"source": object})
    got["source"] = got["source"].where(got["source"].notna(), None)
    groups = {s: got[got["source"].isna() if s is None else got["source"] == s] for s in set(got["source"])}
    want = plain_targets({s: int(g["size"].sum()) for s, g in groups.items()})
    assert len(got) == 1200
    for s, g in groups.items():
        assert g["target"].nunique() == 1 and g["target"].iloc[0] == pytest.approx(want[s])
        taken = (g["copies"] * g["size"]).sum()
        assert abs(taken - want[s]) <= g["size"].max()
        assert g["copies"].between(0, 3).all() and (g["copies"] - g["rate"]).abs().max() < 1 + 1e-9
        if want[s] < 3 * g["size"].sum():
            rate = plain_tilt(g["size"].tolist(), want[s])
            assert all(abs(rate(n) - r) < 1e-4 for n, r in zip(g["size"], g["rate"], strict=True) if n)


def test_reruns_agree_whatever_the_layout(spark, corpus):
    once = {r.doc_id: r.copies for r in mixing.mix(corpus).collect()}
    assert once == {r.doc_id: r.copies for r in mixing.mix(corpus.repartition(5, F.rand(3))).collect()}


def test_caps_share_the_excess(spark):
    rows = [(i, "w " * 10, "a") for i in range(2)] + [(10 + i, "w " * 50, "b") for i in range(20)] + [(50, "w w w", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    a, n = got[got.source == "a"], got[got.source.isna()]
    assert set(a.target) == {60.0} and set(a.copies) == {3} and set(n.copies) == {3} and set(n.target) == {9.0}


def test_many_sources(spark, corpus, monkeypatch):
    """Beyond the bound of a broadcast: ids in runs, joins by a shuffle; the same result."""
    once = {r.doc_id: (r.copies, r.target) for r in mixing.mix(corpus).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(mixing, "RUNS", 4)
    assert once == {r.doc_id: (r.copies, r.target) for r in mixing.mix(corpus).collect()}


def test_equal_rows_are_divided(spark, monkeypatch):
    """Groups of rows equal in key and text, larger than a task may number; the same copies in all as without dividing."""
    rows = [(i, "w " * (i % 9), f"s{i % 3}") for i in range(300)] + [(None, "w w w", "s0")] * 200 + [(5, "w w w", "s1")] * 90 + [(None, None, "s1")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = lambda d: sorted((r.doc_id or -1, r.text or "", r.source, r.copies) for r in mixing.mix(d).collect())
    once = found(docs)
    words = lambda rows, s: sum(c * len(t.split()) for _, t, own, c in rows if own == s)
    monkeypatch.setattr(mixing.hot, "HOT", 20)
    for parts in (1, 4):
        again = found(docs.repartition(parts))
        assert len(again) == len(rows) and all(abs(words(again, s) - words(once, s)) <= 8 for s in ("s0", "s1", "s2"))
    assert again == found(docs.repartition(2))


def test_odd_rows(spark):
    docs = documents(spark)
    got = mixing.mix(docs)
    assert got.count() == docs.count() and got.filter("copies is null or size is null").count() == 0
    assert got.filter("text is null").first()["size"] == 0 and got.filter("size = 0 and copies > 0").count() == 0
    assert mixing.mix(widened(docs)).count() == docs.count()
    assert mixing.mix(empty(spark)).count() == 0
    taken = mixing.take(widened(docs))
    assert taken.columns == widened(docs).columns and taken.count() == got.agg(F.sum("copies")).first()[0]
    assert taken.filter("size <> 'clash' or copies <> 'clash' or target <> 'clash'").count() == 0
    assert mixing.take(empty(spark)).count() == 0
