"""Decontamination against brute force over all windows; the pipeline, stage by stage."""

import collections
import random
import re

import pytest

from lattica.llm import decontamination
from tests.llm.common import documents, empty, text, widened
from tests.llm.test_near_dedup import brute as near_brute


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return len(w), [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute(docs, items):
    """{(doc_id, item_id): (similarity, start)} of the best window, of equals the last."""
    found, read = {}, {}
    for i, u in items:
        m = shingles(u)[0]
        k = min(m, 5)
        own = shingles(u, k)[1] if m else []
        bag = collections.Counter(own)
        for d, t in docs if own else ():
            n, s, distinct = read.get((d, t, k)) or read.setdefault((d, t, k), (*(r := shingles(t, k)), set(r[1])))
            if bag.keys().isdisjoint(distinct):
                continue
            width = min(m, n) - k + 1
            for at in range(len(s) - width + 1) if s else ():
                here = collections.Counter(s[at : at + width])
                both, union = sum((here & bag).values()), sum((here | bag).values())
                if 100 * both >= 75 * union:
                    found[d, i] = max(found.get((d, i), (0, 0)), (both / union, at))
    return found


def corpus():
    r, items, docs = random.Random(9), [], []
    for i in range(12):
        items.append((i, text(100 + i, r.choice((4, 5, 9, 20, 45, 57)))))
    items += [(20, "again and again and again and again and again and again"), (21, None), (22, ""), (23, items[5][1])]
    for d in range(150):
        words = text(300 + d, r.choice((0, 3, 40))).split()
        item = r.choice(items)[1] or "none"
        w = item.split()
        for _ in range(r.choice((0, 0, 1, 2))):
            w[(at := r.randrange(len(w))) : at + r.choice((0, 1))] = r.choice(([], ["other"]))
            w = w or ["x"]
        docs.append((d, " ".join([*words, *w, *(words[::-1] if d % 2 else [])])))
    docs += [(500, items[3][1].upper()), (501, " ".join(items[7][1].split()[:-1])), (502, None), (503, "again " * 50)]
    return docs, items


def test_against_all_windows(spark):
    docs, items = corpus()
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in got} == {k: (round(v, 9), at) for k, (v, at) in want.items()} and len(want) > 40
    assert any(len(u.split()) < 5 for i, u in items if u and any(k[1] == i for k in want))


def test_fingerprints_judge_nearly_equal_windows_alike(spark):
    """The radius loses none of many windows near the threshold, and most unrelated pairs are beyond it."""
    from pyspark.sql import functions as F

    r, pairs = random.Random(8), []
    for i in range(400):
        a = [r.getrandbits(63) for _ in range(r.randint(16, 60))]
        cut = len(a) // 8
        pairs.append((a, a[: len(a) - cut] + [r.getrandbits(63) for _ in range(cut)], [r.getrandbits(63) for _ in a]))
    frame = spark.createDataFrame(pairs, "a array<long>, b array<long>, c array<long>")
    prints = frame.select(*[decontamination._simhash(F.col(c)).alias(c) for c in "abc"])
    ones = [sum(h >> j & 1 for h in pairs[0][0]) * 2 > len(pairs[0][0]) for j in range(64)]
    assert [prints.first().a >> j & 1 for j in range(64)] == list(map(int, ones))
    far = prints.select(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("near"), F.bit_count(F.col("a").bitwiseXOR(F.col("c"))).alias("far")).toPandas()
    assert far.near.max() <= decontamination.RADIUS and (far.far <= decontamination.RADIUS).mean() < 0.4


def test_a_long_text_of_one_word(spark):
    docs, items = [(1, "again " * 20_000), (2, "again " * 30)], [(1, "again " * 50), (2, "again again")]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.start) for r in got.collect()) == [(1, 1, 19_950), (1, 2, 19_998), (2, 2, 28)]


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST", 0)
    docs, items = corpus()
    docs = docs[::3]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, marks).collect()} == set(brute(docs, items))
    bad = {d for d, _ in brute(docs, items)}
    assert {r.doc_id for r in decontamination.clean(frame, marks).collect()} == {d for d, _ in docs} - bad


def test_odd_rows(spark):
    docs, marks = widened(documents(spark)), spark.createDataFrame([(1, text(1, 40)), (1, text(2, 30)), (2, "one"), (None, text(3, 25))], "item_id long, text string")
    got = decontamination.contaminated(docs, marks).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(4, 2), (6, 1), (7, 1), (8, 1), (None, 1), (None, None)}
    clean = decontamination.clean(docs, marks)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.select("doc_id").collect()) == [1, 2, 3, 5, 9, 10, 11, 12]
    assert decontamination.contaminated(empty(spark), marks).count() == 0
    assert decontamination.clean(docs, marks.limit(0)).count() == docs.count()


def test_pipeline(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, now = docs.columns, docs
    marks = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in pipeline.STAGES[:3]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        after = stage(spark, now, small).cache()
        assert after.columns == names and after.exceptAll(now).isEmpty()
        kept = {r.doc_id for r in after.collect()}
        if name == "near_dedup":
            assert kept == {i for i, c in near_brute(before)[0].items() if i == c}
        if name == "decontamination":
            assert kept == {i for i, _ in before} - {d for d, _ in brute(before, marks)}
        now = after
    last = pipeline.run(spark, small).toPandas()
    assert set(last["doc_id"]) <= {r.doc_id for r in now.collect()}
    assert last["doc_id"].value_counts().max() <= 3
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in last.groupby("shard"))


def test_few_files_however_many_partitions(spark, monkeypatch):
    docs, items = corpus()
    files, cut = [], decontamination.cut

    def counted(df):
        out = cut(df)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(decontamination, "cut", counted)
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert got.rdd.getNumPartitions() <= 4
        assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in got.collect()} == brute(docs, items)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(files)[-2] <= 5  # all but the windows' starts, of which there is no bound ahead (an empty table has a file too)
