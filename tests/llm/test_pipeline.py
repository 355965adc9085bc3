"""The pipeline's stages on rows of every kind; tests/llm/test_decontamination.py compares them with brute force."""

import pytest
from pyspark.sql import functions as F

from tests.llm.common import documents, empty, odd_rows, widened

pipeline = pytest.importorskip("corpus_pipeline")


def through(spark, docs, sf_dir):
    """(name, rows) after each stage."""
    now, found = docs, []
    for name, stage in pipeline.STAGES:
        after = stage(spark, now, sf_dir).cache()
        assert after.columns == docs.columns if name != "sharding" else set(docs.columns) <= set(after.columns)
        found.append((name, after.collect()))
        now = after
    return found


def test_odd_rows(spark, small):
    docs = widened(documents(spark))
    found = dict(through(spark, docs, small))
    ids = lambda name: sorted(-1 if r.doc_id is None else r.doc_id for r in found[name])
    assert len(found["toxicity"]) == len(odd_rows())  # none of them is toxic
    assert ids("near_dedup") == [-1, -1, 1, 2, 3, 4, 5, 6, 6, 9, 10, 11, 12]  # 7 and 8 are near 6
    assert ids("decontamination") == ids("near_dedup")
    taken = {r.doc_id for r in found["mixing"]}
    assert taken and not taken & {1, 2, 3} and all(r.rate == "clash" for r in found["mixing"])
    last = found["sharding"]
    assert len(last) == len(found["mixing"]) and {r.size for r in last} == {len((r.text or "").encode()) + 16 for r in last}
    for shard in {r.shard for r in last}:
        slots = sorted(r.slot for r in last if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_empty(spark, small):
    assert all(not rows for _, rows in through(spark, empty(spark), small))


def test_repeated_rows_stay_together(spark, small):
    docs = documents(spark).filter("doc_id in (6, 9)")
    docs = docs.union(docs).union(docs)
    found = dict(through(spark, docs, small))
    assert sorted(r.doc_id for r in found["decontamination"]) == [6] * 6 + [9] * 3


def test_run_leaves_only_the_last_stage(spark, small):
    from lattica.session import own_folder

    rows = pipeline.run(spark, small)
    assert rows.filter(F.col("shard").isNull() | F.col("slot").isNull()).count() == 0
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    names = [f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    assert sum(n.startswith("pipeline-mixing") for n in names) >= 1 and not any(n.startswith(("pipeline-toxicity", "pipeline-near", "pipeline-decon")) for n in names)
