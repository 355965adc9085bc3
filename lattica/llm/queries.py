"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontamination, fingerprints, html_text, mixing, near_dedup, quality, sharding, token_counts, toxicity, url_filter
from lattica.session import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, carry=("doc_id", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies", "rate")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    law = F.lit("bytes").alias("law")
    return sharding.place(docs).select("doc_id", "size", "text_crc32", law, "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.compare_next(docs, groups=fingerprints.near_groups(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, items).select("doc_id", "item_id", "start", "similarity")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_token_counts": op2_token_counts,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_ring_shards": op6_ring_shards,
    "op7_fingerprints": op7_fingerprints,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_near_dedup": op10_near_dedup,
}

#: Words as the operators take them: A-Z as a-z, split at white space; a row a word.
_WORDS = r"""words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
)"""

ORACLE_SQL: dict[str, str] = {
    "op10_near_dedup": f"""
WITH RECURSIVE {_WORDS},
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words)
  WHERE i = 0 OR i + 5 <= n
),
size AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
common AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
own AS (SELECT sh.* FROM sh JOIN common USING (s)),
inter AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM inter JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v WHERE 100 * k >= 75 * (x.c + y.c - k)),
edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.v FROM reach JOIN edge ON edge.u = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(size.c, 0)::BIGINT AS n_shingles, least.component_id, d.doc_id = least.component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN size USING (doc_id)
""",
    "op8_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
its AS (SELECT item_id, len(w) AS n, least(len(w), 5) AS k, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS s FROM iw WHERE len(w) > 0),
ic AS (SELECT item_id, n, k, s, count(*) AS c FROM its GROUP BY ALL),
ds AS (SELECT doc_id, k, len(w) AS len, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS s, unnest(range(len(w) - k + 1)) AS pos FROM dw, (SELECT DISTINCT k FROM its) WHERE len(w) >= k),
seed AS (SELECT ds.doc_id, ic.item_id, ic.n, ic.k, ic.s, ic.c, ds.pos, least(ic.n, ds.len) - ic.k + 1 AS total, ds.len - least(ic.n, ds.len) AS last FROM ds JOIN ic ON ds.s = ic.s AND ds.k = ic.k),
win AS (SELECT DISTINCT doc_id, item_id, total, unnest(range(greatest(0, pos - total + 1), least(pos, last) + 1)) AS start FROM seed),
bag AS (SELECT w.doc_id, w.item_id, w.start, seed.n - seed.k + 1 + w.total AS sum, seed.s, least(count(*), max(seed.c)) AS c FROM win w JOIN seed ON seed.doc_id = w.doc_id AND seed.item_id = w.item_id AND seed.pos >= w.start AND seed.pos < w.start + w.total GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, sum(c)::BIGINT AS both_, any_value(sum) - both_ AS united FROM bag GROUP BY ALL),
best AS (SELECT *, both_::DOUBLE / united AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY both_::DOUBLE / united DESC, start DESC) AS r FROM sim WHERE 100 * both_ >= 75 * united)
SELECT doc_id, item_id, start::BIGINT AS start, similarity FROM best WHERE r = 1
""",
}
