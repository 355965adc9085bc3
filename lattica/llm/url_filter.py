"""URL filters: rules, and gradient-boosted trees on lexical features for what no rule decides.

The trees learn from URLs that the rules decide: a bounded sample of them (``sample``, those with the smallest hash). Features:
lengths, depth, shares of digits and hyphens, entropies, counts of labels and parameters, scheme, fragment, and, for the host's
last label and last two labels, how often the sample blocks them (smoothed). Host, path, rule and all features but entropies and
these rates are SQL expressions; numpy takes those, and the trees, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm import bytewords
from lattica.llm.trees import Trees, boost

#: (rule, verdict): a host and the beginning of a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
SAMPLE = 20_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to /, ? or #, A-Z lower-cased; then up to ? or #. Null or no ://: both empty."""
    url = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(url, _PARTS, 1), upper, upper.lower()), F.regexp_extract(url, _PARTS, 2)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a subdomain of it and begins the path; else null."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = ((F.when if rule is None else rule.when)(fits, F.lit(text)), (F.when if verdict is None else verdict.when)(fits, F.lit(says)))
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that SQL gives, as doubles."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^?]*\?([^#]*)", 1)
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    found = {
        "url_len": F.length(url), "host_len": F.length(host), "path_len": F.length(path), "query_len": F.length(query),
        "dots": count(host, r"\."), "depth": F.size(steps), "longest": F.coalesce(F.array_max(F.transform(steps, lambda s: F.length(s))), F.lit(0)),
        "digit_share": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "host_digits": count(host, "[0-9]"), "hyphens": count(url, "[-_]"),
        "parameters": count(query, "[=&]"), "secure": url.startswith("https").cast("int"), "fragment": url.contains("#").cast("int"),
        "file": F.coalesce(F.contains(F.try_element_at(steps, F.lit(-1)), F.lit(".")), F.lit(False)).cast("int"),
    }
    return {name: c.cast("double").alias(name) for name, c in found.items()}


NAMES = ("url_len", "host_len", "path_len", "query_len", "dots", "depth", "longest", "digit_share", "host_digits", "hyphens", "parameters", "secure", "fragment", "file")


def _entropy(column) -> np.ndarray:
    """Of each text's bytes, in bits."""
    data, at = bytewords.utf8(column)
    size = np.diff(at)
    cell, n = np.unique(np.repeat(np.arange(len(size)), size) * 256 + data, return_counts=True)
    share = n / size[cell // 256]
    return np.bincount(cell // 256, -share * np.log2(share), len(size))


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def features(rows, rates: dict[str, float], prior: float) -> np.ndarray:
    """A row of NAMES, two entropies and two rates for each of ``rows`` (an Arrow batch or table with NAMES, host, path)."""
    names, back = np.unique(np.array(rows.column("host").to_pylist(), object).astype(str), return_inverse=True)
    known = np.array([[rates.get(s, prior) for s in _suffixes(h)] for h in names], float).reshape(-1, 2)[back]
    numbers = [rows.column(c).to_numpy() for c in NAMES]
    return np.column_stack([*numbers, _entropy(rows.column("host")), _entropy(rows.column("path")), known])


@dataclass
class Filter:
    trees: Trees
    rates: dict[str, float]
    prior: float

    def scores(self, rows) -> np.ndarray:
        """The probability of block."""
        return self.trees.scores(features(rows, self.rates, self.prior))


def fit(rows, blocked: np.ndarray, smooth: float = 20.0) -> Filter:
    """From ``rows`` as ``features`` takes them."""
    prior = 0.5  # of a suffix that the sample doesn't have: neither way
    if not len(blocked):
        return Filter(Trees(-3.0), {}, prior)
    seen: dict[str, list[float]] = {}
    for host, b in zip(rows.column("host").to_pylist(), blocked, strict=True):
        for s in set(_suffixes(host)):
            c = seen.setdefault(s, [0.0, 0.0])
            c[0] += float(b)
            c[1] += 1
    rates = {s: (b + smooth * prior) / (n + smooth) for s, (b, n) in seen.items()}
    return Filter(boost(features(rows, rates, prior), blocked.astype(float), rounds=40, depth=3), rates, prior)


def _read(pages: DataFrame, *keep: Column) -> DataFrame:
    """(keep, host, path, NAMES) of ``pages`` (url)."""
    host, path = host_path(F.col("url"))
    rows = pages.select(*keep, "url", host.alias("host"), path.alias("path"))
    return rows.select(*[c for c in rows.columns if c != "url"], *lexical(F.col("url"), F.col("host"), F.col("path")).values())


def train(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> Filter:
    rows = _read(pages.select("url"), F.shiftrightunsigned(F.xxhash64("url"), 33).alias("order"), F.col("url").alias("own"))
    rows = rows.withColumn("verdict", matched(F.col("host"), F.col("path"), rules)[1]).filter("verdict is not null")
    share = 1.5 * sample / max(1, rows.count())  # of the hashes, those that hold the sample: so tasks send no more than that
    rows = rows.filter(F.col("order") < F.lit(int(min(1.0, share) * (1 << 31))))
    got = rows.orderBy("order", "own").limit(sample).drop("order", "own").toArrow()  # a bounded sample
    return fit(got, np.array([v == "block" for v in got["verdict"].to_pylist()], bool))


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), a row for each row of ``pages`` (page_id, url).

    rule: the longest that fits, else null. verdict: the rule's, else block from a score of 0.5 on. Null, empty and other texts
    without :// have an empty host and path and are judged by the trees; without any URL that a rule decides all are allowed.
    """
    sent = pages.sparkSession.sparkContext.broadcast(train(pages, rules, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(sent.value.scores(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), score], ["page_id", "host", "path", "score"])

    rows = _read(pages.select("page_id", "url"), F.col("page_id").cast("long").alias("page_id"))
    scored = rows.mapInArrow(run, "page_id long, host string, path string, score double")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
