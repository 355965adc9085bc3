"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

Every block element and every run of text is a node with features of its own (tag, depth, attribute tokens), of its subtree
(text, link density, density of text over nodes, punctuation), of its siblings (number, place, their text) and of its ancestors. The
trees give each node the probability that it holds main text. Decoding then picks the likeliest labelling in which a node is
main only if its parent is, by one pass up the tree: so an article inside a rejected block can't stay, nor a menu drop what is
kept above it.

The trees learn from ``html_pages``, pages made by rule with known labels, as no labelled pages are given; what the attribute
tokens say (log odds) is learnt from the same pages. A fit takes seconds on the driver and is sent to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import bytewords
from lattica.llm.dom import Page, parse
from lattica.llm.trees import Trees, boost

#: Tags with a feature of their own, some together.
KINDS = (("#",), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl", "menu"), ("table", "tbody", "thead", "tr", "td", "th"), ("nav",), ("aside",), ("header", "hgroup"), ("footer",), ("article", "main"), ("section",), ("div",), ("form", "fieldset", "legend", "dialog"), ("blockquote", "pre", "figure", "figcaption"), ("", "html", "body"))
_KIND = {t: i for i, ts in enumerate(KINDS) for t in ts}


def _above(parent: np.ndarray, depth: np.ndarray, own: np.ndarray, least: bool) -> np.ndarray:
    """The least or greatest of ``own`` over each node's proper ancestors; 0 for roots."""
    out, pick = np.zeros(len(own)), np.minimum if least else np.maximum
    order = np.argsort(depth, kind="stable")
    ends = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
    for d in range(1, len(ends) - 1):
        at = order[ends[d] : ends[d + 1]]
        out[at] = pick(out[parent[at]], own[parent[at]])
    return out


@dataclass
class Nodes:
    """The nodes of some pages, end to end."""

    tag: np.ndarray
    parent: np.ndarray
    end: np.ndarray
    depth: np.ndarray
    index: np.ndarray
    page: np.ndarray
    tokens: list[tuple[str, ...]]
    text: list[str]
    linked: np.ndarray


def join(pages: list[Page]) -> Nodes:
    n = np.array([len(p.tag) for p in pages])
    base = np.repeat(np.cumsum(n) - n, n)
    flat = lambda name, kind=np.int64: np.array([x for p in pages for x in getattr(p, name)], kind)
    tag = np.array([_KIND.get(t, 12) for p in pages for t in p.tag])
    return Nodes(tag, np.maximum(flat("parent") + base, base), flat("end") + base, flat("depth"), flat("index"), np.repeat(np.arange(len(pages)), n), [t for p in pages for t in p.tokens], [t for p in pages for t in p.text], flat("linked"))


def features(nodes: Nodes, odds: dict[str, float]) -> np.ndarray:
    n, start = len(nodes.tag), np.arange(len(nodes.tag))
    below = lambda x: (lambda c: c[nodes.end] - c[start])(np.concatenate([[0], np.cumsum(x)]))
    own = np.array([len(t) for t in nodes.text], float)
    run = nodes.tag == 0
    chars, runs, linked, size = below(own), below(run), below(nodes.linked), (nodes.end - start).astype(float)
    words = below(np.array([t.count(" ") + 1 if t else 0 for t in nodes.text]))
    marks = below(np.array([t.count(".") + t.count(",") if t else 0 for t in nodes.text]))
    rights = below(np.array(["©" in t or "·" in t for t in nodes.text]))
    paragraphs = below(np.where(run, own > 80, False))
    root = np.zeros(n, np.int64)
    first = np.flatnonzero(nodes.depth == 0)
    root[:] = first[nodes.page]
    before = np.concatenate([[0], np.cumsum(own)])[start] - np.concatenate([[0], np.cumsum(own)])[root]
    whole = np.maximum(chars[root], 1)
    kids = np.bincount(nodes.parent[nodes.depth > 0], minlength=n)
    siblings = kids[nodes.parent]
    alike = {}
    for key in zip(nodes.parent.tolist(), nodes.tag.tolist(), strict=True):
        alike[key] = alike.get(key, 0) + 1
    same = np.array([alike[k] for k in zip(nodes.parent.tolist(), nodes.tag.tolist(), strict=True)], float)
    around = chars[nodes.parent] - chars
    place = np.lexsort((nodes.index, nodes.parent))
    last, following = np.zeros(n), np.zeros(n)
    pair = (nodes.parent[place[1:]] == nodes.parent[place[:-1]]) & (nodes.depth[place[1:]] == nodes.depth[place[:-1]])
    last[place[1:][pair]], following[place[:-1][pair]] = chars[place[:-1][pair]], chars[place[1:][pair]]
    said = [[odds.get(t, 0.0) for t in ts] for ts in nodes.tokens]
    low, high = np.array([min(s, default=0.0) for s in said]), np.array([max(s, default=0.0) for s in said])
    inside = lambda kinds: _above(nodes.parent, nodes.depth, np.isin(nodes.tag, kinds).astype(float), False)
    log, each = np.log1p, np.maximum(siblings - 1, 1)
    density = linked / np.maximum(chars, 1)
    cols = [nodes.tag == i for i in range(len(KINDS))] + [
        nodes.depth, log(kids), log(siblings), nodes.index / np.maximum(siblings, 1), same / np.maximum(siblings, 1),
        log(chars), log(words), density, chars / size, log(runs), marks / np.maximum(words, 1), words / np.maximum(runs, 1), rights > 0, log(paragraphs), chars / whole, before / whole,
        log(around / each), log(last), log(following), log(chars) - log(around / each),
        density[nodes.parent], chars[nodes.parent] / whole, log(paragraphs[nodes.parent]),
        low, high, _above(nodes.parent, nodes.depth, low, True), _above(nodes.parent, nodes.depth, high, False),
        inside([6]), inside([7]), inside([8]), inside([9]), inside([10]), inside([13]),
    ]
    return np.column_stack([np.asarray(c, float) for c in cols])


def decode(nodes: Nodes, margin: np.ndarray) -> np.ndarray:
    """Kept nodes: the labelling of greatest likelihood in which no node is main below one that isn't."""
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    order = np.argsort(nodes.depth, kind="stable")
    ends = np.searchsorted(nodes.depth[order], np.arange(nodes.depth.max(initial=0) + 2))
    reject = np.concatenate([[0], np.cumsum(no)])
    reject = reject[nodes.end] - reject[np.arange(len(margin))]  # the whole subtree
    keep = yes.copy()
    for d in range(len(ends) - 2, 0, -1):
        at = order[ends[d] : ends[d + 1]]
        np.add.at(keep, nodes.parent[at], np.maximum(keep[at], reject[at]))
    kept = keep >= reject
    for d in range(1, len(ends) - 1):
        at = order[ends[d] : ends[d + 1]]
        kept[at] &= kept[nodes.parent[at]]
    return kept


@dataclass
class Extractor:
    trees: Trees
    odds: dict[str, float]

    def texts(self, sources: list[str | None]) -> list[str]:
        """Main text of each page: kept runs, as blocks, with an empty line between them."""
        if not sources:
            return []
        nodes = join([parse(s) for s in sources])
        kept = decode(nodes, self.trees.margins(features(nodes, self.odds)))
        out: list[list[str]] = [[] for _ in sources]
        for i in np.flatnonzero(kept & (nodes.tag == 0)):
            out[nodes.page[i]].append(nodes.text[i])
        return ["\n\n".join(x) for x in out]


@lru_cache(maxsize=2)
def train(pages: int = 700, seed: int = 5) -> Extractor:
    """From ``pages`` pages made by rule. A node is main if main text is in its subtree."""
    from lattica.llm.html_pages import labelled

    made = labelled(pages, seed)
    nodes = join([parse(source) for source, _ in made])
    main = np.array([t in made[p][1] if t else False for t, p in zip(nodes.text, nodes.page, strict=True)])
    total = np.concatenate([[0], np.cumsum(main)])
    y = (total[nodes.end] - total[np.arange(len(main))]) > 0
    seen: dict[str, list[float]] = {}
    for ts, label in zip(nodes.tokens, y, strict=True):
        for t in ts:
            seen.setdefault(t, [1.0, 1.0])[int(label)] += 1
    odds = {t: float(np.log(b / a)) for t, (a, b) in seen.items()}
    return Extractor(boost(features(nodes, odds), y.astype(float), rounds=80, depth=5, rate=0.15), odds)


def extract(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages`` (page_id, url, html). Null, empty and blank pages, and
    pages without main text, give an empty text. Broken markup is read as far as it goes; nothing is cut."""
    sent = pages.sparkSession.sparkContext.broadcast(extractor or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bytewords.pieces(whole, "html", 1 << 20):
                texts = sent.value.texts(batch.column("html").to_pylist())
                out = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
