"""A forgiving HTML reader: block elements and runs of text, as flat lists in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Nothing in these is text of the page.
UNSEEN = frozenset("script style noscript template svg iframe textarea select option button title head datalist noframes xmp".split())
#: Those that end only at their own end tag.
RAW = frozenset("script style textarea title iframe noscript noframes xmp".split())
#: What can stand in a head; anything else ends it, as does text.
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "thead": {"caption"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "thead": {"table"}}
_NO_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Page:
    """Nodes in page order; a run of text is a node without children. end: one past the last descendant."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    index: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def parse(source: str | None) -> Page:
    """The page of an HTML text; null is empty. Node 0 is the root."""
    page = Page()
    children: list[int] = []

    def node(tag, parent, tokens=(), text="", linked=0):
        page.tag.append(tag)
        page.parent.append(parent)
        page.end.append(len(page.tag))
        page.depth.append(page.depth[parent] + 1 if parent >= 0 else 0)
        page.index.append(children[parent] if parent >= 0 else 0)
        page.tokens.append(tokens)
        page.text.append(text)
        page.linked.append(linked)
        children.append(0)
        if parent >= 0:
            children[parent] += 1
        return len(page.tag) - 1

    stack = [("", node("", -1))]  # (tag, node of the innermost block)
    chunks: list[str] = []
    links = linked = skip = 0  # open links, characters in them, depth of unseen elements

    def flush():
        nonlocal linked
        if chunks:
            text = " ".join("".join(chunks).split())
            if text:
                node("#", stack[-1][1], (), text, min(linked, len(text)))
            chunks.clear()
        linked = 0

    def pop(to):  # the stack down to ``to`` entries
        nonlocal links, skip
        while len(stack) > to:
            tag, at = stack.pop()
            if tag in BLOCKS:
                page.end[at] = len(page.tag)
            links -= tag == "a"
            skip -= tag in UNSEEN

    at, size, source = 0, len(source or ""), source or ""
    raw = None
    while at < size:
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.I).search(source, at)
            at = m.start() if m else size
            raw = None
            continue
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else size]
        if text and stack[-1][0] == "head" and not text.isspace():
            pop(len(stack) - 1)
        if text and not skip:
            text = html.unescape(text) if "&" in text else text
            chunks.append(text)
            linked += len(text) if links else 0
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if m[1]:  # an end tag
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if block and not skip:
                        flush()
                    pop(i)
                    break
                if not block and tag not in UNSEEN and stack[i][0] in BLOCKS:
                    break
            if block and not skip:
                flush()
            continue
        if stack[-1][0] == "head" and tag not in _IN_HEAD:
            pop(len(stack) - 1)
        if tag == "br":
            chunks.append(" ")
            continue
        if block and not skip:
            flush()
            if tag in _NO_P:  # a block ends an open paragraph
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            closes, scope = _CLOSES.get(tag, ()), _SCOPES.get(tag, ())
            if closes:
                lowest = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closes:
                        lowest = i
                    if stack[i][0] in scope:
                        break
                if lowest:
                    pop(lowest)
        if tag in VOID:
            continue
        attributes = m[3]
        if tag in RAW:
            raw = tag
        own = stack[-1][1]
        hidden = "idden" in attributes or "none" in attributes
        if block and not skip:
            names = [x for g in _NAMES.findall(attributes) for x in g if x]
            tokens = tuple({w.lower() for name in names for w in _WORD.findall(name)})
            if hidden and _HIDDEN.search(attributes):
                tokens += ("hidden",)
            own = node(tag, own, tokens)
        if attributes.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        stack.append((tag, own))
        links += tag == "a"
        skip += tag in UNSEEN
    flush()
    pop(0)
    page.end[0] = len(page.tag)
    return page
