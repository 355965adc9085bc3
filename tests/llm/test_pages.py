"""Web pages: main text and URL filter."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import dom, html_pages, html_text, trees, url_filter


@pytest.fixture(scope="module")
def extractor():
    return html_text.train()


def test_pages_not_learnt_from(extractor):
    made = html_pages.labelled(60, 4321)
    extra = missed = total = 0
    for (_, main), got in zip(made, extractor.texts([m[0] for m in made]), strict=True):
        own = set(got.split("\n\n")) - {""}
        extra, missed, total = extra + len(own - main), missed + len(main - own), total + len(main)
    assert extra + missed < 0.08 * total


ARTICLE = "<article><h1>Stone &amp; water</h1><p><b>The green river\n moves &lt;slowly&gt; under the bridge, and it shines.<br><p>Seven lights burn in the house at night, as they did for years, and nobody knows why.</p></article>"


def test_page_parts(extractor):
    page = f"""<!DOCTYPE html><html><head><title>t</title><script>if (a < b) document.write("</p>")</script></head><body>
    <header><h2>My site</h2></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><div class="ad">Buy green paper now, it is cheap.</div>
    {ARTICLE}<section class="comments"><div class="comment"><p>I have been to this river often and I liked it a lot, thank you.</p></div></section>
    <aside class="sidebar"><h3>Popular</h3><ul><li><a href=x>Other things to read today</a></li></ul></aside>
    <div class="cookie-notice"><p>We use cookies to make this page better for you.</p></div><form><label>Your mail</label><input></form><footer>&copy; me</footer>"""
    want = "Stone & water\n\nThe green river moves <slowly> under the bridge, and it shines.\n\nSeven lights burn in the house at night, as they did for years, and nobody knows why."
    assert extractor.texts([page]) == [want]


def test_test_pages(spark, small, extractor):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = html_text.extract(pages, extractor).collect()
    assert len(got) == pages.count()
    sources = {r.page_id: r.html for r in pages.collect()}
    import html as h

    for r in got:
        article = re.search(r"<article>(.*?)</article>", sources[r.page_id], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_pages(spark, extractor):
    odd = [None, "", "  ", "no markup", "<p>a<p>b", "<", "<div", "<a href='x", "<!-- never ends", "<script>x", "<p>&amp;amp; &#x41; &eacute &nosuch;</p>", "<div>" * 3000 + "deep" + "</div>" * 10, "</p></div>", "<table><tr><td>a<td>b<tr><td>c</table>", "<p>" + "long words " * 30_000 + "</p>"]
    rows = [(i, "u", t, "clash") for i, t in enumerate(odd)] + [(None, None, "<p>x</p>", None), (3, "u", "no markup", "again")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(frame, extractor).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (0, 1, 2)] == ["", "", ""]
    assert html_text.extract(frame.filter("page_id < 0"), extractor).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/=\"'abp !-&;\n", max_size=200))
def test_any_markup_is_read(source):
    page = dom.parse(source)
    assert all(0 <= p < i for i, p in enumerate(page.parent) if i) and all(i < e <= len(page.tag) for i, e in enumerate(page.end))


def test_decoding_has_no_contradictions(extractor):
    nodes = html_text.join([dom.parse(m[0]) for m in html_pages.labelled(20, 8)])
    rng = np.random.default_rng(0)
    for _ in range(5):
        margin = rng.normal(0, 2, len(nodes.tag))
        kept = html_text.decode(nodes, margin)
        inner = nodes.depth > 0
        assert not (kept[inner] & ~kept[nodes.parent[inner]]).any()


def test_decoding_is_the_likeliest():
    nodes = html_text.join([dom.parse("<div><p>a</p><ul><li>b</li></ul></div>")])
    n, rng = len(nodes.tag), np.random.default_rng(1)
    for _ in range(20):
        margin = rng.normal(0, 2, n)
        yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
        worth = lambda x: sum(yes[i] if x >> i & 1 else no[i] for i in range(n))  # noqa: B023, E731
        allowed = [x for x in range(1 << n) if all(not x >> i & 1 or x >> nodes.parent[i] & 1 for i in range(n) if nodes.depth[i])]
        got = html_text.decode(nodes, margin)
        assert worth(sum(int(b) << i for i, b in enumerate(got))) == pytest.approx(max(map(worth, allowed)))


def test_trees_learn_and_are_constant_without_classes():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = trees.boost(x[:1000], y[:1000])
    assert ((model.scores(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    assert len(set(trees.boost(x, np.zeros(1500)).scores(x[:3]))) == 1 and len(trees.boost(x[:0], y[:0]).scores(x[:3])) == 3


def plain_rule(url):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = [None, "", "x", "://", "http://", "http://EXAMPLE.com", "http://example.com/en/", "https://www.Example.COM/en/x?y://z#q", "http://a.www.example.com/en/", "ftp://net/es/1", "http://my-net/es/1", "http://x.net/fr/2", "http://x.net/frx", "http://x.com?q=/en/", "http://x.com#/en/", "a\nb://c.example.com/en/\nz", "http://Ünet.com/é", "http://x.com/" + "a/" * 3000, "http://notexample.com/en/"]


def test_url_filter(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(URLS)] + [(None, "http://x.com/"), (10_000, None)], "page_id long, url string")
    every = pages.union(odd)
    got = url_filter.judge(every).collect()
    urls = {r.page_id: r.url for r in every.filter("page_id is not null").collect()}
    assert len(got) == every.count()
    for r in got:
        if r.page_id is not None:
            host, path, rule, verdict = plain_rule(urls[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.judge(every.filter("page_id < 0")).count() == 0
    assert {r.verdict for r in url_filter.judge(odd.filter("url = 'x'")).collect()} == {"allow"}
    clashing = every.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "score", "own", "order", "depth", "dots")})
    key = lambda r: (str(r.page_id), r.host, r.path, r.rule or "", r.verdict)
    assert sorted(map(key, url_filter.judge(clashing).collect())) == sorted(map(key, got))


def test_url_features_against_plain_counts(spark):
    rows = [(i, u) for i, u in enumerate([*URLS, "https://a-b.c1.co.uk/x/yy_9/z.html?a=1&b=2#f?g=h", "http://h/p#f?x=1"])]
    table = url_filter._read(spark.createDataFrame(rows, "page_id long, url string"), F.col("page_id")).orderBy("page_id").toArrow()
    got = url_filter.features(table, {"uk": 0.25, "co.uk": 0.75}, 0.5)

    def entropy(t):
        b = t.encode()
        return -sum(b.count(c) / len(b) * math.log2(b.count(c) / len(b)) for c in set(b))

    for (_, url), x in zip(rows, got, strict=True):
        url = url or ""
        host, path, *_ = plain_rule(url)
        query, steps = url.partition("?")[2].partition("#")[0], [s for s in path.split("/") if s]
        digits = lambda t: sum(c in "0123456789" for c in t)
        want = [
            len(url), len(host), len(path), len(query), host.count("."), len(steps), max(map(len, steps), default=0), digits(url) / max(1, len(url)),
            digits(host), url.count("-") + url.count("_"), query.count("=") + query.count("&"), url.startswith("https"), "#" in url,
            bool(steps) and "." in steps[-1], entropy(host), entropy(path), 0.25 if host.endswith(".uk") else 0.5, 0.75 if host.endswith(".co.uk") else 0.5,
        ]
        assert np.allclose(x, np.array(want, float)), url


def test_url_trees_hold_out(spark):
    rng = np.random.default_rng(3)
    urls = []
    for i in range(1500):
        bad = i % 2
        host = f"{'x' * int(rng.integers(3, 9))}.{('spam', 'good', 'mid')[int(rng.integers(0, 3))]}.{('biz' if bad and i % 3 else 'org')}"
        path = "/" + "/".join("a" * int(rng.integers(1, 9)) + ("7" * int(rng.integers(5, 9)) if bad else "") for _ in range(int(rng.integers(1, 4))))
        urls.append(f"http://{host}{path}")
    blocked = np.arange(1500) % 2 == 1
    rows = url_filter._read(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), F.col("page_id")).orderBy("page_id").toArrow()
    model = url_filter.fit(rows.slice(0, 1000), blocked[:1000])
    assert ((model.scores(rows.slice(1000)) > 0.5) == blocked[1000:]).mean() > 0.95


def test_parse_keeps_what_follows_an_open_head():
    for page in ("<html><head><title>t</title><body><p>Some text", "<head><meta charset=x><script>no</script><p>Some text", "<html><head><title>t</title>Some text"):
        assert [x for x in dom.parse(page).text if x] == ["Some text"]
    assert [x for x in dom.parse("<head><title>t</title><style>a</style></head><body>Some text").text if x] == ["Some text"]


def test_parse_reads_formulas_and_fallbacks():
    for tag in ("math", "object", "canvas", "video", "audio"):
        assert [x for x in dom.parse(f"<p>so <{tag}>E = mc</{tag}> holds</p>").text if x] == ["so E = mc holds"]
