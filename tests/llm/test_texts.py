"""Operators that judge or count single texts: token counts, toxicity, quality, fingerprints."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lattica.llm import bytewords, fingerprints, quality, token_counts, toxicity
from tests.llm.common import documents, empty, odd_rows, text, widened
from tests.test_operators import union_find

@pytest.mark.parametrize("known", [0, 300, token_counts.KNOWN])
def test_token_counts(spark, known):
    tokenizers, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(i, t) for i, (_, t, *_) in enumerate(odd_rows())] + [(100 + i, t) for i, t in enumerate([" ", "  a  b\n c ", "▁▁a ▁", "</s>", "a" * 999, "\n", "word " * 5000, "x\u00a0y"])]
    rows += [(200 + i, text(i % 7, 60)) for i in range(30)]
    got = token_counts.count_tokens(widened(spark.createDataFrame(rows, "doc_id long, text string")), path, known=known).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len((t or "").encode()), len(sp.encode(t)) if t else 0) for i, t in rows}
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def labelled(spark):
    """Toxic: one of two stems twice. Low quality: repeated words."""
    r, docs, labels = random.Random(4), [], []
    for i in range(900):
        words = text(i, r.randint(8, 80)).split()
        toxic, poor = r.random() < 0.25, r.random() < 0.3
        if poor:
            words = [w for w in words[:8] for _ in range(8)]
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(("vilest", "skunkk")) + r.choice(("", "er", "ing")))
        docs.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(got, labels, name):
    want = {r.doc_id: r[name] for r in labels.collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(held) > 100
    assert all(0 <= r.score <= 1 for r in got)
    return np.mean([r.predicted == want[r.doc_id] for r in held])


def test_toxicity(spark):
    docs, labels = labelled(spark)
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert accuracy(got, labels, "toxic") > 0.97
    kept = toxicity.reject(widened(docs), machine)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    odd = toxicity.score(documents(spark), machine).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.reject(widened(documents(spark)), machine).columns == widened(documents(spark)).columns
    assert toxicity.score(empty(spark), machine).count() == 0


def test_the_held_out_fold_is_not_learnt_from(spark):
    docs, labels = labelled(spark)
    out = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    wrong = labels.replace(to_replace={}) if not out else labels.selectExpr("doc_id", f"if(doc_id in ({', '.join(map(str, out))}), 1 - quality, quality) as quality", f"if(doc_id in ({', '.join(map(str, out))}), 1 - toxic, toxic) as toxic")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, wrong)
    assert np.array_equal(a.known, b.known) and np.allclose(a.w, b.w)
    x, y = ({r.doc_id: r.score for r in quality.judge(docs, t).collect()} for t in (labels, wrong))
    assert all(abs(x[i] - y[i]) < 1e-6 for i in x)


def test_without_labels(spark):
    docs, labels = labelled(spark)
    none = labels.filter("doc_id < 0")
    assert {round(r.score, 6) for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {round(1 / (1 + np.exp(3)), 6)}
    assert {round(r.score, 6) for r in quality.judge(docs, none).collect()} == {0.5}
    contradicting = labels.union(labels.selectExpr("doc_id", "1 - quality", "1 - toxic"))
    assert {round(r.score, 6) for r in quality.judge(docs, contradicting).collect()} == {0.5}


def xor_data(n=2000):
    rng = np.random.default_rng(0)
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    noise = rng.random((n, 200)) < 0.3
    pairs = [(i, t) for i in range(n) for t, on in [(11, a[i]), (22, b[i]), *((100 + k, noise[i, k]) for k in range(200))] if on]
    doc, term = map(np.array, zip(*pairs, strict=True))
    return (a ^ b ^ True).astype(float), doc, term


def test_the_machine_sees_pairs():
    """Two terms that are toxic together, or both absent, and harmless alone, among others without a meaning: linear weights can't
    tell them. Fitted as shipped."""
    y, doc, term = xor_data()
    machine = toxicity.fit(y, doc, term)
    assert set(machine.known[machine.known < 2 * toxicity.LEVEL]) == {11, 22}
    z = np.full(len(y), machine.bias)
    for i in range(len(y)):
        own = np.flatnonzero(np.isin(machine.known, term[doc == i]))
        v = machine.V[own]
        z[i] += machine.w[own].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
    assert ((z > 0) == (y == 1)).mean() > 0.95


def test_toxicity_pairs_of_words(spark):
    """Through the whole of ``train`` and ``score``: a text is toxic with both words or neither."""
    r, docs, labels = random.Random(6), [], []
    for i in range(1500):
        words, a, b = text(i, 30).split(), r.random() < 0.5, r.random() < 0.5
        words = [w for w in words if w not in ("kolo", "peve")] + ["kolo"] * a + ["peve"] * b
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(a == b)))
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(frame, toxicity.train(frame, marks)).collect()
    assert accuracy(got, marks, "toxic") > 0.9


def test_scores_against_plain_sums(spark):
    """``Machine.scores`` recomputed from a text's words, one by one."""
    docs, labels = labelled(spark)
    machine = toxicity.train(docs, labels)
    texts = [t for _, t, *_ in odd_rows()] + [r.text for r in docs.limit(40).collect()]
    import pyarrow as pa

    def buckets(t):
        found = []
        for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode()):
            for piece, salt in [(word, 0), *((word[:n], n) for n in toxicity.BEGINNINGS if len(word) > n)]:
                h = bytewords.span_hashes(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))[0]
                found.append(int((h ^ np.uint64(salt)) >> np.uint64(64 - toxicity.BITS)))
        return found, len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode()))

    for t, p in zip(texts, machine.scores(pa.array(texts, pa.string())), strict=True):
        found, n = buckets(t)
        on = {b for b in found} | {b + toxicity.LEVEL for b in found if found.count(b) > 1} | {2 * toxicity.LEVEL + int(np.ceil(np.log2(n + 1)))}
        own = [k for k, f in enumerate(machine.known) if f in on]
        z = machine.bias + sum(machine.w[k] for k in own) + sum(float(machine.V[a] @ machine.V[b]) for i, a in enumerate(own) for b in own[:i])
        assert abs(p - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_learning_does_not_depend_on_the_layout(spark):
    docs, labels = labelled(spark)
    twice = docs.union(docs.selectExpr("doc_id", "concat(text, ' vilest vilest') as text"))  # every doc_id with two texts
    a, b = (toxicity.train(twice.repartition(n, "text"), labels) for n in (1, 5))
    assert np.array_equal(a.known, b.known) and np.allclose(a.w, b.w)


def test_statistics_of_a_text():
    import pyarrow as pa

    t = "One one | two, THREE 33 #x\nOne one\nOne one"
    got = dict(zip(quality.NAMES, quality.statistics(pa.array([t, None, ""], pa.string()))[0], strict=True))
    words = t.split()
    assert got["chars"] == np.log1p(len(t)) and got["words"] == np.log1p(len(words))
    lengths = np.array([len(w) for w in words])
    assert np.isclose(got["word_len"], np.log1p(lengths.mean())) and np.isclose(got["word_spread"], np.log1p(lengths.std()))
    for name, kind in (("upper", str.isupper), ("digits", str.isdigit), ("pipes", "|".__eq__), ("marks", ".,;:?'\"()-".__contains__), ("odd", "!#$%&*+<=>@[]^_`{}~\\/".__contains__)):
        assert np.isclose(got[name], np.sqrt(sum(map(kind, t)) / len(t))), name
    low = [w.lower() for w in words]
    assert got["high"] == 0 and np.isclose(got["types"], len(set(low)) / len(low) + 0.13 * np.log1p(len(low)))
    assert np.isclose(got["repeats"], np.sqrt(sum(a == b for a, b in zip(low, low[1:])) / len(low)))
    assert np.isclose(got["lines"], np.log1p(3) - 0.5 * np.log1p(len(low))) and np.isclose(got["line_repeats"], np.sqrt(1 - 2 / 3))
    for name, n in (("twice", 2), ("thrice", 3)):
        runs = [tuple(low[i : i + n]) for i in range(len(low) - n + 1)]
        assert np.isclose(got[name], np.sqrt(1 - len(set(runs)) / len(runs)))


def test_quality(spark):
    docs, labels = labelled(spark)
    assert accuracy(quality.judge(docs, labels).collect(), labels, "quality") > 0.95
    odd = quality.judge(widened(documents(spark)), labels).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert quality.judge(empty(spark), labels).count() == 0


def test_discriminant_is_the_normal_density_ratio():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (600, 3))]
    model = quality.discriminant(np.array([400.0, 600.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), pooled=0, diagonal=0)
    point = rng.normal(0, 2, (5, 3))
    logs = []
    for a in x:
        cov = a.T @ a / len(a) - np.outer(a.mean(0), a.mean(0)) + 1e-6 * np.eye(3)
        d = point - a.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.log(np.linalg.det(cov)))
    odds = model.prior + logs[1] - logs[0]
    assert np.allclose(model.scores(point), 1 / (1 + np.exp(-odds)))


def test_fingerprints_of_next_documents(spark):
    rows = [(i * 3, text(i, 3 + i * 5 % 200)) for i in range(150)] + [(1000, None), (1001, ""), (1002, "😀é" * 40), (1003, text(9, 9000))]
    got = fingerprints.compare_next(widened(spark.createDataFrame(rows, "doc_id long, text string")), parts=9).collect()
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    own = {r.doc_id: r for r in got}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        want = fingerprints.edited(t or "", nxt or "")
        r = own[i]
        assert (r.n_chars, r.edited_sha256) == (len(t or ""), hashlib.sha256(want.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprints([t or ""])[0].tobytes().hex()
        assert r.edited_fingerprint == fingerprints.fingerprints([want])[0].tobytes().hex()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    long = [r for r in got if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.1


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.compare_next(documents(spark)).collect()
    assert len(got) == len(odd_rows()) and sum(r.doc_id is None for r in got) == 2
    assert len({r.fingerprint for r in got if r.doc_id == 6}) == 1
    assert fingerprints.compare_next(empty(spark)).count() == 0
    alone = fingerprints.compare_next(documents(spark).filter("doc_id = 9")).first()
    assert alone.near_next == 1.0


def changed(r, t, k):
    t = list(t)
    for _ in range(k):
        i = r.randrange(len(t))
        t[i : i + r.choice((0, 1))] = r.choice((["q"], [], ["zz"]))
    return "".join(t)


def alike(a, b):
    return fingerprints.likeness(fingerprints.fingerprints(a), fingerprints.fingerprints(b))


def test_fingerprints_follow_edits():
    r, texts = random.Random(3), [text(i, 300) for i in range(30)]
    near = [alike(texts, [changed(r, t, k) for t in texts]).mean() for k in (0, 1, 8, 60, 400)]
    assert near[0] == 1 and near == sorted(near, reverse=True) and near[1] > 0.95 and near[2] > 0.9 and near[4] < 0.3
    # a batch gives what single texts give
    assert np.array_equal(fingerprints.fingerprints(texts), np.stack([fingerprints.fingerprints([t])[0] for t in texts]))


def test_fingerprints_follow_the_order_of_a_text():
    r, texts, shuffled, substituted = random.Random(5), [text(i, 400) for i in range(30)], [], []
    for t in texts:
        pieces = [t[i : i + 200] for i in range(0, len(t), 200)]
        r.shuffle(pieces)
        shuffled.append("".join(pieces))
        t = list(t)
        for i in r.sample(range(len(t)), len(t) * 54 // 1000):
            t[i] = "#"
        substituted.append("".join(t))
    assert alike(texts, shuffled).mean() < 0.25 and alike(texts, substituted).mean() > 0.7
    halves = [fingerprints.edited(t, u) for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert 0.5 < alike(texts, halves).mean() < 0.8 and alike(texts, texts[1:] + texts[:1]).mean() < 0.1


def test_fingerprints_against_plain_walks():
    """Each byte is that of the four characters where a walk, a character a step, stands."""
    mix = lambda x: int(fingerprints.mix(np.array([x % 2**64], np.uint64))[0])
    four, units, places = ([int(x) for x in fingerprints.seeds(n, salt)] for n, salt in ((4, 67), (fingerprints.PLACES, 61), (fingerprints.PLACES, 71)))
    names = [int(x) for x in fingerprints.seeds(fingerprints.WINDOW, 83)]
    for t in ("a", "ab c", text(3, 70), "😀é" * 300, text(4, 2500)):
        points, cuts = [ord(c) for c in t], [(0, 1)]
        run = lambda i: mix(sum(p * c for p, c in zip(points[i : i + fingerprints.WINDOW], names, strict=True)))  # noqa: B023, E731
        while len(t) - cuts[-1][0] > fingerprints.SHORTEST:
            at = cuts[-1][0] + fingerprints.SHORTEST
            while at < min(cuts[-1][0] + fingerprints.LONGEST, len(t)) and (at > len(t) - fingerprints.WINDOW or run(at) % fingerprints.EVERY):
                at += 1
            if at >= len(t):
                break
            cuts.append((at, run(at) if at <= len(t) - fingerprints.WINDOW else len(cuts)))
        every = []  # (unit's key, segment's start and end, first step, steps)
        for (a, anchor), (b, _) in zip(cuts, [*cuts[1:], (len(t), 0)], strict=True):
            for nth in range(-(-2 * (b - a) // fingerprints.UNIT)):
                key = mix(anchor + nth * 0x9E3779B97F4A7C15) | 1
                every.append((key, a, b, nth * fingerprints.UNIT, min(fingerprints.UNIT, 2 * (b - a) - nth * fingerprints.UNIT)))
        shift = len(every).bit_length()
        want = np.zeros(fingerprints.SLOTS, np.uint8)
        for p in range(fingerprints.PLACES):
            _, a, b, first, width = min(every, key=lambda u: mix(u[0] * units[p]) >> shift)
            step = first + min(range(width), key=lambda j: mix(places[p] * (j + 1)))
            for w in range(fingerprints.WALKS):
                at = a
                for j in range(step):
                    if at < b:
                        kind = w * 256 + (points[at] * 0x9E3779B1 % 2**32 >> 24)
                        word = mix((j // 64 * fingerprints.WALKS * 256 + kind) * 0x9E3779B97F4A7C15 + 977)
                        at += word >> (j % 64) & 1
                at = min(at, b - 1)
                seen = sum((points[at + k] + 1) * four[k] for k in range(4) if at + k < len(points))
                want[p * fingerprints.WALKS + w] = mix(seen) >> 56
        assert np.array_equal(fingerprints.fingerprints([t])[0], want)


def plain_links(prints, least):
    """All pairs that share a band and are that alike."""
    bands = prints.reshape(len(prints), fingerprints.PLACES // fingerprints.BAND, fingerprints.BAND, fingerprints.WALKS)
    share = lambda i, j: any((bands[i, k, :, k % fingerprints.WALKS] == bands[j, k, :, k % fingerprints.WALKS]).all() for k in range(bands.shape[1]))
    near = {(i, j): float(fingerprints.likeness(prints[i : i + 1], prints[j : j + 1])[0]) for i in range(len(prints)) for j in range(i + 1, len(prints))}
    return {p: n for p, n in near.items() if n >= least and share(*p)}, {p for p, n in near.items() if n >= least}


@pytest.mark.parametrize(("least", "block"), [(0.8, 2048), (0.9, 7)])
def test_near_links_connect_edited_copies(spark, monkeypatch, least, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    r, texts = random.Random(5), [text(i, 200) for i in range(25)]
    base = text(77, 300)
    texts += [changed(r, base, r.randint(0, 25)) for _ in range(45)] + [t + " tail" for t in texts[:12]]
    prints = fingerprints.fingerprints(texts)
    wanted, every = plain_links(prints, least)
    frame = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(prints)], "node long, print binary")
    got = {(x.u, x.v): x.near for x in fingerprints.near_links(frame, least).collect()}
    assert set(got) <= set(wanted) and all(abs(wanted[p] - near) < 1e-9 for p, near in got.items())
    assert union_find(got) == union_find(wanted)
    assert len(wanted) >= 0.9 * len(every)  # what the bands find of all pairs that alike


def test_near_groups(spark):
    docs = widened(documents(spark))
    found = fingerprints.near_groups(docs)
    got = fingerprints.compare_next(docs, groups=found).collect()
    assert len(got) == len(odd_rows())
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.near_class)
    assert by[6] == {6} and 6 in by[7] and by[8] == {6} and by[None] == {6, None} and by[1] == {1} and by[9] == {9}
    assert fingerprints.near_groups(empty(spark)).count() == 0


def test_the_order_is_split_wherever_rows_repeat(spark, monkeypatch):
    """A third of all rows without a doc_id, half of them alike: parts of the order still hold all neighbours."""
    rows = [(i, text(i, 5)) for i in range(40)] + [(None, "same text")] * 40 + [(None, text(100 + i, 4)) for i in range(20)] + [(7, "other")] * 3
    monkeypatch.setattr(fingerprints, "BROADCAST", 0)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    key = {(r.doc_id, r.text): r.m for r in frame.selectExpr("doc_id", "text", "xxhash64(text) as m").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), key[r], r[1]))
    want = sorted((i or -1, hashlib.sha256(fingerprints.edited(t, n[1]).encode()).hexdigest()) for (i, t), n in zip(order, order[1:] + order[:1], strict=True))
    for parts in (1, 6, 25):
        got = fingerprints.compare_next(frame, parts=parts, groups=fingerprints.near_groups(frame)).collect()
        assert sorted((r.doc_id or -1, r.edited_sha256) for r in got) == want
