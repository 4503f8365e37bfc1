"""Fingerprints, top-k search and HTML against plain reckoning."""

import hashlib
import random
import re
import time

import numpy as np
import xxhash
from quire.llm import fingerprint as G
from quire.llm import html as H
from quire.llm import topk
from quire.llm.shingles import shingle_hashes


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_shingle_hashes_are_one_to_one():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "B", "b", "é", "Éa", "x1", ".", " q"]) for _ in range(rng.randint(0, 30))).replace(" ", rng.choice([" ", "\n", "\t\x0b "])) for _ in range(200)]
    hashes = shingle_hashes([t.encode() for t in texts])
    by_hash = {}
    for t, h in zip(texts, hashes, strict=True):
        assert len(h) == len(shingles(t))
        for x in h.tolist():
            by_hash.setdefault(x, []).append(shingles(t))
    for a, ha in zip(texts, hashes, strict=True):
        for b, hb in zip(texts[:20], hashes[:20], strict=True):
            assert len(np.intersect1d(ha, hb)) == len(shingles(a) & shingles(b))


def test_sketches_estimate_and_merge():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    a = " ".join(rng.choice(words) for _ in range(4000))
    b = a[: len(a) // 2] + " " + " ".join(rng.choice(words) for _ in range(2000))
    sa, sb = G.sketches([a, b])
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs(G.resemblance(sa, sb) - true) < 0.15
    assert abs(G.containment(sa, sb) - len(shingles(a) & shingles(b)) / len(shingles(a))) < 0.2
    assert 0.75 < G.distinct(sa) / len(shingles(a)) < 1.3
    assert (G.read(G.written(sa)) == sa).all()
    left, right, both = (np.unique(np.concatenate(shingle_hashes([t.encode()]))) >> np.uint64(16) for t in (a, b, a))
    assert (G.merge(np.unique(left)[: G.K], np.unique(right)[: G.K]) == np.unique(np.concatenate([left, right]))[: G.K]).all()
    empty = G.sketches([""])[0]
    assert G.resemblance(empty, empty) == 1.0 and G.resemblance(empty, sa) == 0.0 and G.containment(empty, sa) == 1.0


def check_edited(spark, rows):
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in G.edited(spark.createDataFrame(rows, "doc_id long, text string, run int")).collect()), key=str)
    signed = lambda t: (xxhash.xxh64((t or "").encode(), seed=42).intdigest() + (1 << 63)) % (1 << 64)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    wanted = []
    for i, (d, t, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t)
        wanted.append((d, n, hashlib.sha256((t[: n - n // 2] + after[: n // 2]).encode()).hexdigest()))
    assert got == sorted(wanted, key=str)


def test_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS", 3)
    rng = random.Random(6)
    rows = [(rng.choice([i, i * 10**6, -i]), rng.choice([None, "", "é😀 word", "x " * rng.randint(1, 200)]) if rng.random() < 0.3 else f"text {i} " * rng.randint(1, 40), 0) for i in range(60)]
    rows = list({r[0]: r for r in rows}.values()) + [(None, "null", 0)]
    check_edited(spark, rows)
    check_edited(spark, [*((i, f"dense {i} " * 5, 0) for i in range(40)), (1 << 60, "far away", 0), (-(1 << 62), "below", 0)])
    check_edited(spark, [*((7, f"same id {i}", 0) for i in range(25)), *((None, f"no id {i}", 0) for i in range(25)), (3, "x", 0)])
    check_edited(spark, [(5, "alone here", 0)])
    check_edited(spark, [(5, "same", 0), (5, "same", 0), (5, "other", 0), (4, None, 0)])
    assert G.edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_texts_and_likeness(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = G.edited(docs).collect()
    prints = {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert {r.doc_id: r.fingerprint for r in G.fingerprints(docs).collect()} == {r.doc_id: r.fingerprint for r in rows}


def test_runs_are_even(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS", 50)
    rows = [(i, f"t {i}") for i in range(1000)] + [(1 << 60, "far")] + [(None, f"n {i}") for i in range(500)] + [(77, f"s {i}") for i in range(500)]
    docs = spark.createDataFrame([(~i if i is not None else (1 << 63) - 1, hash(t)) for i, t in rows], "place long, hash long")
    sizes = [r["count"] for r in G._runs(docs).groupBy("run").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 200


def test_likeness_against_whole_sets(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 400))]
        rows.append((2 * i, " ".join(words)))
        rows.append((2 * i + 1, " ".join(w if rng.random() < 0.97 else "other" for w in words)))
    texts = dict(rows)
    share = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) if shingles(a) | shingles(b) else 1.0
    for r in G.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own, after = texts[r.doc_id], texts[r.doc_id - 1 if r.doc_id else 79]
        changed = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        for told, other in ((r.near_next, after), (r.near_edited, changed)):
            true = share(own, other)
            assert abs(told - true) < (0.2 if len(shingles(own) | shingles(other)) > G.K else 1e-9)


def brute_top(rows, k=10):
    seen = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        seen.setdefault(i, []).append(tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v))
    out = []
    for q, vs in seen.items():
        if q % 100 == 0:
            query = min(vs)
            found = sorted((-sum(a * b for a, b in zip(query, c, strict=True)), i) for i, cs in seen.items() if i != q for c in cs if len(c) == len(query))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 2)
    monkeypatch.setattr(topk, "FIRST", 12)
    monkeypatch.setattr(topk, "TILE", 64)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 20).round(1 if i % 3 else 6)]) for i in range(601)]
    rows += [(100, rows[5][1]), (7, rows[7][1]), (700, None), (None, rows[1][1]), (800, [float("nan")] * 20), (900, [None] + [1.0] * 19), (901, []), (902, [1.0, 2.0]), (1000, [float("inf")] * 20)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, df.where("vec_id % 100 = 0")).collect())
    assert got == brute_top(rows)
    huge = [(i, [float(np.float32(x * 4e4)) for x in rng.normal(0, 1, 5)]) for i in range(120)] + [(i, [0.01 * i] * 5) for i in range(120, 140)]
    big = spark.createDataFrame(huge, "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(big, big.where("vec_id % 100 = 0")).collect()) == brute_top(huge)
    vast = [(i, [float(10.0 ** rng.integers(5, 14) * rng.choice([-1, 1])), float(rng.normal()), 1e12]) for i in range(130)] + [(200, [1e200, -1e200, 3.0]), (201, [1e308, 1.0, 1.0])]
    wide = spark.createDataFrame(vast, "vec_id long, embedding array<double>")
    exact = {i: [int(np.floor(1024 * x)) if 1024 * x < 2.0**53 else 1024 * int(x) for x in v] for i, v in vast if i != 201}
    wanted = []
    for q in (0, 100, 200):
        found = sorted((-sum(a * b for a, b in zip(exact[q], c, strict=True)), i) for i, c in exact.items() if i != q)[:10]
        wanted += [(q, rank, i, max(min(-s, (1 << 63) - 1), -(1 << 63))) for rank, (s, i) in enumerate(found, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(wide, wide.where("vec_id % 100 = 0")).collect()) == wanted
    few = df.where("vec_id < 4")
    assert len(topk.search(few, few.where("vec_id % 100 = 0")).collect()) == 3
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_html():
    assert H.render(None) == H.render("") == ""
    assert H.render("<p>a<p>b") == "a\n\nb"
    assert H.render("x<script>no</script><style>p{}</style><div hidden>no</div><i style='DISPLAY : none'>no</i>y") == "xy"
    assert H.render("<ul><li>x<li>y<ol start=3><li>n<li>m</ol></ul>") == "- x\n- y\n  3. n\n  4. m"
    assert H.render("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>") == "a     bbb\ncccc  d"
    assert H.render("<pre>1\n  2</pre>a  \n b<br>c") == "1\n  2\n\na b\nc"
    assert H.render("&amp;&eacute; < 3 <b") == "&é < 3 <b"
    assert H.render("<head><title>no</title></head><body><h1>T</h1><p>x</p></body>") == "T\n\nx"
    assert H.render("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert H.render("<table><tr><td>" * 400 + "deep").strip().endswith("deep")
    assert H.render("<!-- <p>no</p> -->a<![CDATA[b]]>") == "ab"
    assert H.render("</p></div></table>x") == "x"


def test_html_tables_lose_nothing():
    assert H.render("<table><thead><th>A<th>B</thead><tbody><td>x<td>y</table>") == "A  B\nx  y"
    assert H.render("<table><tbody><td>a</td></tr><td>b</table>z") == "a\nb\n\nz"
    assert H.render("<table><td>a<td>b<tr><td>c</table>") == "a  b\nc"
    assert H.render("<table><tbody><form><tr><td>a<td>b</tr></form></tbody></table>") == "a  b"
    assert H.render("<table><tr><form><td>a<td>b</form><td>c</table>") == "a  b  c"
    assert H.render("<table><tbody>s <b>t</b> <i>u</i><tr>v<div>w</div><td>x</td></tr><p>y</p></tbody></table>") == "s t u\nv\nw\ny\nx"
    assert H.render("<table><colgroup><col><tr><td>x<td>y</table>") == "x  y"
    assert H.render("<table><caption>T<tr><td>x<td>y</table>") == "T\nx  y"
    assert H.render("<table><tr><td>o<table><td>i</table>p<td>q</table>").split() == ["o", "q", "i", "p"]
    assert H.render("<table><tbody hidden><td>no</tbody><tr hidden><td>no<tr><td hidden>no<td>x<template>no</template></table>") == "x"


def test_html_shows_what_is_visible():
    for source, text in [
        ("<p title=it's>Hello", "Hello"),
        ("<p title=\"it's>Hello", "Hello"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<span aria-hidden=true>x</span>y", "xy"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<svg><title>no</title><text>in</text></svg>", "in"),
        ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>xxx<td>yy<td>z</table>", "ab       c\nxxx  yy  z"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>" + "w" * 70 + "<td>b<tr><td>c<td>d</table>", "w" * 70 + "  b\nc" + " " * 71 + "d"),
        ("<a <a <a", "<a <a <a"),
        ("<img alt='A &amp; B'>", "A & B"),
        ("<a b='>'>x <a b='", "x <a b='"),
    ]:
        assert H.render(source) == text, source


def test_broken_pages_take_linear_time():
    for part in ("<a ", '<a title="', "<p title='x>", "<![CDATA[", "<!--", "</x ", "<", "=", "<script>", "<div>", "<table><tr><td>", "<li>", '<a b=">" ', "<td>"):
        page = part * (1_000_000 // len(part))
        began = time.process_time()
        H.render(page)
        H.render(page + ">")
        assert time.process_time() - began < 60, part


def test_html_holds_every_visible_word(spark):
    """Against a plain strip of tags: same words in the same order, apart from list marks."""
    import html as std

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        plain = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r.html)
        plain = re.sub(r"</?(?:b|i|a|em|strong|span|u|code)\b[^>]*>", "", plain)
        words = std.unescape(re.sub(r"<[^>]+>", " ", plain)).split()
        assert [w for w in got[r.page_id].split() if w != "-"] == [w for w in words if w != "-"]
    rows = spark.createDataFrame([(1, None, 2), (1, None, 2), (None, "<p>x", 2)], "page_id long, html string, text int")
    assert sorted(r.text for r in H.extract(rows).collect()) == ["", "", "x"]
