"""Layout rules on small inline pages."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.functions import geometry as G
from quire.functions import text as T
from quire.functions.distance import distance, edit_distance
from quire.operators import layout as L
from quire.operators import matching as M
from quire.operators import metrics as E

LINE = "doc_id long, ln long, text string, x double, y double, width double, height double, conf100 long"
REGION = "doc_id long, ord long, block_type string, x double, y double, width double, height double, conf100 long"


def order(blocks, width=1000.0):
    boxes = np.asarray([b[1:] for b in blocks], dtype=float).reshape(-1, 4).T
    return [blocks[i][0] for i in L.page_order(boxes, width)]


def test_two_columns_from_the_right():
    blocks = [("left-2", 100, 300, 350, 100), ("right-1", 550, 100, 350, 100), ("left-1", 100, 100, 350, 100), ("right-2", 550, 300, 350, 100)]
    assert order(blocks) == ["right-1", "right-2", "left-1", "left-2"]


def test_heading_above():
    assert order([("sub", 780, 260, 120, 50), ("heading", 325, 100, 350, 50)]) == ["heading", "sub"]


def test_wide_block_parts_bands():
    blocks = [("wide", 50, 300, 900, 50), ("r1", 550, 100, 350, 100), ("l1", 100, 100, 350, 100), ("r2", 550, 400, 350, 100), ("l2", 100, 400, 350, 100), ("inside", 100, 320, 100, 10)]
    assert order(blocks) == ["r1", "l1", "wide", "r2", "l2", "inside"]


def test_flat_separator_comes_twice():
    assert order([("flat", 0, 100, 900, 0), ("next", 0, 200, 900, 10)]) == ["flat", "flat", "next"]


def test_empty_and_single_pages():
    assert order([]) == [] and order([("a", 0, 0, 10, 10)]) == ["a"]


def test_smallest_region_wins(spark):
    lines = spark.createDataFrame([(1, i, "x", 700.0, y, 120.0, 40.0, 90) for i, y in enumerate((80.0, 300.0, 900.0))], LINE)
    regions = spark.createDataFrame([(1, 0, "BODY_PARAGRAPH", 100.0, 20.0, 800.0, 450.0, 50), (1, 1, "BODY_PARAGRAPH", 650.0, 50.0, 250.0, 120.0, 50), (1, 2, "BODY_PARAGRAPH", 650.0, 270.0, 250.0, 120.0, 50)], REGION)
    assert {r.ln: r.ord for r in L.assign(lines, regions).collect()} == {0: 1, 1: 2, 2: None}
    blocks = {r.ord: r for r in L.blocks(lines, regions).collect()}
    assert set(blocks) == {1, 2, 1000002}  # the parent has no lines and goes; a line outside is its own block


def bounds(spark, kind, *lines):
    rows = [(1, 0, kind, i, t, x, y, w, h, 90) for i, (t, x, y, w, h) in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, block_type string, ln long, text string, x double, y double, width double, height double, conf100 long")
    return [(r.boundary, round(r.boundary_confidence, 6)) for r in L.boundaries(df).orderBy("ln").collect() if r.boundary]


@pytest.mark.parametrize(
    ("kind", "second", "first", "y", "expected"),
    [
        ("BODY_PARAGRAPH", "مستمرة هنا.", "هذه جملة", 150.0, ("CONTINUE_WITH_SPACE", 0.76)),
        ("BULLET_LIST", "• الثاني", "• الأول", 160.0, ("LIST_ITEM_BOUNDARY", 0.96)),
        ("TABLE", "b", "a", 150.0, ("TABLE_CELL_BOUNDARY", 0.98)),
        ("BODY_PARAGRAPH", "b", "a", 240.0, ("BLANK_PARAGRAPH_SPACE", 0.98)),
        ("BODY_PARAGRAPH", "b", "a.", 180.0, ("NEW_PARAGRAPH", 0.88)),
        ("BODY_PARAGRAPH", "b", "a-", 150.0, ("CONTINUE_WITHOUT_SPACE", 0.8)),
        ("CAPTION", "b", "a", 170.0, ("SOFT_LINE_BREAK", 0.78)),
    ],
)
def test_boundaries(spark, kind, second, first, y, expected):
    assert bounds(spark, kind, (first, 300.0, 100.0, 600.0, 40.0), (second, 300.0, y, 600.0, 40.0)) == [expected]


def test_table_grid():
    names = iter(["الفصل", "العدد", "الصفحة", "الأول", "25", "7"])
    lines = [{"text": next(names), "x": x, "y": y, "width": 120.0, "height": 40.0} for y in (100.0, 250.0) for x in (760.0, 420.0, 80.0)]
    table = L.inferred_table(lines, 920.0)
    assert (table["rows"], table["columns"], table["cells"][0]["text"]) == (2, 3, "الفصل")
    assert L.inferred_table(lines[:3], 920.0) is None
    assert L.clustered([], 1.0) == [] and L.clustered([0.0, 4.0, 9.0], 5.0) == [[0, 1], [2]]


@pytest.mark.parametrize("text", ["تحدث عملية Photosynthesis داخل النبات.", "افتح Chapter 3 ثم أجب.", "درجة الحرارة 25°C.", "H2O هو رمز الماء.", "... a", "", "٢٥"])
def test_runs_hold_the_text(spark, text):
    runs = T.segment(text)
    assert "".join(r["text"] for r in runs) == text
    assert all(a["script"] != b["script"] for a, b in zip(runs, runs[1:], strict=False))
    if text == "٢٥":
        assert runs[0]["script"] == "ARABIC"


def plain_distance(a, b):
    row = np.arange(len(b) + 1)
    codes = {x: i for i, x in enumerate({*a, *b})}
    other = np.asarray([codes[y] for y in b])
    for i, x in enumerate(a, 1):
        # Without insertions, then with: the least of what stands left of a place, a step each.
        up = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (other != codes[x]))])
        row = np.minimum.accumulate(up - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def test_distances_by_brute_force(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    pairs += [(["x", "y"], []), ([], []), (list("كتاب"), list("كتب"))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    wanted = {i: plain_distance(a, b) for i, (a, b) in enumerate(pairs)}
    assert {r.i: r.d for r in df.select("i", distance(F.col("a"), F.col("b")).alias("d")).collect()} == wanted
    text = lambda c: F.array_join(c, "")
    assert {r.i: r.d for r in df.select("i", distance(text("a"), text("b")).alias("d")).collect()} == wanted


@pytest.mark.parametrize("n", [5000, 20000])
def test_distance_of_many_distinct_tokens(n):
    assert edit_distance([f"a{i}" for i in range(n)], [f"b{i}" for i in range(n)]) == n
    rng = random.Random(n)
    a = [str(rng.randint(0, n)) for _ in range(n // 4)]
    b = [x if rng.random() < 0.8 else str(rng.randint(0, n)) for x in a if rng.random() < 0.9]
    assert edit_distance(a, b) == plain_distance(a, b)


def test_pages_are_measured_whole(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abeé25,٣ ") for _ in range(rng.randint(1, 9)))
    schema = "doc_id long, ord long, reading_order long, literal string"
    truth = [(d, o, o, " ".join(word() for _ in range(60))) for d in range(4) for o in range(3)]
    theirs = [(d, o, o, t.replace("e", "c") if o else t[10:]) for d, o, _, t in truth if (d, o) != (2, 1) and d != 3]
    page = lambda rows, d: "\n".join(unicodedata.normalize("NFC", t) for k, _, _, t in rows if k == d)
    texts = E.page_text(spark.createDataFrame(truth, schema), F.col("literal")).withColumnRenamed("text", "a").join(E.page_text(spark.createDataFrame(theirs, schema), F.col("literal")).withColumnRenamed("text", "b"), "doc_id", "left").fillna("")
    got = {r.doc_id: r for r in E.error_rates(texts).collect()}
    tokens = {r.doc_id: r for r in E.token_accuracy(texts, {"digit": T.DIGITS, "english": T.ENGLISH, "punctuation": r"\p{P}"}).collect()}
    for d in range(4):
        a, b = page(truth, d), page(theirs, d)
        assert (got[d].n_chars, got[d].distance, got[d].n_words, got[d].word_distance) == (len(a), plain_distance(a, b), len(a.split()), plain_distance(a.split(), b.split()))
        assert got[d].cer == round(plain_distance(a, b) / len(a), 6) and got[d].wer == round(plain_distance(a.split(), b.split()) / len(a.split()), 6)
        for name, pattern in (("digit", T.DIGITS), ("english", T.ENGLISH), ("punctuation", ",")):
            p, q = re.findall(pattern, a), re.findall(pattern, b)
            assert tokens[d][f"{name}_accuracy"] == round(max(0.0, 1 - plain_distance(p, q) / len(p)), 6)


def test_unreviewed_pages_are_refused(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    reviews = spark.createDataFrame([(1, True), (2, False)], "doc_id long, reviewed boolean")
    assert [r.doc_id for r in E.gated(pages, reviews).collect()] == [1]
    with pytest.raises(Exception, match="a human has reviewed"):
        E.gated(pages, reviews, strict=True).collect()


def test_greedy_matches_by_brute_force(spark):
    rng = random.Random(3)
    box = lambda: (float(rng.randint(0, 300)), float(rng.randint(0, 300)), float(rng.randint(0, 120)), float(rng.randint(0, 120)))
    schema = "doc_id long, ord long, reading_order long, block_type string, x double, y double, width double, height double"
    a, b = ([(1, i, i, rng.choice(["TABLE", "FIGURE"]), *box()) for i in range(25)] for _ in range(2))

    def iou(p, q):
        w = max(0.0, min(p[4] + p[6], q[4] + q[6]) - max(p[4], q[4]))
        h = max(0.0, min(p[5] + p[7], q[5] + q[7]) - max(p[5], q[5]))
        u = p[6] * p[7] + q[6] * q[7] - w * h
        return w * h / u if u > 0 else 0.0

    pairs = sorted(((-iou(p, q), p[1], q[1]) for p in a for q in b))
    seen_a, seen_b, best = set(), set(), set()
    for s, i, j in pairs:
        if -s < 0.05:
            break
        if i not in seen_a and j not in seen_b:
            seen_a.add(i), seen_b.add(j), best.add((i, j))
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    assert {(r.ord, r.hyp_ord) for r in M.truth_to_hypothesis(left, right).collect()} == best
    used, turn = set(), set()
    for p in a:
        free = [(-(iou(p, q) + 0.05 * (p[3] == q[3])), q[1]) for q in b if q[1] not in used]
        s, j = min(free)
        if -s >= 0.2:
            used.add(j), turn.add((p[1], j))
    found = M.primary_to_verifier(left, right)
    assert {(r.ord, r.verifier_ord) for r in found.collect()} == turn
    rest = M.verifier_only(right.withColumn("literal", F.lit("x")), found)
    assert {r.ord for r in rest.collect()} == {q[1] for q in b} - used
    assert M.truth_to_hypothesis(left.limit(0), right).count() == 0


def test_figure_and_crop(spark):
    w, h = G.figure_inches(F.lit(200.0), F.lit(800.0), F.lit(2000.0))
    row = spark.range(1).select(F.round(w, 3).alias("w"), G.crop_box(F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(0.25), F.lit("normalized"), F.lit(100), F.lit(200)).alias("c")).first()
    assert row.w == 0.687 and (row.c.left, row.c.top, row.c.right, row.c.bottom) == (50, 100, 51, 150)
