"""Gates, policies, corrections and patches on small inline cases."""

import pytest
from pyspark.sql import functions as F
from quire.functions import text as T
from quire.operators import corpus as C
from quire.operators import metrics as E
from quire.operators import review as R
from quire.operators import spans


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_page_selection(spark):
    pages = lambda s, n: one(spark, R.selected_pages(F.lit(s), F.lit(n)))
    assert pages("smoke", 9) == [1, 2, 3, 4, 5] and pages("first5", 2) == [1, 2] and pages(" 3,1 , 3", 4) == [1, 3]
    for wrong in ("0", "7", "x", ""):
        with pytest.raises(Exception, match="pages must be within"):
            pages(wrong, 4)


def test_consent(spark):
    none = F.lit(None).cast("array<int>")
    both = F.array(F.lit("azure"), F.lit("gemini"))
    allowed = lambda provider, page, opt, providers, pages: one(spark, R.consent(F.lit(provider), F.lit(page), F.lit(opt), providers, pages))
    assert allowed("azure", 2, True, both, none)
    assert not allowed("azure", 2, False, both, none)
    assert not allowed("other", 2, True, both, none)
    assert not allowed("azure", 2, True, both, F.array(F.lit(1)))
    assert not one(spark, R.crop_consent(F.lit(1), F.lit(True), F.lit(True), both, none, F.lit(False)))


@pytest.mark.parametrize(("mode", "device", "opt", "formatting", "full", "pages", "confirmed", "code"), [("nope", "cpu", True, "off", True, 1, True, 422), ("local", "tpu", True, "off", True, 1, True, 422), ("azure", "cpu", False, "off", True, 1, True, 403), ("local", "cpu", True, "structural", False, 1, True, 403), ("local", "cpu", True, "off", False, 6, False, 409), ("local", "cpu", False, "off", False, 5, False, 200)])
def test_admission(spark, mode, device, opt, formatting, full, pages, confirmed, code):
    lit = F.lit
    assert one(spark, R.admission(lit(mode), lit(device), lit("off"), lit(formatting), lit(False), lit(opt), lit(full), lit(pages), lit(confirmed), lit(True), lit(True))) == code


def test_verification_policy(spark):
    reasons = lambda scope, kind, text, conf=0.7: one(spark, R.verification_reasons(scope, F.lit(kind), F.lit(text), F.lit(conf), F.lit(False), F.lit(False), F.lit("RTL")))
    got = reasons("important", "BODY_PARAGRAPH", "النص الحرفي 25 m/s")
    assert {"low-confidence", "English", "digits-or-percentage"} <= set(got)
    assert reasons("off", "BODY_PARAGRAPH", "x") == []
    assert reasons("every", "FIGURE", "x") == [] and reasons("every", "BODY_PARAGRAPH", "  ") == []
    assert reasons("every", "BODY_PARAGRAPH", "x") == ["every-text-block"]


def test_automatic_corrections(spark):
    schema = "k int, literal string, block_type string, selected string, decision_confidence double, decision_unresolved boolean, visual boolean"
    rows = [(1, "نص خام", "BODY_PARAGRAPH", "نص مرئي", 0.99, False, True), (2, "الدرجة 25", "BODY_PARAGRAPH", "الدرجة ٢٥", 0.99, False, True), (3, "نص", "BODY_PARAGRAPH", None, 0.99, False, True), (4, "نص", "BODY_PARAGRAPH", "آخر", 0.99, False, False)]
    got = {r.k: r for r in R.automatic_correction(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].approved, got[1].unresolved_after) == ("نص مرئي", False)
    assert (got[2].approved, got[2].unresolved_after, got[2].protected) == (None, True, ["numbers or dates"])
    assert (got[3].approved, got[3].unresolved_after) == (None, True)
    assert (got[4].approved, got[4].unresolved_after) == (None, True)


def test_patches_keep_the_literal_text(spark):
    base = spark.createDataFrame([(1, 0, "TABLE", "lit", None, True), (1, 1, "TABLE", "lit", None, True)], "doc_id long, ord long, block_type string, literal string, approved string, unresolved boolean")
    patches = spark.createDataFrame([(1, 0, 1, "a", None), (1, 0, 2, None, "FIGURE"), (1, 0, 3, "b", None)], "doc_id long, ord long, seq long, approved string, block_type string")
    got = {r.ord: r for r in R.patched(base, patches, ["approved", "block_type"]).collect()}
    assert (got[0].approved, got[0].block_type, got[0].unresolved, got[0].literal, got[0].patches) == ("b", "FIGURE", False, "lit", 3)
    assert (got[1].approved, got[1].unresolved, got[1].patches) == (None, True, 0)


def test_rates_and_bags(spark):
    assert one(spark, E.rate(F.lit(3), F.lit(0))) is None and one(spark, E.rate(F.lit(3), F.lit(2))) == 1.5
    assert one(spark, E.accuracy(F.lit(3), F.lit(2))) == 0.0
    bag = lambda *keys: spark.createDataFrame([(1, k) for k in keys], "doc_id long, k string")
    assert E.bag_f1(bag("a", "a", "b"), bag("a", "c"), "doc_id", "k").first().f1 == 0.4
    assert E.bag_f1(bag("a"), bag("c"), "doc_id", "k").first().f1 == 0.0


def test_text_rules(spark):
    kind = lambda k, t, c=0.9, n=1: one(spark, T.refined_type(F.lit(k), F.lit(t), F.lit(c), F.lit(n)))
    assert kind("UNKNOWN", "سؤال: ما؟") == "QUESTION" and kind("BODY_PARAGRAPH", "• x") == "BULLET_LIST" and kind("BODY_PARAGRAPH", "3) x") == "QUESTION"
    assert kind("UNKNOWN", "short") == "HEADING_3" and kind("UNKNOWN", "short", 0.5) == "UNKNOWN" and kind("TABLE", "• x") == "TABLE"
    assert one(spark, T.html_escaped(F.lit("<a href=\"x\">'&"))) == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"
    assert one(spark, T.squeezed(F.lit(" a  \n b "))) == "a b"
    assert one(spark, T.nfc(F.lit("é"))) == "é"


def test_spans_and_contamination(spark):
    docs = spark.createDataFrame([(1, "aa  b " + "c" * 1500 + " d"), (2, "")], "doc_id long, text string")
    words = spans.words(docs)
    assert [(r.start, r.length) for r in words.where("doc_id = 1").orderBy("start").collect()] == [(0, 2), (3, 0), (4, 1), (6, 1500), (1507, 1)]
    ranges = spark.createDataFrame([(1, 7, 0, 5), (1, 8, 1500, 1600)], "doc_id long, span long, `from` long, to long")
    assert sorted((r.span, r.start) for r in spans.inside(words.where("length > 0"), ranges).collect()) == [(7, 0), (7, 4), (8, 1507)]
    item = "one two three four five six seven eight nine"
    bench = spark.createDataFrame([(5, item), (6, "too short"), (7, "few words here"), (8, "two  blanks\nhere"), (9, ""), (10, None), (11, "lone")], "item_id long, text string")
    texts = spark.createDataFrame([(1, f"x {item} y"), (2, "one two three four five six seven eight ten"), (3, None), (4, "(few words here) not too short"), (5, "two blanks here, two  blanks\nhere"), (6, f"x{item}y alone"), (6, f"x{item}y alone"), (7, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in C.contamination(texts, bench).collect()) == [(1, 5), (4, 6), (4, 7), (5, 8), (6, 5)]
    assert C.contamination(texts, bench.limit(0)).count() == 0
