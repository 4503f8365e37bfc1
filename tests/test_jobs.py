"""Jobs, providers, and what they leave behind, on small inputs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from quire.operators import jobs as J
from quire.operators import report as O
from quire.sources import payloads as P
from quire.sources import providers as V
from quire.sources.demo import demo_document


def test_first_gate_that_refuses(spark):
    rows = spark.createDataFrame([(1, None), (2, 7), (None, 1), (None, None)], "a int, b int")
    gates = [(F.col("a") == 1, 403, "a"), (F.col("b") > 5, 409, "b")]
    found = [tuple(r["o"]) for r in rows.select(J.outcome(gates).alias("o")).collect()]
    assert found == [(403, "a"), (409, "b"), (200, None), (200, None)]


def test_bootstrap_is_the_plain_resampling(spark):
    values = {k: (k * 37) % 11 for k in range(60)}
    rows = spark.createDataFrame([*values.items(), (100, None)], "k long, v long")
    means = []
    for b in range(1, 51):
        n = total = 0
        for k, v in values.items():
            u = int(hashlib.md5(f"{k}:{b}".encode()).hexdigest()[:8], 16) / 2**32
            w = sum(u >= p for p in J.POISSON)
            n, total = n + w, total + w * v
        means.append(total / n)
    got = J.bootstrap(rows, "k", "v", 50).first()
    assert got["pages"] == 60 and got["mean"] == round(np.mean(list(values.values())), 6)
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-6)
    assert tuple(J.bootstrap(rows.where("false"), "k", "v", 5).first()) == (0, None, None, None)


def test_poisson_weights_are_the_distribution(spark):
    e, total, term = [], 0.0, np.exp(-1)
    for i in range(len(J.POISSON)):
        term = term / i if i else term
        total += term
        e.append(total)
    assert J.POISSON == pytest.approx(e, abs=1e-7)


def test_compacted_payloads(spark):
    rows = spark.createDataFrame([('{"a":null,"b":{"c":[1,null]},"t":[1,2]}',), ("[1]",), ("no json",), (None,), ("{}",)], "p string")
    found = [r[0] for r in rows.select(J.compacted(F.col("p"), ["a", "b", "z"])).collect()]
    assert found == ['{"b":{"c":[1,null]}}', None, None, None, "{}"]


def test_resume(spark):
    requested = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 1)], "job int, page int")
    done = spark.createDataFrame([(1, 2), (1, 2), (2, 1)], "job int, page int")
    sources = spark.createDataFrame([(1, "a", "a"), (2, "a", "b")], "job int, sha_before string, sha_now string")
    found = {(r["job"], r["page"]): r["action"] for r in J.to_resume(requested, done, sources).collect()}
    assert found == {(1, 1): "process", (1, 2): "skip", (2, 1): "refuse", (3, 1): "refuse"}


def test_reversed_tokens(spark):
    rows = spark.createDataFrame([("a b c", "c b a"), ("a b a", "a b a"), ("a b", "b  a"), (None, "a"), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(J.reversed_tokens(F.col("a"), F.col("b"))).collect()] == [True, False, False, None, False]


def test_exports_and_counters(spark):
    docs = spark.createDataFrame([(1, None), (2, "no office")], "doc_id int, pdf_error string")
    found = {r["doc_id"]: r for r in J.exported(docs).collect()}
    assert set(found[1]["outputs"]) == {*J.OUTPUTS, "rendered_pdf"} and found[1]["available"]
    assert set(found[2]["outputs"]) == set(J.OUTPUTS) and found[2]["error"] == "no office" and not found[2]["available"]
    xml = '<w:p><w:bidi/><w:rtl/><w:rtl/></w:p><w:tbl></w:tbl><w:sectPr w:type="nextPage"/>'
    got = J.xml_counters(spark.createDataFrame([(1, xml, "abc", []), (2, "", "", ["x"])], "doc_id int, xml string, text string, missing array<string>")).collect()
    assert tuple(got[0]) == (1, 1, 1, 2, 1, 3, True) and tuple(got[1]) == (2, 0, 0, 0, 0, 0, False)


def test_costs(spark):
    prices = spark.createDataFrame([(1000, 200, 3.0, 15.0, 2, 1.5), (1000, 200, None, 15.0, 2, None)], "i int, o int, a double, b double, n int, p double")
    rows = prices.select(J.token_cost(*[F.col(c) for c in "ioab"]), J.page_cost(F.col("n"), F.col("p"))).collect()
    assert tuple(rows[0]) == pytest.approx((0.006, 0.003)) and tuple(rows[1]) == (None, None)


def test_unresolved_by_keys_that_are_null(spark):
    blocks = spark.createDataFrame([("T", True), ("T", False), (None, True)], "kind string, unresolved boolean")
    assert {tuple(r) for r in J.unresolved_by(blocks, "kind").collect()} == {("T", 2, 1), (None, 1, 1), ("total", 3, 2)}


def test_modes():
    none = V.Settings()
    assert V.bundle("local", none) == ("local", "local", "local", None, "disabled", None, False, False)
    assert V.bundle("local", V.Settings(windows=True), "every", visual_qa=True) == ("local", "local", "local", "windows", "gemini", "every", False, True)
    assert V.bundle("azure", none, "every", True) == ("azure", "azure", "full_page", None, "disabled", None, False, False)
    for mode, error in [("windows", RuntimeError), ("unlimited", RuntimeError), ("nothing", ValueError)]:
        with pytest.raises(error):
            V.bundle(mode, none)
    assert set(V.PARTS) == {row[0] for row in V.availability(none)} - {"gemini"} | {"mock"}


def test_preflight_and_settings():
    assert [V.preflight(s)[0] for s in (V.Settings(remote_endpoint="https://example.com"), V.Settings(), V.Settings(gpu_memory_mb=9000, quantized=True), V.Settings(gpu_memory_mb=9000))] == ["remote-stub", "local", "local-quantized-experimental", "local-bf16"]
    shown = V.public(V.Settings(azure_key="hidden", gemini_key="hidden"))
    assert "hidden" not in map(str, shown.values()) and shown["azure_key_configured"] and not shown["azure_endpoint_configured"]


def test_adjudicators(spark):
    rows = spark.createDataFrame([(1, [("a", 0.5), ("b", 0.9), ("c", 0.9)]), (2, []), (3, None)], "id int, candidates array<struct<text:string,confidence:double>>")
    chosen = [tuple(r)[2:] for r in V.MostConfident().decide(rows).orderBy("id").collect()]
    assert chosen == [("b", 0.9, False), (None, 0.0, True), (None, 0.0, True)]
    assert {tuple(r)[2:] for r in V.DisabledAdjudicator().decide(rows).collect()} == {(None, 0.0, True)}


def test_renderer_shows_what_is_approved(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "BODY_PARAGRAPH", "read", "approved"), (1, 2, 1, "BODY_PARAGRAPH", "kept", None)], "doc_id long, ord long, reading_order long, block_type string, literal string, approved string")
    pages = spark.createDataFrame([(1, "COMPLETED", None)], "doc_id long, status string, error string")
    body = lambda polished: [r["text"] for r in V.PlanRenderer().paragraphs(blocks, pages, polished).where("part = 'body'").orderBy("seq").collect()]
    assert body(False) == ["read", "kept"] and body(True) == ["approved", "kept"]


def test_readers(spark):
    pages = spark.createDataFrame([(1, 1, 800, 1000, '{"boxes":[{"label":"title","score":0.5,"coordinate":[0,0,10,10]}]}')], "doc_id long, page int, width int, height int, payload string")
    assert V.REGIONS["local"].regions(pages).first()["block_type"] == "HEADING_1"
    assert V.REGIONS["full_page"].regions(pages).first()["width"] == 800


def test_cells_without_tables(spark):
    pages = spark.createDataFrame([(1, 1, None), (1, 2, "{}"), (1, 3, '{"tables":[{"rows":1,"columns":1,"cells":[{"row":0,"column":0,"column_span":0}]}]}')], "doc_id long, page int, payload string")
    assert [tuple(r) for r in P.cloud_cells(pages).collect()] == [(1, 3, 0, 0, 0, 1, 1, "")]


def test_demo_document_comes_back(spark, tmp_path):
    made = demo_document(spark)
    P.write_documents(made.unionAll(made.withColumn("id", F.lit("other"))), str(tmp_path / "docs"))
    back = P.documents(spark, str(tmp_path / "docs")).orderBy("id").collect()
    assert [r["id"] for r in back] == ["demo", "other"]
    assert back[0] == made.first()


def test_benchmark_admission(spark):
    documents = spark.createDataFrame([(1, "EVALUATION_ONLY"), (2, "EVALUATION_ONLY"), (3, "PUBLIC"), (4, "EVALUATION_ONLY")], "doc int, classification string")
    pages = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 5), (3, 5), (3, 6)], "doc int, page int")
    required = spark.createDataFrame([(5,), (6,)], "page int")
    found = {tuple(r) for r in J.benchmark_admission(documents, pages, required).collect()}
    assert found == {(1, 200, None, 0), (2, 409, "pages are missing", 1), (3, 409, "not for evaluation only", 0), (4, 409, "pages are missing", 2)}


def test_failed_pages_are_queued(spark):
    queue = spark.createDataFrame([(1, True, False), (2, False, False), (3, False, True)], "doc_id int, a boolean, b boolean")
    pages = spark.createDataFrame([(2, False), (3, True), (4, True), (4, True), (5, None)], "doc_id int, failed boolean")
    assert {tuple(r) for r in J.queued(queue, pages).collect()} == {(1, True, False, False), (3, False, True, True), (4, False, False, True)}


def test_formatting_that_is_null_inherits(spark):
    blocks = spark.createDataFrame([(1, 1, "CAPTION"), (1, 2, "TABLE"), (1, 3, "TABLE")], "doc_id int, ord int, block_type string")
    told = spark.createDataFrame([(1, 1, "LEFT", "SMALL", True), (1, 2, "sideways", "huge", None), (9, 9, "LEFT", "SMALL", True)], "doc_id int, ord int, alignment string, size string, bold boolean")
    assert {tuple(r) for r in O.formatted(blocks, told).collect()} == {(1, 1, "OCR Caption", "LEFT", 10, True), (1, 2, "Normal", None, None, None), (1, 3, "Normal", None, None, None)}
