"""Queries over jobs: admission, resumption, roll-ups, reports, exports, providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import jobs as J
from quire.operators import metrics as E
from quire.operators import report as O
from quire.operators import review as R
from quire.plans.layout_queries import all_blocks
from quire.plans.metric_queries import page_metric_bundle
from quire.plans.registry import query
from quire.plans.review_queries import _PAIR_SQL, _STYLE_SQL, _with_verifier
from quire.sources import demo, providers
from quire.sources import derived as S
from quire.sources import payloads as P

_GATES_SQL = [
    ("mode = 'other'", 422, "unknown mode"),
    ("device = 'tpu'", 422, "unknown device"),
    ("(az OR ge) AND NOT opt_in", 403, "cloud needs consent"),
    ("looks", 403, "visual checks are disabled"),
    ("formats AND NOT full_page", 403, "full pages need consent of their own"),
    ("mode = 'unlimited'", 503, "no GPU was found"),
    ("size > 524288000", 413, "too large"),
    ("size < 5 OR signature <> '%PDF-'", 422, "no PDF"),
    ("pages IS NULL", 422, "the PDF cannot be read"),
    ("pages > 5 AND NOT confirmed", 409, "more than five pages need a confirmation"),
]


def _first(gates: list[tuple[str, int, str]]) -> str:
    code = "CAST(CASE " + " ".join(f"WHEN {c} THEN {n}" for c, n, _ in gates) + " ELSE 200 END AS INTEGER) AS code"
    return code + ", CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, _, t in gates) + " END AS reason"


@query(f"""WITH r AS (SELECT event_id AS e, [{', '.join(repr(m) for m in R.MODES)}, 'other'][CAST(event_id % 9 + 1 AS INTEGER)] AS mode, CASE WHEN event_id % 23 = 0 THEN 'tpu' ELSE 'cpu' END AS device, event_id % 4 = 0 AS verifies, event_id % 6 = 1 AS formats, event_id % 8 = 3 AS looks,
  event_id % 5 <> 0 AS opt_in, event_id % 3 <> 0 AS full_page, (event_id % 600) * 1048576 AS size, CASE WHEN event_id % 29 = 0 THEN 'PK' ELSE '%PDF-' END AS signature, CASE WHEN event_id % 31 <> 0 THEN event_id % 12 + 1 END AS pages, event_id % 2 = 1 AS confirmed FROM events),
k AS (SELECT *, mode IN ('azure', 'hybrid', 'maximum_accuracy') AS az, mode IN ('ai_verified', 'maximum_accuracy') OR verifies OR formats OR looks AS ge FROM r)
SELECT e AS event_id, {_first(_GATES_SQL)} FROM k""")
def admission_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that refuses each request, with its reason; visual checks are disabled and there is no GPU."""
    e = F.col("event_id")
    settings = providers.Settings(azure_endpoint="https://example.com", azure_key="k", gemini_key="k", verification_enabled=True, formatting_enabled=True)
    requests = S.table(spark, sf_dir, "events").select(
        "event_id",
        F.element_at(F.array(*map(F.lit, [*R.MODES, "other"])), (e % 9 + 1).cast("int")).alias("mode"),
        F.when(e % 23 == 0, "tpu").otherwise("cpu").alias("device"),
        F.when(e % 4 == 0, "important").otherwise("off").alias("ai_verification"),
        F.when(e % 6 == 1, "auto").otherwise("off").alias("ai_formatting"),
        (e % 8 == 3).alias("ai_visual_qa"),
        (e % 5 != 0).alias("opt_in"),
        (e % 3 != 0).alias("full_page"),
        (e % 600 * 1048576).alias("size"),
        F.when(e % 29 == 0, "PK").otherwise("%PDF-").alias("signature"),
        F.when(e % 31 != 0, e % 12 + 1).alias("pages"),
        (e % 2 == 1).alias("confirmed"),
    )
    gates = J.admission_gates(settings.azure_ready, settings.gemini_ready, settings.verification_enabled, settings.formatting_enabled, settings.visual_qa_enabled, providers.preflight(settings)[1], settings.max_upload_mb * 1024 * 1024)
    return requests.select("event_id", J.outcome(gates).alias("o")).select("event_id", "o.code", "o.reason")


_APPROVAL_SQL = [("training OR classification <> 'EVALUATION_ONLY'", 409, "not for evaluation only"), ("sha IS NULL OR unapproved IS NULL", 404, "missing page"), ("sha <> truth_sha", 409, "hash differs"), ("unapproved > 0", 409, "blocks without approval")]


@query(f"""WITH {S.BLOCKS_SQL}, u AS (SELECT doc_id, sum(CASE WHEN block_type NOT IN ('FIGURE', 'DECORATIVE_REGION') AND (doc_id + ord) % 53 = 0 THEN 1 ELSE 0 END) AS unapproved FROM blocks GROUP BY doc_id),
t AS (SELECT DISTINCT doc_id FROM labels), k AS (SELECT t.doc_id, t.doc_id % 43 = 0 AS training, CASE WHEN t.doc_id % 9 = 4 THEN 'PUBLIC' ELSE 'EVALUATION_ONLY' END AS classification, sha256(d.text) AS sha, CASE WHEN t.doc_id % 10 = 3 THEN 'other' ELSE sha256(d.text) END AS truth_sha, u.unapproved
  FROM t LEFT JOIN documents d ON t.doc_id = d.doc_id LEFT JOIN u ON t.doc_id = u.doc_id)
SELECT doc_id, {_first(_APPROVAL_SQL)} FROM k""")
def approval_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each labelled page may be approved, and what refuses it."""
    d = F.col("doc_id")
    left = ~F.col("block_type").isin("FIGURE", "DECORATIVE_REGION") & ((d + F.col("ord")) % 53 == 0)
    counted = all_blocks(spark, sf_dir).groupBy("doc_id").agg(F.count_if(left).alias("unapproved"))
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    pages = S.table(spark, sf_dir, "labels").select("doc_id").distinct().join(docs, "doc_id", "left").join(counted, "doc_id", "left")
    asked = pages.select("doc_id", "sha", "unapproved", (d % 43 == 0).alias("training"), F.when(d % 9 == 4, "PUBLIC").otherwise("EVALUATION_ONLY").alias("classification"), F.when(d % 10 == 3, "other").otherwise(F.col("sha")).alias("truth_sha"))
    return asked.select("doc_id", J.outcome(J.approval_gates()).alias("o")).select("doc_id", "o.code", "o.reason")


@query("""SELECT DISTINCT user_id AS job, event_id % 50 AS page, CASE WHEN user_id % 11 = 0 OR user_id % 7 = 0 THEN 'refuse' WHEN EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_id % 50 = e.event_id % 50 AND d.event_type = 'purchase') THEN 'skip' ELSE 'process' END AS action FROM events e""")
def resumed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed job does with its pages; the source of every seventh has changed, that of every eleventh is unknown."""
    job = F.col("job")
    pages = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), (F.col("event_id") % 50).alias("page"), "event_type")
    sources = pages.where(job % 11 != 0).select("job").distinct().select("job", F.lit("a").alias("sha_before"), F.when(job % 7 == 0, "b").otherwise("a").alias("sha_now"))
    return J.to_resume(pages, pages.where("event_type = 'purchase'"), sources)


_ROLL_SQL = """roll AS (SELECT user_id AS job, count(DISTINCT event_id % 50) AS accounted, coalesce(array_to_string(list_sort(list_distinct(list(event_id % 50) FILTER (event_type = 'error'))), ', '), '') AS failed, CAST(sum(event_id % 3) AS BIGINT) AS warnings, CAST(sum(event_id % 2) AS BIGINT) AS api_calls,
  round(sum(coalesce(value, 0)), 4) AS cost, round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0E0, 1) AS elapsed_seconds FROM events GROUP BY user_id)"""


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return J.rolled_up(S.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), (e % 50).alias("page"), (F.col("event_type") == "error").alias("failed"), (e % 3).alias("warnings"), (e % 2).alias("api_calls"), F.col("value").alias("cost"), F.col("ts").alias("at")))


@query(f"WITH {_ROLL_SQL} SELECT * FROM roll")
def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed pages, warnings, calls, cost and time of each job."""
    return _rolled(spark, sf_dir).withColumn("failed", F.array_join(F.col("failed").cast("array<string>"), ", "))


@query(f"WITH {_ROLL_SQL} SELECT job, '# Run' || chr(10) || '- Pages accounted for: ' || accounted || chr(10) || '- Failed pages: ' || CASE WHEN failed = '' THEN 'none' ELSE failed END || chr(10) || '- Warnings: ' || warnings || chr(10) || '- Elapsed: ' || printf('%.1f', elapsed_seconds) || ' s' AS markdown FROM roll")
def job_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's summary in Markdown."""
    return J.summary(_rolled(spark, sf_dir))


@query(f"WITH {_ROLL_SQL} SELECT job, CAST(to_json({{'job': job, 'state': CASE WHEN failed = '' THEN 'COMPLETED' ELSE 'COMPLETED_WITH_ERRORS' END, 'pages': {{'accounted': accounted, 'failed': failed}}, 'usage': {{'api_calls': api_calls, 'warnings': warnings}}}}) AS VARCHAR) AS manifest FROM roll")
def job_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's manifest: nested, as JSON."""
    found = _rolled(spark, sf_dir).withColumn("failed", F.array_join(F.col("failed").cast("array<string>"), ", "))
    state = F.when(F.col("failed") == "", "COMPLETED").otherwise("COMPLETED_WITH_ERRORS")
    return found.select("job", F.to_json(F.struct("job", state.alias("state"), F.struct("accounted", "failed").alias("pages"), F.struct("api_calls", "warnings").alias("usage"))).alias("manifest"))


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, ord, block_type AS kind, confidence FROM blocks WHERE unresolved UNION ALL SELECT DISTINCT doc_id, NULL, 'no text', NULL FROM documents WHERE text IS NOT NULL AND doc_id % 41 = 0")
def issues_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved blocks and failed pages."""
    pages = S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(F.col("doc_id") % 41 == 0, "no text").alias("error")).distinct()
    return J.issues(all_blocks(spark, sf_dir), pages)


def _rollup_sql(source: str, *keys: str) -> str:
    shown = ", ".join(f"CASE WHEN GROUPING({k}) = 1 THEN 'total' ELSE {k} END AS {k}" for k in keys)
    return f"SELECT {shown}, count(*) AS blocks, CAST(sum(CASE WHEN unresolved THEN 1 ELSE 0 END) AS BIGINT) AS unresolved FROM {source} GROUP BY ROLLUP ({', '.join(keys)})"


@query(f"WITH {S.BLOCKS_SQL}, k AS (SELECT block_type, CASE WHEN trim(literal) = '' THEN 'empty' ELSE 'text' END AS content, unresolved FROM blocks) {_rollup_sql('k', 'block_type', 'content')}")
def unresolved_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved blocks by type and by whether they have a text, with totals."""
    content = F.when(F.trim("literal") == "", "empty").otherwise("text")
    return J.unresolved_by(all_blocks(spark, sf_dir).withColumn("content", content), "block_type", "content")


@query(f"{_PAIR_SQL}, k AS (SELECT CASE WHEN theirs IS NOT NULL AND nfc_normalize(literal) <> nfc_normalize(theirs) THEN 'disagreement' WHEN confidence < 0.72E0 THEN 'low-confidence' ELSE 'none' END AS reason, unresolved FROM pair) {_rollup_sql('k', 'reason')}")
def unresolved_by_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved blocks by what sends them to adjudication, with the total."""
    reason = F.coalesce(R.trigger(F.col("confidence"), F.col("literal"), F.col("theirs")), F.lit("none"))
    return J.unresolved_by(_with_verifier(spark, sf_dir).withColumn("reason", reason), "reason")


@query(f"WITH {S.BLOCKS_SQL}, k AS (SELECT doc_id, ord, literal AS a, CASE WHEN (doc_id + ord) % 5 = 0 THEN array_to_string(list_reverse(string_split(literal, ' ')), ' ') ELSE literal END AS b FROM blocks) SELECT doc_id, ord FROM k WHERE a <> b AND list_reverse(string_split(a, ' ')) = string_split(b, ' ')")
def token_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose tokens another provider gives in reverse (here: every fifth)."""
    a = F.col("literal")
    other = F.when((F.col("doc_id") + F.col("ord")) % 5 == 0, F.array_join(F.reverse(F.split(a, " ")), " ")).otherwise(a)
    return all_blocks(spark, sf_dir).where(J.reversed_tokens(a, other)).select("doc_id", "ord")


@query(f"""WITH {S.BLOCKS_SQL}, page AS (SELECT doc_id, CAST(2 * sum(CASE WHEN unresolved THEN 1 ELSE 0 END) - count(*) AS BIGINT) AS v FROM blocks GROUP BY doc_id), n AS (SELECT unnest(range(0, 201)) AS b),
d AS (SELECT v, b, CAST('0x' || substr(md5(doc_id || ':' || b), 1, 8) AS BIGINT) / 4294967296.0E0 AS u FROM page, n),
w AS (SELECT v, b, CASE WHEN b = 0 THEN 1 ELSE {' + '.join(f'CASE WHEN u >= {p}E0 THEN 1 ELSE 0 END' for p in J.POISSON)} END AS w FROM d),
m AS (SELECT b, sum(w) AS n, CAST(sum(v * w) AS DOUBLE) / nullif(sum(w), 0) AS m FROM w GROUP BY b)
SELECT CAST(max(n) FILTER (b = 0) AS BIGINT) AS pages, round(max(m) FILTER (b = 0), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (b > 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (b > 0), 6) AS high FROM m""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over pages of unresolved less resolved blocks, with its bootstrap interval."""
    pages = all_blocks(spark, sf_dir).groupBy("doc_id").agg((2 * F.count_if("unresolved") - F.count("*")).alias("v"))
    return J.bootstrap(pages, "doc_id", "v")


@query("""SELECT doc_id, '{' || concat_ws(',', CASE WHEN lang IS NOT NULL THEN '"lang":"' || lang || '"' END, CASE WHEN doc_id % 3 <> 0 THEN '"score":' || (doc_id % 100) END, '"shape":{"n":' || n_chars || '}') || '}' AS evidence FROM documents""")
def evidence_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without their tensors: named fields that are not null."""
    d = F.col("doc_id")
    payload = F.to_json(F.struct("lang", F.array("n_chars", "n_chars").alias("tensor"), F.when(d % 3 != 0, d % 100).alias("score"), F.struct(F.col("n_chars").alias("n")).alias("shape")), {"ignoreNullFields": "false"})
    return S.table(spark, sf_dir, "documents").select("doc_id", J.compacted(payload, ["lang", "score", "absent", "shape"]).alias("evidence"))


@query("""SELECT doc_id, 'correction_html,correction_json,literal_docx,polished_docx,' || CASE WHEN doc_id % 41 = 0 THEN '' ELSE 'rendered_pdf,' END || 'review_report' AS names, CASE WHEN doc_id % 41 <> 0 THEN 'output/rendered.pdf' END AS pdf, doc_id % 41 <> 0 AS available, CASE WHEN doc_id % 41 = 0 THEN 'no office' END AS error FROM documents""")
def export_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exports leave behind; the PDF of some pages fails."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 41 == 0, "no office").alias("pdf_error"))
    return J.exported(docs).select("doc_id", F.array_join(F.array_sort(F.map_keys("outputs")), ",").alias("names"), F.col("outputs")["rendered_pdf"].alias("pdf"), "available", "error")


@query(f"""WITH {S.BLOCKS_SQL} SELECT doc_id, CAST(CASE WHEN doc_id % 10 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS section_breaks, CAST(sum(CASE WHEN block_type <> 'TABLE' AND ord % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS bidi_paragraphs, CAST(sum(CASE WHEN block_type <> 'TABLE' AND ord % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS rtl_runs,
 CAST(sum(CASE WHEN block_type = 'TABLE' THEN 1 ELSE 0 END) AS BIGINT) AS tables, CAST(sum(length(literal)) AS BIGINT) AS text_length, doc_id % 13 <> 0 AS passed FROM blocks GROUP BY doc_id""")
def rendered_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks in the XML of rendered pages, counted; the text of every thirteenth lacks a fragment."""
    ord_ = F.col("ord")
    run = F.when(ord_ % 4 == 0, "<w:r><w:rPr><w:rtl/></w:rPr></w:r>").otherwise("")
    xml = F.when(F.col("block_type") == "TABLE", "<w:tbl><w:tr/></w:tbl>").when(ord_ % 2 == 0, F.concat(F.lit("<w:p><w:pPr><w:bidi/></w:pPr>"), run, F.lit("</w:p>"))).otherwise("<w:p/>")
    joined = all_blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.collect_list(xml), "").alias("body"), F.array_join(F.collect_list("literal"), "").alias("text"))
    d = F.col("doc_id")
    section = F.when(d % 10 != 0, '<w:sectPr w:type="nextPage"/>').otherwise("")
    missing = F.when(d % 13 == 0, F.array(F.lit("lost"))).otherwise(F.expr("cast(array() as array<string>)"))
    return J.xml_counters(joined.select("doc_id", F.concat("body", section).alias("xml"), "text", missing.alias("missing")))


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, md5(string_agg(CASE WHEN (doc_id + ord) % 17 = 0 THEN literal || '.' ELSE literal END, chr(10) ORDER BY reading_order)) AS text_md5 FROM blocks GROUP BY doc_id")
def corrected_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's text with what a reviewer approved in place of what was read."""
    approved = F.when((F.col("doc_id") + F.col("ord")) % 17 == 0, F.concat("literal", F.lit(".")))
    parts = F.array_sort(F.collect_list(F.struct("reading_order", F.coalesce(approved, "literal").alias("t"))))
    return all_blocks(spark, sf_dir).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").cast("binary")).alias("text_md5"))


@query("""WITH c AS (SELECT source AS provider, n_chars // 4 AS tin, n_chars // 16 AS tout, doc_id % 3 AS pages, doc_id % 4 = 0 AS free FROM documents)
SELECT provider, count(*) AS api_calls, CAST(sum(pages) AS BIGINT) AS pages_billed, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens, round(sum(CASE WHEN NOT free THEN (tin * 3.0E0 + tout * 15.0E0) / 1000000.0E0 END), 6) AS token_cost, round(sum(CASE WHEN NOT free THEN pages * 1.5E0 / 1000.0E0 END), 6) AS page_cost FROM c GROUP BY provider""")
def usage_with_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by provider; calls without a price (every fourth) have no cost."""
    d = F.col("doc_id")
    calls = S.table(spark, sf_dir, "documents").select(F.col("source").alias("provider"), F.expr("n_chars div 4").alias("tin"), F.expr("n_chars div 16").alias("tout"), (d % 3).alias("pages"), (d % 4 != 0).alias("priced"))
    price = lambda value: F.when(F.col("priced"), F.lit(value))
    return calls.groupBy("provider").agg(
        F.count("*").alias("api_calls"),
        F.sum("pages").alias("pages_billed"),
        F.sum("tin").alias("input_tokens"),
        F.sum("tout").alias("output_tokens"),
        F.round(F.sum(J.token_cost(F.col("tin"), F.col("tout"), price(3.0), price(15.0))), 6).alias("token_cost"),
        F.round(F.sum(J.page_cost(F.col("pages"), price(1.5))), 6).alias("page_cost"),
    )


@query(f"""WITH {S.BLOCKS_SQL}, k AS (SELECT doc_id, ord, literal, confidence, ((doc_id + ord) % 100) / 100.0E0 AS other FROM blocks)
SELECT doc_id, ord, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN other > confidence THEN md5(literal || '?') ELSE md5(literal) END AS selected_md5, CASE WHEN doc_id % 6 = 0 THEN 0.0E0 ELSE greatest(other, confidence) END AS decision_confidence, doc_id % 6 = 0 AS decision_unresolved FROM k""")
def most_confident_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two candidates for a block the more confident, the first of equal ones; every sixth page has none."""
    option = lambda text, confidence: F.struct(text.alias("text"), confidence.alias("confidence"))
    other = ((F.col("doc_id") + F.col("ord")) % 100) / 100.0
    both = F.array(option(F.col("literal"), F.col("confidence")), option(F.concat("literal", F.lit("?")), other))
    blocks = all_blocks(spark, sf_dir).withColumn("candidates", F.when(F.col("doc_id") % 6 != 0, both))
    decided = providers.ADJUDICATORS["most confident"].decide(blocks)
    return decided.select("doc_id", "ord", F.md5(F.col("selected").cast("binary")).alias("selected_md5"), "decision_confidence", "decision_unresolved")


@query("""SELECT page_id AS doc_id, CAST(r.r AS INTEGER) AS "row", CAST(c.c AS INTEGER) AS "column", CAST(CASE WHEN r.r = 0 AND c.c = 0 THEN 2 ELSE 1 END AS INTEGER) AS row_span, CAST(1 AS INTEGER) AS column_span, 'cell ' || r.r || ' ' || c.c AS text FROM pages, (VALUES (0), (1)) r(r), (VALUES (0), (1), (2)) c(c) WHERE NOT (r.r = 1 AND c.c = 0)""")
def cloud_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of tables in cloud payloads; the first spans two rows, the others name no span."""
    cell = lambda r, c: F.struct(F.lit(r).alias("row"), F.lit(c).alias("column"), F.lit(2 if r == c == 0 else None).cast("int").alias("row_span"), F.lit(f"cell {r} {c}").alias("content"))
    cells = F.array(*[cell(r, c) for r in range(2) for c in range(3) if (r, c) != (1, 0)])
    payload = F.to_json(F.struct(F.array(F.struct(F.lit(2).alias("rows"), F.lit(3).alias("columns"), cells.alias("cells"))).alias("tables")))
    pages = S.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.lit(800).alias("width"), F.lit(1100).alias("height"), payload.alias("payload"))
    return P.cloud_cells(pages).select("doc_id", "row", "column", "row_span", "column_span", "text")


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {9 if k == 'TABLE' else 0})" for i, (k, _) in enumerate(demo.BLOCKS)) + ") b(reading_order, block_type, cells)")
def demo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the demonstration document."""
    blocks = demo.demo_document(spark).select(F.explode("pages").alias("p")).select(F.explode("p.blocks").alias("b"))
    return blocks.select("b.reading_order", "b.block_type", F.coalesce(F.size("b.table.cells"), F.lit(0)).alias("cells"))


@query("""SELECT * FROM (VALUES ('mock', 'mock', 'mock', NULL, 'disabled', NULL, FALSE, FALSE), ('local', 'local', 'local', NULL, 'gemini', 'important', TRUE, FALSE), ('azure', 'azure', 'full_page', NULL, 'disabled', NULL, FALSE, FALSE), ('hybrid', 'azure', 'full_page', 'local', 'gemini', 'important', TRUE, FALSE),
 ('ai_verified', 'local', 'local', NULL, 'gemini', 'important', TRUE, FALSE), ('maximum_accuracy', 'azure', 'full_page', 'local', 'gemini', 'important', TRUE, FALSE)) b(mode, "primary", layout, verifier, adjudicator, policy, formatter, visual_qa)""")
def provider_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each mode that can run on a machine without a desktop engine or GPU."""
    made = [providers.bundle(mode, providers.Settings(), "important", formatting=True) for mode in R.MODES if mode not in ("windows", "unlimited")]
    return spark.createDataFrame(made, providers.BUNDLE)


@query("""SELECT * FROM (VALUES ('local', FALSE, FALSE, 'engine absent, layout 3.1'), ('windows', FALSE, FALSE, ''), ('azure', TRUE, TRUE, ''), ('gemini', TRUE, TRUE, 'model-a'), ('ai_verified', TRUE, TRUE, 'consented triggered crops'), ('hybrid', TRUE, TRUE, 'disputed crops only'),
 ('maximum_accuracy', TRUE, TRUE, 'consented crops and selected full pages'), ('unlimited', FALSE, FALSE, 'local-bf16: needs 8192 MB of GPU memory')) p(provider, available, requires_opt_in, detail)""")
def provider_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness of all providers under one configuration."""
    settings = providers.Settings(azure_endpoint="https://example.com", azure_key="k", gemini_key="k", gemini_model="model-a", verification_enabled=True, gpu_memory_mb=4096, packages={"layout": "3.1", "engine": None})
    return spark.createDataFrame(providers.availability(settings), providers.AVAILABILITY)


@query()
def macro_metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics over the reviewed pages: counts summed, others averaged over the pages that have them."""
    sums = ["missing", "hallucinated"]
    pages = page_metric_bundle(spark, sf_dir)
    return E.macro(pages, [c for c in pages.columns if c not in ("doc_id", *sums)], sums)


@query(f"""WITH {S.BLOCKS_SQL}, k AS (SELECT doc_id, ord, {_STYLE_SQL} AS style, (doc_id + ord) % 3 = 0 AS told FROM blocks)
SELECT doc_id, ord, style, CASE WHEN told AND ord % 5 < 4 THEN ['RIGHT', 'LEFT', 'CENTER', 'JUSTIFY'][CAST(ord % 5 + 1 AS INTEGER)] END AS alignment, CAST(CASE WHEN told AND ord % 2 = 0 THEN 17 END AS INTEGER) AS points, CASE WHEN told THEN 6.0E0 END AS space_after_pt, CASE WHEN told THEN ord % 7 = 0 END AS bold FROM k""")
def formatting_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paragraphs take from the formatting of their blocks, which every third has; some name an alignment that there is not."""
    found = all_blocks(spark, sf_dir)
    ord_ = F.col("ord")
    names = F.array(*map(F.lit, [*O.ALIGNMENTS, "SIDEWAYS"]))
    told = found.where((F.col("doc_id") + ord_) % 3 == 0).select("doc_id", "ord", F.element_at(names, (ord_ % 5 + 1).cast("int")).alias("alignment"), F.when(ord_ % 2 == 0, "LARGE").alias("size"), F.lit(6.0).alias("space_after_pt"), (ord_ % 7 == 0).alias("bold"))
    return O.formatted(found, told)


@query(f"""WITH {S.BLOCKS_SQL}, page AS (SELECT doc_id, bool_or(unresolved OR confidence < 0.7E0) AS low_confidence, bool_or(regexp_matches(literal, '[A-z]')) AS english, bool_or(block_type = 'TABLE') AS has_table FROM blocks WHERE doc_id % 41 <> 0 GROUP BY doc_id)
SELECT *, FALSE AS failed FROM page WHERE low_confidence OR english OR has_table UNION ALL SELECT DISTINCT doc_id, FALSE, FALSE, FALSE, TRUE FROM documents WHERE doc_id % 41 = 0""")
def review_queue_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to be looked at; every forty-first has failed and has no blocks."""
    d = F.col("doc_id")
    pages = S.table(spark, sf_dir, "documents").select("doc_id", (d % 41 == 0).alias("failed"))
    return J.queued(R.review_queue(all_blocks(spark, sf_dir).where(d % 41 != 0)), pages)


_REQUIRED_SQL = "(VALUES " + ", ".join(f"({n})" for n, _ in R.BENCHMARK_PAGES) + ") r(page)"


@query(f"""WITH p AS (SELECT DISTINCT user_id AS doc, event_id % 200 AS page FROM events), n AS (SELECT doc, count(*) AS had FROM p WHERE page IN (SELECT page FROM {_REQUIRED_SQL}) GROUP BY doc),
k AS (SELECT d.doc, d.doc % 4 = 1 AS public, {len(R.BENCHMARK_PAGES)} - coalesce(n.had, 0) AS missing FROM (SELECT DISTINCT user_id AS doc FROM events) d LEFT JOIN n ON d.doc = n.doc)
SELECT doc, CAST(CASE WHEN public OR missing > 0 THEN 409 ELSE 200 END AS INTEGER) AS code, CASE WHEN public THEN 'not for evaluation only' WHEN missing > 0 THEN 'pages are missing' END AS reason, CAST(missing AS BIGINT) AS missing FROM k""")
def benchmark_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a benchmark may be made of each document (a user's events are its pages); every fourth is public."""
    pages = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 200).alias("page"))
    documents = pages.select("doc").distinct().withColumn("classification", F.when(F.col("doc") % 4 == 1, "PUBLIC").otherwise("EVALUATION_ONLY"))
    return J.benchmark_admission(documents, pages, spark.createDataFrame(R.BENCHMARK_PAGES, "page long, category string"))
