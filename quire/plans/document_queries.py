"""Queries over whole documents: layout applied, pages reconciled, rendering, reviews, ground truth, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import documents as D
from quire.operators import layout as L
from quire.operators import matching as M
from quire.operators import report as O
from quire.operators import review as R
from quire.plans.layout_queries import all_blocks
from quire.plans.registry import query
from quire.plans.review_queries import _PAIR_SQL, _STYLE_SQL, _both, _protected_sql
from quire.sources import derived as S


def _place() -> Column:
    """The number by whose remainders blocks are told apart."""
    return F.col("doc_id") + F.col("ord")


@query(f"""WITH {S.ASSIGNED_SQL},
ocr AS (SELECT doc_id, 3000000 + (r // 4) * 2 + col AS ord, CASE WHEN doc_id % 5 = 0 OR (r // 4) % 3 <> 0 THEN 'UNKNOWN' ELSE 'BODY_PARAGRAPH' END AS block_type, count(*) AS n_lines, (r // 4) % 10 = 0 AS has_table FROM lines GROUP BY doc_id, r // 4, col),
verbatim AS (SELECT DISTINCT doc_id FROM ocr WHERE doc_id % 10 IN (0, 7) AND block_type <> 'UNKNOWN'),
cnt AS (SELECT doc_id, ord, count(*) AS n FROM assigned WHERE ord IS NOT NULL GROUP BY doc_id, ord),
laid AS (SELECT g.doc_id, g.ord, g.block_type, coalesce(c.n, 0) AS n_lines, 'region' AS origin FROM regions g LEFT JOIN cnt c ON g.doc_id = c.doc_id AND g.ord = c.ord WHERE (c.n > 0 OR g.block_type IN ('FIGURE', 'DECORATIVE_REGION', 'EQUATION_IMAGE')) AND g.doc_id NOT IN (SELECT doc_id FROM verbatim)
  UNION ALL SELECT doc_id, ord, block_type, n_lines, 'table' FROM ocr WHERE has_table AND doc_id NOT IN (SELECT doc_id FROM verbatim)
  UNION ALL SELECT doc_id, 1000000 + ln, 'UNKNOWN', 1, 'line' FROM assigned WHERE ord IS NULL AND doc_id NOT IN (SELECT doc_id FROM verbatim))
SELECT * FROM laid UNION ALL SELECT doc_id, ord, block_type, n_lines, 'ocr' FROM ocr WHERE doc_id NOT IN (SELECT doc_id FROM laid)""")
def layout_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of four lines of a first provider, under the regions; two pages in ten have a layout that stands for the whole page."""
    lines = S.lines(spark, sf_dir).withColumn("g", F.expr("r div 4"))
    kind = F.when((F.col("doc_id") % 5 == 0) | (F.col("g") % 3 != 0), "UNKNOWN").otherwise("BODY_PARAGRAPH")
    ocr = lines.groupBy("doc_id", "g", "col").agg(F.count("*").alias("n_lines")).select("doc_id", (3000000 + F.col("g") * 2 + F.col("col")).alias("ord"), kind.alias("block_type"), "n_lines", (F.col("g") % 10 == 0).alias("has_table"))
    fallback = lines.select("doc_id").distinct().where((F.col("doc_id") % 10).isin(0, 7))
    return D.laid_out(lines.drop("g"), S.regions(spark, sf_dir), ocr, fallback)


@query(f"""{_PAIR_SQL}, dec AS (SELECT *, CASE WHEN theirs IS NOT NULL AND nfc_normalize(literal) <> nfc_normalize(theirs) THEN 'disagreement' WHEN confidence < 0.72E0 THEN 'low-confidence' END AS reason,
  CASE WHEN ord % 4 = 0 THEN 0.9E0 ELSE 0.97E0 END AS dconf, (doc_id + ord) % 5 = 0 AS dunres, doc_id % 2 = 0 AS visual FROM pair),
judged AS (SELECT *, coalesce(theirs <> literal, FALSE) AS changed, NOT dunres AND theirs IS NOT NULL AND dconf >= 0.95E0 AS sufficient, {_protected_sql("coalesce(nullif(theirs, ''), literal)")} AS protected FROM dec),
applied AS (SELECT *, visual AND changed AND sufficient AND protected = '' AS app FROM judged),
page AS (SELECT doc_id, doc_id % 41 = 0 AS failed, count(*) AS blocks, count(reason) AS triggered, sum(CASE WHEN reason IS NOT NULL AND app THEN 1 ELSE 0 END) AS corrected,
  sum(CASE WHEN CASE WHEN reason IS NULL THEN unresolved WHEN app THEN FALSE WHEN visual THEN NOT sufficient OR protected <> '' ELSE dunres OR changed END THEN 1 ELSE 0 END) AS unresolved FROM applied GROUP BY doc_id),
only_v AS (SELECT h.doc_id, count(*) AS n FROM hyp h WHERE trim(h.literal) <> '' AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.doc_id = h.doc_id AND m.verifier_ord = h.ord) GROUP BY h.doc_id)
SELECT p.doc_id, CASE WHEN failed THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN failed THEN 0 ELSE blocks END AS blocks, CASE WHEN failed THEN 0 ELSE triggered END AS triggered, CAST(CASE WHEN failed THEN 0 ELSE corrected END AS BIGINT) AS corrected,
  CAST(CASE WHEN failed THEN 0 ELSE unresolved END AS BIGINT) AS unresolved, CASE WHEN failed THEN 0 ELSE coalesce(o.n, 0) END AS verifier_only FROM page p LEFT JOIN only_v o ON p.doc_id = o.doc_id""")
def reconciled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary blocks, verifier, match, trigger, decision (which selects the verifier's text) and outcome, a row a page."""
    found, hyp = _both(spark, sf_dir)

    def decide(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"selected": F.col("theirs"), "decision_confidence": F.when(F.col("ord") % 4 == 0, 0.9).otherwise(0.97), "decision_unresolved": _place() % 5 == 0, "visual": F.col("doc_id") % 2 == 0})

    return D.reconciled(found, hyp, M.primary_to_verifier(found, hyp), decide, F.col("doc_id") % 41 == 0)


_KIND_SQL = "CASE WHEN reading_order = 0 AND doc_id % 4 = 0 THEN 'HEADER' WHEN (doc_id + ord) % 37 = 0 THEN 'PAGE_NUMBER' WHEN (doc_id + ord) % 31 = 0 THEN 'NUMBERED_LIST' ELSE block_type END"
_END_SQL = r"'\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]'"
_RENDER_SQL = f"""WITH {S.BLOCKS_SQL}, k AS (SELECT doc_id, ord, reading_order, literal, {_KIND_SQL} AS block_type FROM blocks),
pg AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 41 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN doc_id % 82 = 0 THEN 'no text' END AS error FROM k),
sides AS (SELECT doc_id, CASE WHEN block_type = 'HEADER' THEN 'header' ELSE 'footer' END AS part, string_agg(literal, ' | ' ORDER BY reading_order) AS t FROM k WHERE block_type IN ('HEADER', 'FOOTER', 'PAGE_NUMBER') GROUP BY 1, 2),
items AS (SELECT doc_id, reading_order, block_type, CASE WHEN block_type IN ('BULLET_LIST', 'NUMBERED_LIST')
    THEN list_transform(list_filter(regexp_split_to_array(literal, {_END_SQL}), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''), lambda x: CASE WHEN block_type = 'BULLET_LIST' THEN regexp_replace(x, '^\\s*[-•●▪◦*]\\s*', '') ELSE regexp_replace(x, '^\\s*\\(?[0-9٠-٩]+[.)-]\\s*', '') END)
    ELSE string_split(literal, chr(10) || chr(10)) END AS a FROM k WHERE doc_id % 41 <> 0 AND block_type NOT IN ('HEADER', 'FOOTER', 'PAGE_NUMBER')),
seg AS (SELECT doc_id, reading_order, block_type, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM items),
plan AS (SELECT p.doc_id, s.part, 0 AS seq, 'Normal' AS style, '' AS numbering, coalesce(x.t, '') AS text FROM pg p CROSS JOIN (VALUES ('header'), ('footer')) s(part) LEFT JOIN sides x ON x.doc_id = p.doc_id AND x.part = s.part
  UNION ALL SELECT doc_id, 'failure', 1, 'OCR Unknown', '', '[Page ' || doc_id || ' failed: ' || coalesce(error, 'unknown error') || ']' FROM pg WHERE status <> 'COMPLETED'
  UNION ALL SELECT doc_id, 'body', row_number() OVER (PARTITION BY doc_id ORDER BY reading_order, i), CASE WHEN block_type IN ('BULLET_LIST', 'NUMBERED_LIST') THEN 'Normal' ELSE {_STYLE_SQL} END,
    CASE block_type WHEN 'BULLET_LIST' THEN 'bullet' WHEN 'NUMBERED_LIST' THEN 'number' ELSE '' END, CASE WHEN t = '' AND block_type IN ('UNKNOWN', 'EQUATION_IMAGE', 'DECORATIVE_REGION') THEN '[' || block_type || ' - unresolved]' ELSE t END FROM seg)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when((F.col("reading_order") == 0) & (d % 4 == 0), "HEADER").when(_place() % 37 == 0, "PAGE_NUMBER").when(_place() % 31 == 0, "NUMBERED_LIST").otherwise(F.col("block_type"))
    found = all_blocks(spark, sf_dir).withColumn("block_type", kind)
    pages = S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id").distinct().select("doc_id", F.when(d % 41 == 0, "FAILED").otherwise("COMPLETED").alias("status"), F.when(d % 82 == 0, "no text").alias("error"))
    return D.rendered(found, pages)


@query(f"{_RENDER_SQL} SELECT doc_id, part, seq, style, numbering, doc_id > (SELECT min(doc_id) FROM pg) AS new_section, md5(text) AS text_md5 FROM plan")
def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a paragraph of the rendered pages; every page but the first begins a section."""
    first = S.table(spark, sf_dir, "documents").where("text is not null").agg(F.min("doc_id").alias("m"))
    return _plan(spark, sf_dir).select("doc_id", "part", "seq", "style", "numbering", (F.col("doc_id") > first.scalar()).alias("new_section"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"{_RENDER_SQL} SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY CASE part WHEN 'header' THEN 2 WHEN 'footer' THEN 3 ELSE 1 END, seq)) AS text_md5, count(*) AS paragraphs FROM plan GROUP BY doc_id")
def rendered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a reader gets back from a rendered page."""
    from quire.sources.storage import stored

    plan = stored(_plan(spark, sf_dir))
    counted = plan.groupBy("doc_id").agg(F.count("*").alias("paragraphs"))
    return D.extracted(plan).join(counted, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "paragraphs")


_NEW_SQL = "new AS (SELECT event_id, (event_id * 7) % 1500 AS doc_id, 4000000 + event_id AS ord, event_type = 'click' OR event_type = 'view' AS ok FROM events)"


@query(f"WITH {_NEW_SQL}, j AS (SELECT CASE WHEN NOT ok THEN 422 WHEN doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) THEN 404 ELSE 201 END AS code FROM new) SELECT CAST(code AS INTEGER) AS code, count(*) AS writes FROM j GROUP BY code")
def review_write_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New blocks that reviewers send: refused without approval or without a page."""
    return _writes(spark, sf_dir).groupBy("code").agg(F.count("*").alias("writes"))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    batch = S.table(spark, sf_dir, "events").select(((e * 7) % 1500).alias("doc_id"), (4000000 + e).alias("ord"), F.lit("CAPTION").alias("block_type"), (1000 + e).alias("reading_order"), F.concat(F.lit("added "), e.cast("string")).alias("text"), F.col("event_type").isin("click", "view").alias("human_approved"))
    return D.judged_writes(batch, S.table(spark, sf_dir, "documents").where("doc_id is not null"))


@query(f"WITH {S.BLOCKS_SQL}, {_NEW_SQL}, a AS (SELECT doc_id, literal, unresolved, FALSE AS added FROM blocks UNION ALL SELECT doc_id, '', FALSE, TRUE FROM new WHERE ok AND doc_id IN (SELECT doc_id FROM documents)) SELECT doc_id, count(*) AS blocks, CAST(sum(CASE WHEN added THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN unresolved THEN 1 ELSE 0 END) AS BIGINT) AS unresolved, CAST(sum(length(literal)) AS BIGINT) AS literal_chars FROM a GROUP BY doc_id")
def pages_with_added_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = D.with_added(all_blocks(spark, sf_dir), _writes(spark, sf_dir).where("code = 201"))
    return after.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if("added").alias("added"), F.count_if("unresolved").alias("unresolved"), F.sum(F.length("literal")).alias("literal_chars"))


@query("""WITH s AS (SELECT user_id AS job, max_by(CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END, (ts, event_id)) AS state FROM events GROUP BY user_id)
SELECT job, state, job % 3 = 0 AND state NOT IN ('COMPLETED', 'COMPLETED_WITH_ERRORS', 'FAILED', 'CANCELLED') AS cancel_requested FROM s""")
def cancel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request to cancel every third job."""
    from quire.plans.review_queries import job_status_latest

    return D.cancelled(job_status_latest(spark, sf_dir).select("job", "state", (F.col("job") % 3 == 0).alias("cancel_requested")))


_BENCHMARK_SQL = "(VALUES " + ", ".join(f"({n}, '{c}')" for n, c in R.BENCHMARK_PAGES) + ") p(page, category)"


@query(f"SELECT CAST(p.page AS INTEGER) AS page, p.category, 'pages/page-' || lpad(CAST(p.page AS VARCHAR), 4, '0') || '.png' AS source_image, l.quality IS NOT NULL AS human_reviewed, CASE WHEN l.quality IS NOT NULL THEN 'reviewer ' || (p.page % 3) END AS reviewer FROM {_BENCHMARK_SQL} LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality = 1 GROUP BY doc_id) l ON l.doc_id = p.page")
def ground_truth_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new ground truth over the benchmark pages, and the reviews of those that the labels hold for good."""
    truth = D.manifest(spark.createDataFrame(R.BENCHMARK_PAGES, "page int, category string"), "pages")
    good = S.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page"), F.concat(F.lit("reviewer "), (F.col("doc_id") % 3).cast("string")).alias("reviewer"))
    return D.approved(truth, good)


@query(f"SELECT CAST(p.page AS INTEGER) AS page FROM {_BENCHMARK_SQL} WHERE p.page NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def unreviewed_benchmark_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that keep a ground truth from being ready."""
    return ground_truth_manifest(spark, sf_dir).where(~F.col("human_reviewed")).select("page")


@query("""WITH t AS (SELECT DISTINCT l.doc_id AS page, CASE WHEN l.doc_id % 10 = 3 THEN 'other' ELSE sha256(d.text) END AS sha FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id), j AS (SELECT doc_id AS page, sha256(text) AS theirs FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 2)
SELECT t.page, CASE WHEN theirs IS NULL THEN 'missing page' WHEN theirs <> t.sha THEN 'hash differs' ELSE 'ok' END AS outcome FROM t LEFT JOIN j ON t.page = j.page""")
def manifest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pages, a tenth with another hash, beside a job's pages, of which some are missing."""
    docs = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    truth = S.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page")).join(docs, "page", "left").select("page", F.when(F.col("page") % 10 == 3, "other").otherwise(F.col("sha")).alias("sha")).distinct()
    return D.compared(truth, docs.where("sha is not null and page % 7 <> 2"))


@query(f"WITH {S.BOUNDARY_SQL} SELECT doc_id, ord, ln0 AS before_ln, ln AS after_ln, CASE WHEN ln0 % 2 = 0 THEN 'NEW_PARAGRAPH' ELSE 'SOFT_LINE_BREAK' END AS boundary, 0.9E0 AS confidence FROM bound WHERE ln0 IS NOT NULL AND (doc_id + ord) % 3 = 0 AND ln0 % 4 <> 1")
def structural_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of every third block, by instructions for three lines in four."""
    bounds = L.boundaries(L.members(S.lines(spark, sf_dir), S.regions(spark, sf_dir)))
    ln = F.col("ln")
    told = bounds.where((_place() % 3 == 0) & (ln % 4 != 1)).select("doc_id", "ord", ln.alias("after_line"), F.when(ln % 2 == 0, "NEW_PARAGRAPH").otherwise("SOFT_LINE_BREAK").alias("new_boundary"), F.lit(0.9).alias("new_confidence"))
    return D.structured(bounds, told)


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, ord, block_type FROM blocks WHERE block_type IN ('FIGURE', 'EQUATION_IMAGE') AND ord % 8 <> 0")
def missing_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual blocks that have no crop yet (here: those whose number is no multiple of eight)."""
    crop = F.when(F.col("ord") % 8 == 0, F.lit("crop.png"))
    return all_blocks(spark, sf_dir).withColumn("source_crop", crop).where(F.col("block_type").isin("FIGURE", "EQUATION_IMAGE") & F.col("source_crop").isNull()).select("doc_id", "ord", "block_type")


@query(f"SELECT doc_id AS page FROM (SELECT doc_id FROM documents ORDER BY (doc_id * 7919) % 104729, doc_id LIMIT 20) UNION SELECT page FROM {_BENCHMARK_SQL}")
def validation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the review sample and those of the benchmark, each once."""
    from quire.plans.review_queries import review_sample

    sample = review_sample(spark, sf_dir).select(F.col("doc_id").alias("page"))
    return sample.union(spark.createDataFrame(R.BENCHMARK_PAGES, "page long, category string").select("page")).distinct()


@query(f"""WITH {S.BLOCKS_SQL}, audit AS (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN unresolved THEN 1 ELSE 0 END) AS BIGINT) AS u, bool_or(block_type = 'TABLE') AS t, bool_or(block_type IN ('DOCUMENT_TITLE', 'CHAPTER_TITLE', 'HEADING_1', 'HEADING_2', 'HEADING_3')) AS h, bool_or(block_type IN ('FIGURE', 'EQUATION_IMAGE')) AS v FROM blocks GROUP BY doc_id)
SELECT doc_id, n || ' canonical blocks; ' || u || ' unresolved; reading order serialized; one DOCX page mapped to one source page' || CASE WHEN t THEN '; editable table structure present' ELSE '' END || CASE WHEN h THEN '; semantic heading present' ELSE '' END || CASE WHEN v THEN '; source visual crop present or queued' ELSE '' END AS checks,
 CASE WHEN doc_id % 6 = 0 THEN 'Page is skewed; ' ELSE '' END || CASE WHEN u > 0 THEN u || ' OCR block(s) still require human resolution; ' ELSE '' END || 'visual fidelity and reading comfort require human approval' AS issues FROM audit""")
def formatting_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's structure shows and what is left to a human; every sixth page has a warning of its own."""
    warned = S.table(spark, sf_dir, "documents").where("doc_id % 6 = 0").select("doc_id", F.array(F.lit("Page is skewed")).alias("warnings")).distinct()
    return D.audited(all_blocks(spark, sf_dir), warned)


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, CAST(round_even((event_id % 40) / 2.0E0, 0) AS BIGINT) AS ms FROM events")
def utc_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as UTC stamps, and milliseconds rounded to the even one of two."""
    return S.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"), F.bround((F.col("event_id") % 40) / 2.0, 0).cast("long").alias("ms"))


@query("SELECT user_id AS job, round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0E0, 1) AS seconds FROM events GROUP BY user_id")
def elapsed_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between a job's first and last event, to one decimal."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return S.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.bround((micros(F.max("ts")) - micros(F.min("ts"))) / 1000000.0, 1).alias("seconds"))


_ESCAPE_SQL = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""WITH {S.BLOCKS_SQL}, c AS (SELECT doc_id, ord, literal, literal || '.' AS corrected FROM blocks WHERE (doc_id + ord) % 17 = 0)
SELECT doc_id, count(*) AS n, md5(string_agg('<tr><td>' || ord || '</td><td>' || {_ESCAPE_SQL.format('literal')} || '</td><td>' || {_ESCAPE_SQL.format('corrected')} || '</td><td>Human review</td><td>1.000</td></tr>', chr(10) ORDER BY ord)) AS html_md5 FROM c GROUP BY doc_id""")
def correction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a page's correction report as escaped HTML: what was read, what stands now, who approved it and how sure."""
    human = F.struct(F.lit("Human review").alias("reason"), F.lit(1.0).alias("confidence"))
    rows = all_blocks(spark, sf_dir).where(_place() % 17 == 0).withColumns({"approved": F.concat("literal", F.lit(".")), "human": human, "automatic": F.lit(None).cast("struct<reason:string,confidence:double>")})
    return O.correction_rows(R.corrections(rows))
