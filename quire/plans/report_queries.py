"""Reports, roll-ups of jobs, and small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import report as O
from quire.operators import review as R
from quire.plans.layout_queries import all_blocks, modular_cells
from quire.plans.metric_queries import macro_metrics
from quire.plans.registry import ORACLES, query
from quire.sources import derived as S
from quire.sources import payloads as P

_STYLE_SQL = "CASE block_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.STYLES.items()) + " ELSE 'Normal' END"


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, ord, block_type, {_STYLE_SQL} AS style FROM blocks")
def paragraph_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_blocks(spark, sf_dir).select("doc_id", "ord", "block_type", O.style_of(F.col("block_type")).alias("style"))


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, md5(string_agg(literal, chr(10) ORDER BY reading_order)) AS text_md5 FROM blocks GROUP BY doc_id")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's blocks in reading order, a line each."""
    parts = F.array_sort(F.collect_list(F.struct("reading_order", "literal")))
    return all_blocks(spark, sf_dir).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["literal"]), "\n").cast("binary")).alias("text_md5"))


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, md5(string_agg(block_type || ' · ' || CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR) || ' ' || CASE WHEN literal = '' THEN '[visual]' ELSE literal END, '|' ORDER BY reading_order)) AS preview_md5 FROM blocks GROUP BY doc_id")
def logical_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, confidence in percent and text of each block, in reading order."""
    tag = F.concat("block_type", F.lit(" · "), F.round(F.col("confidence") * 100).cast("long").cast("string"), F.lit(" "), F.when(F.col("literal") == "", "[visual]").otherwise(F.col("literal")))
    parts = F.array_sort(F.collect_list(F.struct("reading_order", tag.alias("t"))))
    return all_blocks(spark, sf_dir).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["t"]), "|").cast("binary")).alias("preview_md5"))


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, ord, block_type, confidence, block_type IN ('FIGURE', 'EQUATION_IMAGE') AS has_crop FROM blocks WHERE unresolved")
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_blocks(spark, sf_dir).where("unresolved").select("doc_id", "ord", "block_type", "confidence", F.col("block_type").isin("FIGURE", "EQUATION_IMAGE").alias("has_crop"))


@query(f"WITH {S.BLOCKS_SQL} SELECT 'pages ' || count(DISTINCT doc_id) || ', blocks ' || count(*) || ', unresolved ' || CAST(sum(CASE WHEN unresolved THEN 1 ELSE 0 END) AS BIGINT) || ', tables ' || CAST(sum(CASE WHEN block_type = 'TABLE' THEN 1 ELSE 0 END) AS BIGINT) AS line FROM blocks")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = all_blocks(spark, sf_dir).agg(F.count_distinct("doc_id").alias("p"), F.count("*").alias("b"), F.count_if("unresolved").alias("u"), F.count_if(F.col("block_type") == "TABLE").alias("t"))
    return counts.select(F.format_string("pages %d, blocks %d, unresolved %d, tables %d", "p", "b", "u", "t").alias("line"))


@query(f"SELECT metric, coalesce(printf('%.6f', value), 'N/A') AS shown FROM ({ORACLES['macro_metrics']}) q")
def measured_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.measured(macro_metrics(spark, sf_dir))


@query("SELECT unnest(['mock', 'local', 'windows', 'azure', 'hybrid', 'ai_verified', 'maximum_accuracy', 'unlimited']) AS mode, 'not measured' AS status")
def pending_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, R.MODES))).alias("mode"), F.lit("not measured").alias("status"))


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, ord, CASE WHEN (doc_id + ord) % 19 = 0 THEN 'HEADING_1' ELSE block_type END AS block_type, CAST(CASE WHEN (doc_id + ord) % 19 = 0 THEN CASE WHEN ord % 4 = 0 THEN 22 ELSE 12 END END AS INTEGER) AS points, md5(literal) AS literal_md5 FROM blocks")
def formatting_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions for some blocks, and for some that do not exist."""
    found = all_blocks(spark, sf_dir)
    base = found.select("doc_id", "ord").where((F.col("doc_id") + F.col("ord")) % 19 == 0)
    instructions = base.unionByName(base.withColumn("ord", -F.col("ord") - 1)).select("doc_id", "ord", F.lit("HEADING_1").alias("new_type"), F.when(F.col("ord") % 4 == 0, "EXTRA_LARGE").otherwise("NORMAL").alias("size"))
    return O.instructed(found, instructions).select("doc_id", "ord", "block_type", "points", F.md5(F.col("literal").cast("binary")).alias("literal_md5"))


@query(f"""WITH {S.LINES_SQL}, cells AS (SELECT doc_id, (r // 12) * 2 + col AS ord, (r % 12) // 3 AS "row", r % 3 AS "column" FROM lines)
SELECT doc_id, ord, "row", "column", CAST(least(2, "row" + doc_id % 3) AS BIGINT) AS last_row, CAST(least(2, "column" + 1) AS BIGINT) AS last_column, "row" = 0 AS header FROM cells WHERE "row" < 3""")
def table_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = modular_cells(spark, sf_dir).withColumns({"rows": F.lit(3).cast("long"), "row_span": F.col("doc_id") % 3 + 1, "column_span": F.lit(2).cast("long")})
    return O.placed(cells).select("doc_id", "ord", "row", "column", "last_row", "last_column", "header")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the apache license') OR contains(lower(source), 'src1')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive substring of a text or a name."""
    docs = S.table(spark, sf_dir, "documents")
    return docs.where(F.lower("text").contains("the apache license") | F.lower("source").contains("src1")).select("doc_id")


@query("SELECT user_id AS job, max(ts) = max(CASE WHEN event_type = 'error' THEN ts END) AS failed_last, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, bool_or(event_type = 'purchase') AND sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) >= 1 AND user_id % 2 = 0 AS may_retry FROM events GROUP BY user_id")
def retry_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with a checkpoint, a failed page and consent."""
    error = F.col("event_type") == "error"
    jobs = S.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg((F.max("ts") == F.max(F.when(error, F.col("ts")))).alias("failed_last"), F.count_if(error).alias("failed"), F.bool_or(F.col("event_type") == "purchase").alias("some"))
    return jobs.select("job", "failed_last", "failed", (F.col("some") & (F.col("failed") >= 1) & (F.col("job") % 2 == 0)).alias("may_retry"))


@query("SELECT user_id AS job, count(*) AS events, max(event_id) AS last_event FROM events GROUP BY user_id ORDER BY max(event_id) DESC, user_id LIMIT 8")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight jobs with the newest events. The limit is the feature."""
    jobs = S.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))
    return jobs.orderBy(F.desc("last_event"), "job").limit(8)


@query("SELECT user_id AS job, CAST(to_json({'job': user_id, 'events': count(*), 'failed': CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT)}) AS VARCHAR) AS summary FROM events GROUP BY user_id")
def job_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = S.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return jobs.select("job", F.to_json(F.struct("job", "events", "failed")).alias("summary"))


@query("SELECT count(*) AS requested, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS completed, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN event_type <> 'error' AND value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM events")
def visual_qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return S.table(spark, sf_dir, "events").agg(F.count("*").alias("requested"), F.count_if(~error).alias("completed"), F.count_if(error).alias("failed"), F.count_if(~error & F.coalesce(F.col("value") > 50, F.lit(False))).alias("passed"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, lang FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, lang FROM documents WHERE doc_id % 2 = 1)
SELECT a.doc_id AS source_page, b.doc_id AS rendered_page, a.lang FROM a JOIN b ON a.lang = b.lang AND a.k = b.k""")
def page_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of pages side by side by position."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang")
    side = lambda odd, name: docs.where(f"doc_id % 2 = {odd}").select(F.col("doc_id").alias(name), "lang", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("k"))
    return side(0, "source_page").join(side(1, "rendered_page"), ["lang", "k"]).select("source_page", "rendered_page", "lang")


@query("SELECT l.doc_id, sha256(d.text) AS sha, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL")
def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest pages beside the pages that they name, by number, with the hash of their source; manifest_outcomes compares hashes."""
    docs = S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return S.table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "sha", "quality")


@query("SELECT doc_id, doc_id % 3 <> 0 OR doc_id % 2 = 0 AS valid FROM documents")
def consent_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consent without the time of it is none: opt-in implies a timestamp."""
    d = F.col("doc_id")
    acknowledged = F.when(d % 2 == 0, F.lit("2024-01-01").cast("timestamp"))
    return S.table(spark, sf_dir, "documents").select("doc_id", (~(d % 3 == 0) | acknowledged.isNotNull()).alias("valid"))


@query(f"""WITH {S.BLOCKS_SQL} SELECT 'both' AS side, block_type FROM (SELECT doc_id, block_type FROM blocks INTERSECT ALL SELECT doc_id, block_type FROM hyp) UNION ALL SELECT 'missing', block_type FROM (SELECT doc_id, block_type FROM blocks EXCEPT ALL SELECT doc_id, block_type FROM hyp)""")
def multiset_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block types of pages that both sides have, and those that one lacks, with their multiplicity."""
    found = all_blocks(spark, sf_dir)
    a, b = found.select("doc_id", "block_type"), L.hypothesis(found).select("doc_id", "block_type")
    return a.intersectAll(b).select(F.lit("both").alias("side"), "block_type").unionAll(a.exceptAll(b).select(F.lit("missing").alias("side"), "block_type"))


@query(f"WITH {S.BLOCKS_SQL}, t AS (SELECT doc_id, list_distinct(list(block_type)) AS types FROM blocks GROUP BY doc_id) SELECT doc_id, array_to_string(list_sort(list_filter(['BODY_PARAGRAPH', 'HEADING_1', 'TABLE'], lambda r: NOT list_contains(types, r))), ',') AS missing, list_has_any(types, ['TABLE', 'FIGURE']) AS has_visual FROM t")
def missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required types that a page lacks, and whether it has a table or a figure."""
    types = all_blocks(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("block_type").alias("types"))
    required = F.array(*map(F.lit, ["BODY_PARAGRAPH", "HEADING_1", "TABLE"]))
    return types.select("doc_id", F.array_join(F.array_sort(F.array_except(required, "types")), ",").alias("missing"), F.arrays_overlap("types", F.array(F.lit("TABLE"), F.lit("FIGURE"))).alias("has_visual"))


#: Registered sources with licence and status.
_SOURCES = [("arabic-ebook-corpus", "CC-BY-4.0", "CANDIDATE_APPROVED_PENDING_USER_GATE"), ("arabic-img2md", "GPL-3.0", "HOLD_SOURCE_PROVENANCE"), ("arabic-nougat-suite", "GPL-3.0", "HOLD"), ("openiti-arabic-print-data", "NO_LICENSE_IN_EXACT_REPOSITORY", "BLOCKED"), ("sard", "CC-BY-NC-ND-4.0", "BLOCKED")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _SOURCES) + ") s(source, license, status) WHERE NOT starts_with(status, 'HOLD') AND status <> 'BLOCKED'")
def admissible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_SOURCES, "source string, license string, status string").where(~F.col("status").startswith("HOLD") & (F.col("status") != "BLOCKED"))


@query("SELECT * FROM (VALUES ('mock', TRUE, ''), ('local', FALSE, 'local_models'), ('windows', FALSE, 'windows'), ('azure', TRUE, ''), ('gemini', FALSE, 'gemini_key'), ('hybrid', FALSE, 'local_models'), ('maximum_accuracy', FALSE, 'gemini_key'), ('unlimited', FALSE, 'gpu_8gb')) s(provider, ready, missing)")
def provider_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(P.availability({"azure_key": True}), "provider string, ready boolean, missing string")
