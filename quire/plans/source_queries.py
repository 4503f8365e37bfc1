"""Queries over markup, payloads and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import spans
from quire.plans.registry import query
from quire.sources import derived as S
from quire.sources import payloads as P
from quire.sources.storage import shared_dir
from quire.streaming import jobs as J


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|p|li|footer|nav)[ >]', 1)) AS tag FROM pages)
SELECT page_id, CASE tag WHEN 'h1' THEN 'HEADING_1' WHEN 'p' THEN 'BODY_PARAGRAPH' WHEN 'li' THEN 'BULLET_LIST' WHEN 'footer' THEN 'FOOTER' ELSE 'DECORATIVE_REGION' END AS block_type, count(*) AS n FROM t GROUP BY 1, 2""")
def html_region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a page by the type of block that they make."""
    kinds = {"h1": "HEADING_1", "p": "BODY_PARAGRAPH", "li": "BULLET_LIST", "footer": "FOOTER", "nav": "DECORATIVE_REGION"}
    tags = S.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(h1|p|li|footer|nav)[ >]"), F.lit(1))).alias("tag"))
    return tags.groupBy("page_id", P.mapped(kinds, F.col("tag"), "UNKNOWN").alias("block_type")).agg(F.count("*").alias("n"))


@query(r"""WITH s AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM s),
o AS (SELECT doc_id, length(w) AS length, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
k AS (SELECT *, start // 1000 AS block, (doc_id * 7 + start) % 101 / 100.0E0 AS confidence FROM o WHERE length > 0)
SELECT doc_id, CAST(block AS BIGINT) AS span, count(*) AS words, round(avg(confidence), 6) AS confidence FROM k WHERE block % 2 = 0 AND start + length <= block * 1000 + 800 AND start >= block * 1000 GROUP BY doc_id, block""")
def word_span_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of the words that lie whole in a span; spans are the first 800 of every other thousand characters."""
    docs = S.table(spark, sf_dir, "documents").where("text is not null")
    words = spans.words(docs).withColumn("confidence", (F.col("doc_id") * 7 + F.col("start")) % 101 / 100.0).where("length > 0")
    blocks = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("length(text) div 1000"))).alias("block")).where("block % 2 = 0")
    ranges = blocks.select("doc_id", F.col("block").cast("long").alias("span"), (F.col("block") * 1000).alias("from"), (F.col("block") * 1000 + 800).alias("to"))
    return spans.inside(words, ranges).groupBy("doc_id", "span").agg(F.count("*").alias("words"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("SELECT page_id AS doc_id, CAST(i.i AS BIGINT) AS ln, 'line ' || i.i AS text, CAST(10 * i.i AS DOUBLE) AS x, CASE WHEN i.i = 2 THEN 0.0E0 ELSE round((page_id % 150) / 100.0E0, 6) END AS raw_score, round(least(1.0E0, CASE WHEN i.i = 2 THEN 0.0E0 ELSE (page_id % 150) / 100.0E0 END), 6) AS confidence FROM pages, range(3) i(i)")
def local_payload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with three texts and two scores, read back as lines."""
    score = F.round((F.col("page_id") % 150) / 100.0, 6)
    payload = F.to_json(F.struct(F.array(*[F.lit(f"line {i}") for i in range(3)]).alias("rec_texts"), F.array(score, score).alias("rec_scores"), F.array(*[F.array(*[F.lit(float(v)) for v in (10 * i, 50 * i, 10 * i + 300, 50 * i + 40)]) for i in range(3)]).alias("rec_boxes")))
    pages = S.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.lit(1000).alias("width"), F.lit(1400).alias("height"), payload.alias("payload"))
    return P.local_lines(pages).select("doc_id", F.col("ln").cast("long").alias("ln"), "text", "x", F.when(F.col("ln") == 2, 0.0).otherwise(F.round((F.col("doc_id") % 150) / 100.0, 6)).alias("raw_score"), F.round("confidence", 6).alias("confidence"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY user_id")
def streamed_job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log worked off as a stream: the last state of each user."""
    schema = S.table(spark, sf_dir, "events").schema
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    J.run_once(J.latest(J.events(spark, sf_dir, "events.parquet", schema)), f"{out}/rows", f"{out}/log")
    return spark.read.parquet(f"{out}/rows")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def streamed_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = S.table(spark, sf_dir, "events").schema
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    J.run_once(J.windowed(J.events(spark, sf_dir, "events.parquet", schema), late="10000 days"), f"{out}/rows", f"{out}/log")
    return spark.read.parquet(f"{out}/rows").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "events", F.round("value", 4).alias("value"))
