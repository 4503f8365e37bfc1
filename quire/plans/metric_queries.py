"""Queries that evaluate the derived hypothesis against the derived truth.

The hypothesis moves blocks by a few pixels only, so the greedy geometric match pairs every block with its own counterpart; the
SQL that the results are held against joins on that, while the queries match by geometry. Error rates and token accuracies are
those of whole pages, and only of reviewed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.distance import distance
from quire.operators import layout as L
from quire.operators import matching as M
from quire.operators import metrics as E
from quire.plans.layout_queries import all_blocks, modular_cells
from quire.operators.review import HEADINGS
from quire.plans.registry import query
from quire.sources import derived as S
from quire.sources.storage import stored

_MATCH_SQL = f"WITH {S.BLOCKS_SQL}, m AS (SELECT b.doc_id, b.ord, b.literal AS a, h.literal AS b, b.reading_order AS ra, h.reading_order AS rh FROM blocks b JOIN hyp h ON b.doc_id = h.doc_id AND b.ord = h.ord)"


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = stored(all_blocks(spark, sf_dir))
    hyp = L.hypothesis(found)
    return found, hyp, M.truth_to_hypothesis(found, hyp)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, reviewed: every page counts as reviewed but those that the labels hold for bad."""
    bad = S.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pages = S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id").distinct()
    return pages.join(bad, "doc_id", "left").select("doc_id", (F.coalesce("quality", F.lit(1)) == 1).alias("reviewed"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, a, b: the whole texts of the pages that may be measured; a page that the hypothesis lacks has an empty one."""
    found = stored(all_blocks(spark, sf_dir))
    return _texts_of(found, L.hypothesis(found), reviews(spark, sf_dir))


def _texts_of(found: DataFrame, hyp: DataFrame, reviewed: DataFrame) -> DataFrame:
    theirs = E.page_text(hyp, F.col("literal")).withColumnRenamed("text", "b")
    mine = E.page_text(found, F.col("literal")).withColumnRenamed("text", "a")
    return E.gated(mine.join(theirs, "doc_id", "left").withColumn("b", F.coalesce("b", F.lit(""))), reviewed)


_GATE_SQL = "gate AS (SELECT p.doc_id, coalesce(l.quality, 1) = 1 AS reviewed FROM (SELECT DISTINCT doc_id FROM documents WHERE text IS NOT NULL) p LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id) l ON p.doc_id = l.doc_id)"


@query(f"WITH {S.BLOCKS_SQL}, {_GATE_SQL} SELECT doc_id, count(*) AS blocks FROM blocks WHERE doc_id IN (SELECT doc_id FROM gate WHERE reviewed) GROUP BY doc_id")
def measurable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that the metric gate lets through, with their blocks."""
    return E.gated(all_blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks")), reviews(spark, sf_dir))


@query(f"{_MATCH_SQL} SELECT doc_id, ord, ord AS hyp_ord FROM m")
def gt_hyp_geometry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)[2].select("doc_id", "ord", "hyp_ord")


@query()
def page_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of a page's whole text; null for an empty reference, above 1 where the hypothesis is longer."""
    return E.error_rates(_texts(spark, sf_dir)).select("doc_id", "distance", "n_chars", "cer")


@query()
def page_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rate of a page's whole text."""
    return E.error_rates(_texts(spark, sf_dir)).select("doc_id", F.col("word_distance").alias("distance"), "n_words", "wer")


_PATTERNS = {"digit": T.DIGITS, "english": T.ENGLISH, "punctuation": r"\p{P}"}


@query()
def digit_english_punct_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.token_accuracy(_texts(spark, sf_dir), _PATTERNS)


def _bag_sql(truth: str, hyp: str, key: str) -> str:
    return f"""a AS (SELECT doc_id, {key} AS k, count(*) AS r FROM {truth} GROUP BY 1, 2), b AS (SELECT doc_id, {key} AS k, count(*) AS h FROM {hyp} GROUP BY 1, 2),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(r, 0) AS r, coalesce(h, 0) AS h FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.k = b.k),
sums AS (SELECT doc_id, CAST(sum(least(r, h)) AS BIGINT) AS tp, CAST(sum(greatest(h - r, 0)) AS BIGINT) AS fp, CAST(sum(greatest(r - h, 0)) AS BIGINT) AS fn FROM j GROUP BY doc_id)
SELECT doc_id, tp, fp, fn, round(2.0E0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM sums"""


@query(f"WITH {S.BLOCKS_SQL}, ta AS (SELECT * FROM blocks WHERE block_type IN ('DOCUMENT_TITLE', 'CHAPTER_TITLE', 'HEADING_1', 'HEADING_2', 'HEADING_3')), hb AS (SELECT * FROM hyp WHERE block_type IN ('DOCUMENT_TITLE', 'CHAPTER_TITLE', 'HEADING_1', 'HEADING_2', 'HEADING_3')), " + _bag_sql("ta", "hb", "literal"))
def heading_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_blocks(spark, sf_dir)
    return E.bag_f1(_headings(found), _headings(L.hypothesis(found)), "doc_id", "literal")


def _headings(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("block_type").isin(*HEADINGS))


@query(f"WITH {S.BOUNDARY_SQL}, ta AS (SELECT doc_id, boundary FROM bound WHERE boundary IS NOT NULL), hb AS (SELECT doc_id, CASE WHEN (doc_id + ln) % 7 = 0 THEN 'NEW_PARAGRAPH' ELSE boundary END AS boundary FROM bound WHERE boundary IS NOT NULL AND (doc_id + ln) % 11 <> 0), " + _bag_sql("ta", "hb", "boundary"))
def boundary_bag_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of boundary types of a page, whatever their places."""
    found = L.boundaries(L.members(S.lines(spark, sf_dir), S.regions(spark, sf_dir))).where("boundary is not null").select("doc_id", "ln", "boundary")
    s = F.col("doc_id") + F.col("ln")
    hyp = found.where(s % 11 != 0).select("doc_id", F.when(s % 7 == 0, "NEW_PARAGRAPH").otherwise(F.col("boundary")).alias("boundary"))
    return E.bag_f1(found, hyp, "doc_id", "boundary")


@query(f"{_MATCH_SQL}, n AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id), c AS (SELECT a.doc_id, count(*) AS ok FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.ra < b.ra AND a.rh < b.rh GROUP BY a.doc_id), k AS (SELECT doc_id, count(*) AS k FROM m GROUP BY doc_id) SELECT n.doc_id, CAST(n * (n - 1) / 2 AS BIGINT) AS pairs, coalesce(c.ok, 0) AS \"right\", CASE WHEN n = 1 THEN CASE WHEN coalesce(k.k, 0) > 0 THEN 1.0E0 ELSE 0.0E0 END ELSE round(coalesce(c.ok, 0) / (n * (n - 1) / 2), 6) END AS accuracy FROM n LEFT JOIN c ON n.doc_id = c.doc_id LEFT JOIN k ON n.doc_id = k.doc_id")
def reading_order_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.order_accuracy(*_matched(spark, sf_dir))


@query(f"""WITH {S.LINES_SQL}, cells AS (SELECT doc_id, (r // 12) * 2 + col AS ord, (r % 12) // 3 AS "row", r % 3 AS "column", text FROM lines),
h AS (SELECT doc_id, ord, "row", "column", CASE WHEN (doc_id + "row") % 4 = 0 THEN replace(text, 'e', 'c') ELSE text END AS text FROM cells WHERE (doc_id + "row" + "column") % 9 <> 0),
c AS (SELECT a.doc_id, a.ord, a."row", coalesce(nfc_normalize(trim(a.text)) = nfc_normalize(trim(h.text)), FALSE) AS same FROM cells a LEFT JOIN h ON a.doc_id = h.doc_id AND a.ord = h.ord AND a."row" = h."row" AND a."column" = h."column"),
r AS (SELECT doc_id, ord, "row", bool_and(same) AS kept, count(*) AS n, sum(CASE WHEN same THEN 1 ELSE 0 END) AS k FROM c GROUP BY doc_id, ord, "row"),
t AS (SELECT doc_id, ord, 4 AS rows_n, 4 - count(*) + sum(CASE WHEN kept THEN 1 ELSE 0 END) AS kept, sum(n) AS n, sum(k) AS k FROM r GROUP BY doc_id, ord)
SELECT doc_id, round(CAST(sum(kept) AS DOUBLE) / sum(rows_n), 6) AS row_rate, round(CAST(sum(k) AS DOUBLE) / sum(n), 6) AS cell_rate FROM t GROUP BY doc_id""")
def table_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of reference rows and cells that the hypothesis has; a row without cells counts as kept."""
    cells = modular_cells(spark, sf_dir)
    changed = F.when((F.col("doc_id") + F.col("row")) % 4 == 0, F.replace("text", F.lit("e"), F.lit("c"))).otherwise(F.col("text"))
    hyp = cells.where((F.col("doc_id") + F.col("row") + F.col("column")) % 9 != 0).select("doc_id", "ord", "row", "column", changed.alias("theirs"))
    same = F.coalesce(T.nfc(F.trim("text")) == T.nfc(F.trim("theirs")), F.lit(False))
    compared = cells.join(hyp, ["doc_id", "ord", "row", "column"], "left").withColumn("same", same)
    rows = compared.groupBy("doc_id", "ord", "row").agg(F.max("rows").alias("rows"), F.bool_and("same").alias("kept"), F.count("*").alias("n"), F.count_if("same").alias("k"))
    tables = rows.groupBy("doc_id", "ord").agg(F.max("rows").alias("rows"), (F.max("rows") - F.count("*") + F.count_if("kept")).alias("kept"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    return tables.groupBy("doc_id").agg(F.round(F.sum("kept") / F.sum("rows"), 6).alias("row_rate"), F.round(F.sum("k") / F.sum("n"), 6).alias("cell_rate"))


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing_of(*_matched(spark, sf_dir))


def _missing_of(found: DataFrame, hyp: DataFrame, matches: DataFrame) -> DataFrame:
    truth = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("literal")).alias("r_chars"))
    theirs = hyp.groupBy("doc_id").agg(F.count("*").alias("h"), F.sum(F.length("literal")).alias("h_chars"), F.sum(F.when(F.col("unresolved"), F.length("literal")).otherwise(0)).alias("u_chars"))
    both = truth.join(theirs, "doc_id", "left").join(matches.groupBy("doc_id").agg(F.count("*").alias("k")), "doc_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    chars = F.when(z("h_chars") > 0, F.col("h_chars"))
    return both.select("doc_id", (F.col("n") - z("k")).alias("missing"), (z("h") - z("k")).alias("hallucinated"), F.round(F.greatest(F.lit(0), F.col("h_chars") - F.col("r_chars")) / chars, 6).alias("hallucinated_text_rate"), F.round(F.col("u_chars") / chars, 6).alias("unresolved_text_rate"))


_MISSING_SQL = f"""{_MATCH_SQL}, t AS (SELECT doc_id, count(*) AS n, sum(length(literal)) AS r FROM blocks GROUP BY doc_id), h AS (SELECT doc_id, count(*) AS h, sum(length(literal)) AS hc, sum(CASE WHEN unresolved THEN length(literal) ELSE 0 END) AS uc FROM hyp GROUP BY doc_id), k AS (SELECT doc_id, count(*) AS k FROM m GROUP BY doc_id),
page AS (SELECT t.doc_id, t.n - coalesce(k.k, 0) AS missing, coalesce(h.h, 0) - coalesce(k.k, 0) AS hallucinated, round(CAST(greatest(0, h.hc - t.r) AS DOUBLE) / nullif(h.hc, 0), 6) AS hallucinated_text_rate, round(CAST(h.uc AS DOUBLE) / nullif(h.hc, 0), 6) AS unresolved_text_rate FROM t LEFT JOIN h ON t.doc_id = h.doc_id LEFT JOIN k ON t.doc_id = k.doc_id)"""


@query(f"{_MISSING_SQL} SELECT * FROM page")
def missing_hallucinated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir)


@query(f"{_MISSING_SQL} SELECT 'hallucinated_text_rate' AS metric, round(avg(hallucinated_text_rate), 6) AS value FROM page UNION ALL SELECT 'unresolved_text_rate', round(avg(unresolved_text_rate), 6) FROM page UNION ALL SELECT 'missing', CAST(sum(missing) AS DOUBLE) FROM page UNION ALL SELECT 'hallucinated', CAST(sum(hallucinated) AS DOUBLE) FROM page")
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics over all pages: rates averaged over the pages that have them, counts summed."""
    return E.macro(_missing(spark, sf_dir), ["hallucinated_text_rate", "unresolved_text_rate"], ["missing", "hallucinated"])


@query()
def page_metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of a reviewed page side by side."""
    found, hyp, matches = _matched(spark, sf_dir)
    matches = stored(matches)
    texts = stored(_texts_of(found, hyp, reviews(spark, sf_dir)))
    rates = stored(E.error_rates(texts))
    out = texts.select("doc_id")
    parts = [
        rates.select("doc_id", "cer", "wer"),
        E.token_accuracy(texts, _PATTERNS).select("doc_id", *[f"{n}_accuracy" for n in _PATTERNS]),
        E.bag_f1(_headings(found), _headings(hyp), "doc_id", "literal").select("doc_id", F.col("f1").alias("heading_f1")),
        boundary_bag_f1(spark, sf_dir).select("doc_id", F.col("f1").alias("boundary_f1")),
        E.order_accuracy(found, hyp, matches).select("doc_id", F.col("accuracy").alias("order_accuracy")),
        table_preservation(spark, sf_dir),
        _missing_of(found, hyp, matches),
    ]
    for part in parts:
        out = out.join(part, "doc_id", "left")
    return out


@query("SELECT source AS provider, count(*) AS calls, CAST(sum(n_chars // 4) AS BIGINT) AS input_tokens, CAST(sum(n_chars // 16) AS BIGINT) AS output_tokens, round(sum((n_chars // 4) * 3 + (n_chars // 16) * 15) / 1000000.0E0, 6) AS cost FROM documents GROUP BY source")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and costs by provider: integers are summed, and priced once."""
    tin, tout = F.expr("n_chars div 4"), F.expr("n_chars div 16")
    return S.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("provider")).agg(F.count("*").alias("calls"), F.sum(tin).alias("input_tokens"), F.sum(tout).alias("output_tokens"), F.round(F.sum(tin * 3 + tout * 15) / 1000000.0, 6).alias("cost"))


@query("SELECT source AS provider, CAST(sum(CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars % 1000 END) AS BIGINT) AS total_ms, round(avg(CASE WHEN doc_id % 9 = 0 THEN 0 ELSE n_chars % 1000 END), 6) AS mean_ms FROM documents GROUP BY source")
def latency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and mean of timings over all pages; a page without a total counts as 0."""
    timings = F.when(F.col("doc_id") % 9 != 0, F.create_map(F.lit("total"), F.col("n_chars") % 1000))
    ms = F.coalesce(F.col("timings")["total"], F.lit(0))
    return S.table(spark, sf_dir, "documents").withColumn("timings", timings).groupBy(F.col("source").alias("provider")).agg(F.sum(ms).alias("total_ms"), F.round(F.avg(ms), 6).alias("mean_ms"))


@query(f"{_MATCH_SQL} SELECT doc_id, ord FROM m WHERE a <> b AND list_sort(string_split(a, ' ')) = list_sort(string_split(b, ' '))")
def token_order_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched texts that differ but have the same tokens."""
    found, hyp, matches = _matched(spark, sf_dir)
    both = matches.join(found.select("doc_id", "ord", F.col("literal").alias("a")), ["doc_id", "ord"]).join(hyp.select("doc_id", F.col("ord").alias("hyp_ord"), F.col("literal").alias("b")), ["doc_id", "hyp_ord"])
    return both.where("a <> b").where(F.array_sort(F.split("a", " ")) == F.array_sort(F.split("b", " "))).select("doc_id", "ord")


# What the hypothesis writes for a letter does not occur as that letter, so the distance is the number of letters changed.
@query(f"""{_MATCH_SQL}, t AS (SELECT doc_id, ord, a, b, CASE WHEN b = '' THEN length(a) WHEN (doc_id + ord) % 29 = 0 THEN length(regexp_replace(a, '[^a-z]', '', 'g')) WHEN (doc_id + ord) % 7 = 0 THEN length(regexp_replace(a, '[^e]', '', 'g')) ELSE 0 END AS d FROM m)
SELECT doc_id, ord FROM t WHERE (a = '') <> (b = '') OR (a <> '' AND 1 - d / CAST(greatest(length(a), length(b)) AS DOUBLE) < 0.25E0)""")
def severe_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched texts of which one is empty, or whose similarity is below a quarter."""
    found, hyp, matches = _matched(spark, sf_dir)
    side = lambda df, ord_, out: df.select("doc_id", F.col("ord").alias(ord_), F.col("literal").alias(out))
    both = matches.join(side(found, "ord", "a"), ["doc_id", "ord"]).join(side(hyp, "hyp_ord", "b"), ["doc_id", "hyp_ord"])
    a, b = F.col("a"), F.col("b")
    alike = 1 - distance(a, b) / F.when(a != "", F.greatest(F.length(a), F.length(b)))
    return both.where(((a == "") != (b == "")) | (alike < 0.25)).select("doc_id", "ord")


@query(f"{_MISSING_SQL}, d AS (SELECT missing - hallucinated AS x FROM page) SELECT count(*) AS pages, round(avg(x), 6) AS mean_delta, round(stddev_samp(x), 6) AS sd, round(1.96E0 * stddev_samp(x) / sqrt(count(*)), 6) AS half_width FROM d")
def paired_metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of two measures of the same pages, with the half width of its normal interval."""
    x = F.col("missing") - F.col("hallucinated")
    return _missing(spark, sf_dir).agg(F.count("*").alias("pages"), F.round(F.avg(x), 6).alias("mean_delta"), F.round(F.stddev_samp(x), 6).alias("sd"), F.round(1.96 * F.stddev_samp(x) / F.sqrt(F.count("*")), 6).alias("half_width"))
