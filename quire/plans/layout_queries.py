"""Queries over derived lines, regions and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import layout as L
from quire.plans.registry import query
from quire.sources import derived as S


def all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.blocks(S.lines(spark, sf_dir), S.regions(spark, sf_dir))


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.boundaries(L.members(S.lines(spark, sf_dir), S.regions(spark, sf_dir)))


@query(f"WITH {S.BOUNDARY_SQL} SELECT boundary, count(*) AS n, count(DISTINCT doc_id) AS documents, round(avg({S.CONFIDENCE_SQL}), 6) AS confidence FROM bound WHERE boundary IS NOT NULL GROUP BY boundary")
def boundary_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies between neighbouring lines of a block, counted over the corpus."""
    found = _bounds(spark, sf_dir).where("boundary is not null")
    return found.groupBy("boundary").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"), F.round(F.avg("boundary_confidence"), 6).alias("confidence"))


@query(f"WITH {S.BOUNDARY_SQL} SELECT doc_id, ord, ln0 AS before_ln, ln AS after_ln, boundary, round({S.CONFIDENCE_SQL}, 6) AS confidence FROM bound WHERE boundary IS NOT NULL")
def line_boundary_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounds(spark, sf_dir).where("boundary is not null").select("doc_id", "ord", F.col("before_ln"), F.col("ln").alias("after_ln"), "boundary", F.round("boundary_confidence", 6).alias("confidence"))


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, ord, md5(literal) AS literal_md5, length(literal) AS n_chars FROM blocks")
def reconstructed_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_blocks(spark, sf_dir).select("doc_id", "ord", F.md5(F.col("literal").cast("binary")).alias("literal_md5"), F.length("literal").cast("long").alias("n_chars"))


@query(f"WITH {S.ASSIGNED_SQL} SELECT doc_id, ln, ord FROM assigned WHERE ord IS NOT NULL")
def line_region_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.assign(S.lines(spark, sf_dir), S.regions(spark, sf_dir)).where("ord is not null").select("doc_id", "ln", "ord")


@query(f"WITH {S.ASSIGNED_SQL} SELECT doc_id, ln, x, y, width FROM assigned WHERE ord IS NULL")
def unassigned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unassigned(S.lines(spark, sf_dir), S.regions(spark, sf_dir)).select("doc_id", "ln", "x", "y", "width")


@query(f"WITH {S.ASSIGNED_SQL} SELECT g.doc_id, g.ord, g.block_type, count(a.ln) AS n_lines, round(coalesce(sum(a.conf100) / count(a.ln) / 100.0E0, g.conf100 / 100.0E0), 6) AS confidence FROM regions g LEFT JOIN assigned a ON a.doc_id = g.doc_id AND a.ord = g.ord GROUP BY g.doc_id, g.ord, g.block_type, g.conf100")
def region_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of a region's lines, or its own."""
    lines, regions = S.lines(spark, sf_dir), S.regions(spark, sf_dir)
    grouped = L.assign(lines, regions).where("ord is not null").groupBy("doc_id", "ord").agg(F.count("*").alias("k"), F.sum("conf100").alias("s"))
    return regions.join(grouped, ["doc_id", "ord"], "left").select("doc_id", "ord", "block_type", F.coalesce("k", F.lit(0)).alias("n_lines"), F.round(F.coalesce(F.col("s") / F.col("k") / 100.0, F.col("conf100") / 100.0), 6).alias("confidence"))


@query(f"WITH {S.REGIONS_SQL}, per AS (SELECT doc_id, count(*) AS n, bool_and(block_type = 'UNKNOWN') AS fallback FROM regions GROUP BY doc_id) SELECT d.doc_id, coalesce(p.n, 0) AS n_regions, coalesce(p.n, 0) = 0 OR (p.n = 1 AND p.fallback) AS keeps_ocr_blocks FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN per p ON d.doc_id = p.doc_id")
def fallback_layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose layout is only a fallback and so keep their first provider's blocks."""
    per = S.regions(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(F.col("block_type") == "UNKNOWN").alias("fallback"))
    n = F.coalesce("n", F.lit(0))
    return S.lines(spark, sf_dir).select("doc_id").distinct().join(per, "doc_id", "left").select("doc_id", n.alias("n_regions"), ((n == 0) | F.coalesce((F.col("n") == 1) & F.col("fallback"), F.lit(False))).alias("keeps_ocr_blocks"))


@query(f"WITH {S.BLOCKS_SQL} SELECT region_type, block_type, count(*) AS n FROM blocks GROUP BY region_type, block_type")
def block_type_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_blocks(spark, sf_dir).groupBy("region_type", "block_type").agg(F.count("*").alias("n"))


@query(f"WITH {S.BLOCKS_SQL} SELECT coalesce(block_type, 'ALL') AS block_type, count(*) AS n, CAST(sum(CASE WHEN unresolved THEN 1 ELSE 0 END) AS BIGINT) AS unresolved FROM blocks GROUP BY ROLLUP (block_type)")
def unresolved_blocks_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_blocks(spark, sf_dir).rollup("block_type").agg(F.count("*").alias("n"), F.count_if("unresolved").alias("unresolved")).select(F.coalesce("block_type", F.lit("ALL")).alias("block_type"), "n", "unresolved")


_BANDS = ["below 0.70", "0.70 to 0.719", "0.72 to 0.849", "0.85 and more"]
_BAND_SQL = "CASE WHEN confidence < 0.7E0 THEN 'below 0.70' WHEN confidence < 0.72E0 THEN '0.70 to 0.719' WHEN confidence < 0.85E0 THEN '0.72 to 0.849' ELSE '0.85 and more' END"


@query(f"WITH {S.BLOCKS_SQL} SELECT {_BAND_SQL} AS band, CAST(sum(CASE WHEN unresolved THEN 1 ELSE 0 END) AS BIGINT) AS unresolved, CAST(sum(CASE WHEN unresolved THEN 0 ELSE 1 END) AS BIGINT) AS resolved FROM blocks GROUP BY 1")
def confidence_band_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    band = F.when(c < 0.7, _BANDS[0]).when(c < 0.72, _BANDS[1]).when(c < 0.85, _BANDS[2]).otherwise(_BANDS[3])
    return all_blocks(spark, sf_dir).groupBy(band.alias("band")).agg(F.count_if("unresolved").alias("unresolved"), F.count_if(~F.col("unresolved")).alias("resolved"))


_SIMPLE_SQL = f"""WITH {S.BLOCKS_SQL}, page AS (SELECT doc_id, bool_or(width >= 680) AS wide FROM blocks GROUP BY doc_id),
beside AS (SELECT DISTINCT a.doc_id FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND a.ord < b.ord AND least(a.height, b.height) > 0
  AND a.y < b.y + b.height AND b.y < a.y + a.height
  AND least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) >= 0.25E0 * least(a.height, b.height)
  AND greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) <= 0.15E0 * least(a.width, b.width))"""


@query(f"{_SIMPLE_SQL} SELECT b.doc_id, b.ord, b.reading_order FROM blocks b JOIN page p ON b.doc_id = p.doc_id WHERE NOT p.wide AND b.doc_id NOT IN (SELECT doc_id FROM beside)")
def reading_order_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of pages without wide blocks and columns, where it is a sort."""
    found = all_blocks(spark, sf_dir)
    narrow = found.groupBy("doc_id").agg(F.bool_or(F.col("width") >= 680).alias("wide")).where("not wide")
    return found.join(narrow, "doc_id").join(L.parallel(found), "doc_id", "left_anti").select("doc_id", "ord", "reading_order")


@query()
def reading_order_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_order(all_blocks(spark, sf_dir), S.PAGE_WIDTH)


@query(f"{_SIMPLE_SQL} SELECT doc_id FROM beside")
def parallel_column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parallel(all_blocks(spark, sf_dir))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables: every TABLE region, its lines dealt to two columns by parity, as input of the inference."""
    lines = L.assign(S.lines(spark, sf_dir), S.regions(spark, sf_dir)).where("ord is not null")
    shifted = lines.withColumn("x", F.when(F.col("ln") % 2 == 0, F.col("x") + 400.0).otherwise(F.col("x"))).withColumn("width", F.lit(120.0)).withColumn("y", F.expr("cast(100 * (r div 2) as double)"))
    return L.tables(shifted, S.regions(spark, sf_dir))


@query()
def table_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_cells(spark, sf_dir)


_CELLS_SQL = f"""{S.LINES_SQL}, cells AS (SELECT doc_id, (r // 12) * 2 + col AS ord, (r % 12) // 3 AS "row", r % 3 AS "column", text FROM lines)"""


def modular_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of four rows and three columns: twelve lines of a column after another; a column's last table lacks cells."""
    lines = S.lines(spark, sf_dir)
    return lines.select("doc_id", F.expr("(r div 12) * 2 + col").alias("ord"), F.expr("(r % 12) div 3").alias("row"), (F.col("r") % 3).alias("column"), "text", F.lit(4).cast("long").alias("rows"), F.lit(3).cast("long").alias("columns"))


@query(f"""WITH {_CELLS_SQL}, grid AS (SELECT t.doc_id, t.ord, i.i, j.j FROM (SELECT DISTINCT doc_id, ord FROM cells) t, range(4) i(i), range(3) j(j)),
r AS (SELECT g.doc_id, g.ord, g.i, string_agg(coalesce(c.text, ''), chr(9) ORDER BY g.j) AS t FROM grid g LEFT JOIN cells c ON c.doc_id = g.doc_id AND c.ord = g.ord AND c."row" = g.i AND c."column" = g.j GROUP BY g.doc_id, g.ord, g.i)
SELECT doc_id, ord, md5(string_agg(t, chr(10) ORDER BY i)) AS literal_md5 FROM r GROUP BY doc_id, ord""")
def table_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table_literal(modular_cells(spark, sf_dir)).select("doc_id", "ord", F.md5(F.col("literal").cast("binary")).alias("literal_md5"))


@query(f"""WITH {S.REGIONS_SQL}, f AS (SELECT doc_id, ord, width, height, greatest(0.6E0, least(5.8E0, 6.87E0 * width / 1000)) AS w FROM regions WHERE block_type = 'FIGURE' AND width > 0)
SELECT doc_id, ord, round(CASE WHEN w * height / greatest(width, 1) > 7 THEN w * 7 / (w * height / greatest(width, 1)) ELSE w END, 6) AS width_in, round(least(w * height / greatest(width, 1), 7), 6) AS height_in FROM f""")
def figure_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = G.figure_inches(F.col("width"), F.col("height"), F.lit(1000.0))
    return S.regions(spark, sf_dir).where("block_type = 'FIGURE' and width > 0").select("doc_id", "ord", F.round(w, 6).alias("width_in"), F.round(h, 6).alias("height_in"))


@query(f"""WITH {S.REGIONS_SQL} SELECT doc_id, ord, CAST(greatest(0, floor(x)) AS BIGINT) AS "left", CAST(greatest(0, floor(y)) AS BIGINT) AS top, CAST(greatest(floor(x) + 1, least(1000, ceil(x + width))) AS BIGINT) AS "right" FROM regions WHERE block_type IN ('FIGURE', 'EQUATION_IMAGE')""")
def crop_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = G.crop_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit("pixel"), F.lit(1000), F.lit(1 << 30))
    return S.regions(spark, sf_dir).where("block_type in ('FIGURE', 'EQUATION_IMAGE')").select("doc_id", "ord", box.alias("b")).select("doc_id", "ord", F.col("b.left").cast("long").alias("left"), F.col("b.top").cast("long").alias("top"), F.col("b.right").cast("long").alias("right"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+(?:[A-Za-z0-9./%+-]*[A-Za-z0-9])?')) AS english, len(regexp_extract_all(text, '[0-9٠-٩]+(?:[.,٫٬][0-9٠-٩]+)?')) AS digits,
  len(regexp_extract_all(text, '\p{P}')) AS punctuation, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS tokens FROM documents WHERE text IS NOT NULL""")
def token_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    n = lambda c: F.size(c).cast("long")
    return S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", n(T.found(t, T.ENGLISH)).alias("english"), n(T.found(t, T.DIGITS)).alias("digits"), n(T.found(t, r"\p{P}")).alias("punctuation"), n(T.tokens(t)).alias("tokens"))


@query()
def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one script by line, counted by script."""
    runs = S.lines(spark, sf_dir).select("doc_id", F.explode(T.script_runs(F.col("text"))).alias("r"))
    return runs.groupBy("doc_id", F.col("r.script").alias("script")).agg(F.count("*").alias("runs"), F.sum(F.length("r.text")).alias("n_chars"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS nfc_md5 FROM documents WHERE text IS NOT NULL")
def unicode_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.nfc(F.col("text")).cast("binary")).alias("nfc_md5"))
