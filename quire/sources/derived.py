"""Pages, lines and regions derived from the text tables by fixed arithmetic, since those have no geometry.

One document is one page of 1000 pixels' width; documents with an id divisible by three have two columns. Everything is a
projection of the scan but the grouping of lines to regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH = 1000
#: Types that the derived regions take in turn.
TYPES = ["BODY_PARAGRAPH", "HEADING_1", "BULLET_LIST", "TABLE", "QUESTION", "CAPTION", "UNKNOWN", "FIGURE"]
#: Regions of these types stay even without lines.
VISUAL = ["FIGURE", "DECORATIVE_REGION", "EQUATION_IMAGE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), (number + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ln, col, r (row in the column), text, x, y, width, height, conf100."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "raw"))
    two = F.col("doc_id") % 3 == 0
    ln = F.col("ln").cast("long")
    placed = split.select("doc_id", ln.alias("ln"), F.col("raw").alias("text"), F.when(two, ln % 2).otherwise(0).alias("col"), F.when(two, F.expr("cast(ln as bigint) div 2")).otherwise(ln).alias("r"))
    width = F.least(F.when(two, 350).otherwise(800), 40 + 3 * F.length("text"))
    return placed.select(
        "doc_id",
        "ln",
        F.col("col").cast("long").alias("col"),
        "r",
        "text",
        F.when(two & (F.col("col") == 0), 550.0).otherwise(100.0).alias("x"),
        F.expr("cast(60 * r + 30 * (r div 5) + 60 * (r div 11) as double)").alias("y"),
        width.cast("double").alias("width"),
        F.lit(40.0).alias("height"),
        ((F.col("doc_id") * 31 + F.col("ln") * 17) % 101).alias("conf100"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, block_type, x, y, width, height, conf100: the envelope of six lines, and one small region inside some."""
    base = lines(spark, sf_dir).withColumn("grp", F.expr("r div 6")).where("(doc_id + grp + col) % 7 <> 3")
    outer = base.groupBy("doc_id", "col", "grp").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height")
    )
    outer = outer.select("doc_id", ((F.col("grp") * 2 + F.col("col")) * 2).alias("ord"), type_of((F.col("doc_id") + F.col("grp")) % 8).alias("block_type"), "x", "y", "width", "height", ((F.col("doc_id") * 13 + F.col("grp") * 7) % 101).alias("conf100"))
    inner = base.where("r % 6 = 1 and (doc_id + grp) % 4 = 0").select("doc_id", ((F.col("grp") * 2 + F.col("col")) * 2 + 1).alias("ord"), type_of((F.col("doc_id") + F.col("grp") + 1) % 8).alias("block_type"), "x", "y", "width", "height", "conf100")
    # Figures that no line lies in.
    empty = outer.where("ord % 12 = 0").select("doc_id", (F.col("ord") + 500000).alias("ord"), F.when(F.col("doc_id") % 2 == 0, "FIGURE").otherwise("CAPTION").alias("block_type"), F.lit(920.0).alias("x"), "y", F.lit(60.0).alias("width"), F.lit(30.0).alias("height"), "conf100")
    return outer.unionByName(inner).unionByName(empty)


#: The same views for DuckDB.
LINES_SQL = """
s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) - 1 AS ln FROM s),
p AS (SELECT doc_id, ln, raw AS text,
             CASE WHEN doc_id % 3 = 0 THEN ln % 2 ELSE 0 END AS col,
             CASE WHEN doc_id % 3 = 0 THEN ln // 2 ELSE ln END AS r FROM e),
lines AS (SELECT doc_id, ln, col, r, text,
             CASE WHEN doc_id % 3 = 0 AND col = 0 THEN 550.0E0 ELSE 100.0E0 END AS x,
             CAST(60 * r + 30 * (r // 5) + 60 * (r // 11) AS DOUBLE) AS y,
             CAST(least(CASE WHEN doc_id % 3 = 0 THEN 350 ELSE 800 END, 40 + 3 * length(text)) AS DOUBLE) AS width,
             40.0E0 AS height, (doc_id * 31 + ln * 17) % 101 AS conf100, r // 6 AS grp FROM p)"""

_TYPES = "['BODY_PARAGRAPH', 'HEADING_1', 'BULLET_LIST', 'TABLE', 'QUESTION', 'CAPTION', 'UNKNOWN', 'FIGURE']"

REGIONS_SQL = f"""{LINES_SQL},
base AS (SELECT * FROM lines WHERE (doc_id + grp + col) % 7 <> 3),
outer_r AS (SELECT doc_id, (grp * 2 + col) * 2 AS ord, {_TYPES}[CAST((doc_id + grp) % 8 + 1 AS INTEGER)] AS block_type,
             min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height,
             (doc_id * 13 + grp * 7) % 101 AS conf100 FROM base GROUP BY doc_id, col, grp),
regions AS (SELECT * FROM outer_r
  UNION ALL SELECT doc_id, (grp * 2 + col) * 2 + 1, {_TYPES}[CAST((doc_id + grp + 1) % 8 + 1 AS INTEGER)], x, y, width, height, conf100
            FROM base WHERE r % 6 = 1 AND (doc_id + grp) % 4 = 0
  UNION ALL SELECT doc_id, ord + 500000, CASE WHEN doc_id % 2 = 0 THEN 'FIGURE' ELSE 'CAPTION' END, 920.0E0, y, 60.0E0, 30.0E0, conf100
            FROM outer_r WHERE ord % 12 = 0)"""

ASSIGNED_SQL = f"""{REGIONS_SQL},
cand AS (SELECT l.doc_id, l.ln, g.ord, row_number() OVER (PARTITION BY l.doc_id, l.ln ORDER BY g.width * g.height, g.ord) AS k
         FROM lines l JOIN regions g ON l.doc_id = g.doc_id
          AND l.x + l.width / 2 BETWEEN g.x AND g.x + g.width AND l.y + l.height / 2 BETWEEN g.y AND g.y + g.height),
assigned AS (SELECT l.*, c.ord FROM lines l LEFT JOIN (SELECT * FROM cand WHERE k = 1) c ON l.doc_id = c.doc_id AND l.ln = c.ln)"""

#: Every line with its block, its neighbour's decision, and the separator before it.
BOUNDARY_SQL = f"""{ASSIGNED_SQL},
member AS (SELECT a.doc_id, coalesce(a.ord, 1000000 + a.ln) AS ord, coalesce(g.block_type, 'UNKNOWN') AS block_type, a.ln, a.text, a.x, a.y, a.width, a.height, a.conf100
           FROM assigned a LEFT JOIN regions g ON a.doc_id = g.doc_id AND a.ord = g.ord),
seq AS (SELECT *, lag(text) OVER w AS t0, lag(x + width) OVER w AS r0, lag(y + height) OVER w AS b0, lag(height) OVER w AS h0, lag(width) OVER w AS w0, lag(ln) OVER w AS ln0
        FROM member WINDOW w AS (PARTITION BY doc_id, ord ORDER BY y, x DESC, ln)),
geo AS (SELECT *, greatest(0, y - b0) / greatest(h0, height, 1) AS g, abs(r0 - (x + width)) / greatest(w0, 1) AS d FROM seq),
bound AS (SELECT *, CASE
    WHEN ln0 IS NULL THEN NULL
    WHEN block_type = 'TABLE' THEN 'TABLE_CELL_BOUNDARY'
    WHEN regexp_matches(text, '^\\s*(?:[-•●▪◦*]|\\(?[0-9٠-٩]+[.)-]|[أ-ي][.)-])\\s+') THEN 'LIST_ITEM_BOUNDARY'
    WHEN g >= 1.8E0 THEN 'BLANK_PARAGRAPH_SPACE'
    WHEN g >= 0.9E0 AND (d >= 0.08E0 OR regexp_matches(t0, '[.!?؟؛:]\\s*$')) THEN 'NEW_PARAGRAPH'
    WHEN (ends_with(t0, '-') OR ends_with(t0, 'ـ')) AND g < 0.55E0 THEN 'CONTINUE_WITHOUT_SPACE'
    WHEN block_type IN ('CAPTION', 'QUESTION', 'ANSWER_OPTION') AND g > 0.65E0 THEN 'SOFT_LINE_BREAK'
    ELSE 'CONTINUE_WITH_SPACE' END AS boundary FROM geo)"""

CONFIDENCE_SQL = """CASE boundary WHEN 'TABLE_CELL_BOUNDARY' THEN 0.98E0 WHEN 'LIST_ITEM_BOUNDARY' THEN 0.96E0
  WHEN 'BLANK_PARAGRAPH_SPACE' THEN least(0.98E0, 0.75E0 + g / 10) WHEN 'NEW_PARAGRAPH' THEN 0.88E0
  WHEN 'CONTINUE_WITHOUT_SPACE' THEN 0.8E0 WHEN 'SOFT_LINE_BREAK' THEN 0.78E0 WHEN 'CONTINUE_WITH_SPACE' THEN 0.76E0 END"""

SEPARATOR_SQL = """CASE boundary WHEN 'CONTINUE_WITH_SPACE' THEN ' ' WHEN 'SOFT_LINE_BREAK' THEN chr(10) WHEN 'LIST_ITEM_BOUNDARY' THEN chr(10)
  WHEN 'NEW_PARAGRAPH' THEN chr(10) || chr(10) WHEN 'BLANK_PARAGRAPH_SPACE' THEN chr(10) || chr(10) WHEN 'TABLE_CELL_BOUNDARY' THEN chr(9) ELSE '' END"""

BLOCKS_SQL = f"""{BOUNDARY_SQL},
agg AS (SELECT doc_id, ord, count(*) AS n_lines, round(sum(conf100) / count(*) / 100.0E0, 6) AS confidence,
          string_agg({SEPARATOR_SQL} || text, '' ORDER BY y, x DESC, ln) AS literal,
          coalesce(bool_or({CONFIDENCE_SQL} < 0.8E0), FALSE) AS unsure,
          min(x) AS lx, min(y) AS ly, min(width) AS lw, min(height) AS lh FROM bound GROUP BY doc_id, ord),
raw_blocks AS (
  SELECT g.doc_id, g.ord, g.block_type AS region_type, g.x, g.y, g.width, g.height, coalesce(a.n_lines, 0) AS n_lines,
         coalesce(a.confidence, round(g.conf100 / 100.0E0, 6)) AS confidence, coalesce(a.literal, '') AS literal, coalesce(a.unsure, FALSE) AS unsure
  FROM regions g LEFT JOIN agg a ON a.doc_id = g.doc_id AND a.ord = g.ord
  WHERE a.doc_id IS NOT NULL OR g.block_type IN ('FIGURE', 'DECORATIVE_REGION', 'EQUATION_IMAGE')
  UNION ALL SELECT doc_id, ord, 'UNKNOWN', lx, ly, lw, lh, n_lines, confidence, literal, unsure FROM agg WHERE ord >= 1000000),
typed AS (SELECT *, CASE
    WHEN region_type IN ('UNKNOWN', 'BODY_PARAGRAPH') AND (starts_with(trim(literal), 'س:') OR starts_with(trim(literal), 'سؤال') OR starts_with(trim(literal), '؟') OR ends_with(trim(literal), '؟')) THEN 'QUESTION'
    WHEN region_type IN ('UNKNOWN', 'BODY_PARAGRAPH') AND regexp_matches(trim(literal), '^[-•●▪◦*] ') THEN 'BULLET_LIST'
    WHEN region_type IN ('UNKNOWN', 'BODY_PARAGRAPH') AND length(trim(literal)) <= 260 AND regexp_matches(trim(literal), '^\\s*[0-9٠-٩]+(?:\\s*[-.):]|\\s+)') THEN 'QUESTION'
    WHEN region_type <> 'UNKNOWN' THEN region_type
    WHEN length(trim(literal)) <= 80 AND confidence >= 0.7E0 AND n_lines = 1 THEN 'HEADING_3'
    ELSE 'UNKNOWN' END AS block_type FROM raw_blocks),
blocks AS (SELECT *, confidence < 0.7E0 OR block_type = 'UNKNOWN' AS unresolved,
             row_number() OVER (PARTITION BY doc_id ORDER BY y, x DESC, ord) - 1 AS reading_order FROM typed),
moved AS (SELECT doc_id, ord, CASE WHEN (doc_id + ord) % 13 = 0 THEN 'BODY_PARAGRAPH' ELSE block_type END AS block_type,
          x + ord % 5 AS x, y + ord % 5 AS y, width, height, confidence,
          CASE WHEN (doc_id + ord) % 23 = 0 THEN '' WHEN (doc_id + ord) % 29 = 0 THEN regexp_replace(literal, '[a-z]', '#', 'g') WHEN (doc_id + ord) % 7 = 0 THEN replace(literal, 'e', 'c') ELSE literal END AS literal, unresolved
        FROM blocks WHERE (doc_id + ord) % 11 <> 0
  UNION ALL SELECT doc_id, ord + 2000000, 'BODY_PARAGRAPH', x + 2000, y, width, height, confidence, 'only here', FALSE FROM blocks WHERE (doc_id + ord) % 17 = 0),
hyp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x DESC, ord) - 1 AS reading_order FROM moved)"""
