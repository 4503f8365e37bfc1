"""Report rows: styles, formatting instructions, table placement, summaries. Files are written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Paragraph styles, font sizes in points, evaluation modes.
STYLES = {
    "DOCUMENT_TITLE": "Title",
    "CHAPTER_TITLE": "Heading 1",
    "HEADING_1": "Heading 1",
    "HEADING_2": "Heading 2",
    "HEADING_3": "Heading 3",
    "QUESTION": "OCR Question",
    "ANSWER_OPTION": "OCR Answer Option",
    "CAPTION": "OCR Caption",
    "DEFINITION_BOX": "OCR Note",
    "EXAMPLE_BOX": "OCR Note",
    "NOTE_BOX": "OCR Note",
    "UNKNOWN": "OCR Unknown",
}
POINTS = {"SMALL": 10, "NORMAL": 12, "MEDIUM": 14, "LARGE": 17, "EXTRA_LARGE": 22}
ALIGNMENTS = ["RIGHT", "LEFT", "CENTER", "JUSTIFY"]
#: What a paragraph takes from its block's formatting as it is; null inherits from the style.
INHERITED = ["space_before_pt", "space_after_pt", "left_indent_pt", "right_indent_pt", "keep_with_next", "bold"]


def _lookup(names: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key]


def style_of(kind: Column) -> Column:
    return F.coalesce(_lookup(STYLES, kind), F.lit("Normal"))


def points_of(size: Column) -> Column:
    """Font size of a class; null stays null and so inherits."""
    return _lookup(POINTS, size)


def instructed(blocks: DataFrame, instructions: DataFrame) -> DataFrame:
    """Blocks under formatting instructions (doc_id, ord, new_type, alignment, size): unknown blocks are ignored, texts never change."""
    joined = blocks.join(instructions, ["doc_id", "ord"], "left")
    return joined.withColumn("block_type", F.coalesce("new_type", "block_type")).withColumn("points", points_of(F.col("size"))).drop("new_type")


def formatted(blocks: DataFrame, formatting: DataFrame) -> DataFrame:
    """doc_id, ord, style, alignment, points and INHERITED of every block. formatting: doc_id, ord, alignment, size and any of INHERITED.

    What is null, or no alignment or size that there is, inherits from the style; so does all of a block without formatting.
    """
    known = [c for c in INHERITED if c in formatting.columns]
    joined = blocks.select("doc_id", "ord", "block_type").join(formatting.select("doc_id", "ord", "alignment", "size", *known), ["doc_id", "ord"], "left")
    alignment = F.when(F.col("alignment").isin(ALIGNMENTS), F.col("alignment"))
    return joined.select("doc_id", "ord", style_of(F.col("block_type")).alias("style"), alignment.alias("alignment"), points_of(F.col("size")).alias("points"), *known)


def placed(cells: DataFrame) -> DataFrame:
    """Cells (rows, columns, row, column, row_span, column_span) that lie in their table, with the last row and column of their span cut to it; the first row is the header."""
    held = cells.where("row < rows and column < columns")
    return held.withColumns({"last_row": F.expr("least(rows - 1, row + row_span - 1)"), "last_column": F.expr("least(columns - 1, column + column_span - 1)"), "header": F.col("row") == 0})


def measured(metrics: DataFrame) -> DataFrame:
    """Metric and value as text: six decimals, N/A for what was not measured."""
    return metrics.select("metric", F.coalesce(F.format_string("%.6f", "value"), F.lit("N/A")).alias("shown"))


def correction_rows(corrections: DataFrame) -> DataFrame:
    """doc_id, n, html_md5: a page's corrections as the rows of an HTML table, in the order of blocks."""
    cells = [F.col("ord").cast("string"), T.html_escaped(F.col("literal")), T.html_escaped(F.col("corrected")), T.html_escaped(F.col("reason")), F.format_string("%.3f", "confidence")]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    parts = F.array_sort(F.collect_list(F.struct("ord", row.alias("h"))))
    return corrections.groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(parts, lambda p: p["h"]), "\n").cast("binary")).alias("html_md5"))
