"""A small document that shows every kind of block, for demonstrations and tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from quire.sources.payloads import DOCUMENT

#: Type and text of the blocks of the page, from top to bottom.
BLOCKS = [
    ("DOCUMENT_TITLE", "كتاب القراءة"),
    ("HEADING_1", "الدرس الأول"),
    ("BODY_PARAGRAPH", "يقرأ الطالب النص ثم يجيب."),
    ("BULLET_LIST", "• قلم\n• دفتر"),
    ("TABLE", ""),
    ("CAPTION", "جدول 1: عدد الكتب"),
    ("QUESTION", "س: كم كتاباً في الجدول؟"),
    ("BODY_PARAGRAPH", "An English line, 12%."),
    ("FIGURE", ""),
]
CELLS = [["الصف", "كتب", "أقلام"], ["1", "3", "5"], ["2", "4", "6"]]


def demo_document(spark: SparkSession) -> DataFrame:
    """One document of one page of nine blocks, with a table of three rows and columns, in the canonical schema."""
    box = lambda y, height, x=80.0, width=640.0: (x, y, width, height, "pixels")
    cells = [(r, c, 1, 1, text, box(500.0 + 40 * r, 40.0, 80.0 + 200 * c, 200.0)) for r, row in enumerate(CELLS) for c, text in enumerate(row)]
    blocks = []
    for i, (kind, text) in enumerate(BLOCKS):
        table = (len(CELLS), len(CELLS[0]), cells) if kind == "TABLE" else None
        direction = "ltr" if text.isascii() and text else "rtl"
        blocks.append((f"b{i + 1}", kind, box(100.0 * (i + 1), 80.0), i, text, text, None, 0.95, direction, table, kind == "FIGURE", "assets/b9.png" if kind == "FIGURE" else None))
    made = datetime(2024, 1, 1)
    page = (1, 800, 1100, "COMPLETED", [], None, {"total": 0}, blocks, [])
    return spark.createDataFrame([("demo", "Demo", "demo.pdf", "0" * 64, "EVALUATION_ONLY", made, made, [page])], DOCUMENT)
