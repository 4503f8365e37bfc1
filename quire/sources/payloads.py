"""Provider payloads to lines, regions and cells; canonical documents from and to storage.

Payloads arrive as JSON strings, one row a page: nothing is inferred on read, and what does not fit its schema fails the job.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BBOX = "struct<x:double,y:double,width:double,height:double,coordinate_space:string>"
CELL = f"struct<row:int,column:int,row_span:int,column_span:int,text:string,bbox:{BBOX}>"
BLOCK = f"struct<id:string,block_type:string,bbox:{BBOX},reading_order:int,literal_text:string,unicode_normalized_text:string,approved_corrected_text:string,confidence:double,paragraph_direction:string,table:struct<rows:int,columns:int,cells:array<{CELL}>>,unresolved:boolean,source_crop:string>"
PAGE = f"page_number int, width int, height int, status string, warnings array<string>, error string, timings_ms map<string,int>, blocks array<{BLOCK}>, usage array<struct<provider:string,api_calls:int,pages_billed:int,input_tokens:int,output_tokens:int,estimated_cost:double,currency:string>>"
DOCUMENT = f"id string, title string, source_filename string, source_sha256 string, classification string, created_at timestamp, updated_at timestamp, pages array<struct<{', '.join(':'.join(x.split(' ', 1)) for x in PAGE.split(', '))}>>"

#: Layout labels and paragraph roles.
LABELS = {
    "doc_title": "DOCUMENT_TITLE",
    "title": "HEADING_1",
    "header": "HEADER",
    "footer": "FOOTER",
    "paragraph_title": "HEADING_2",
    "section_title": "HEADING_2",
    "text": "BODY_PARAGRAPH",
    "table": "TABLE",
    "table_title": "CAPTION",
    "table_caption": "CAPTION",
    "figure": "FIGURE",
    "image": "FIGURE",
    "figure_title": "CAPTION",
    "figure_caption": "CAPTION",
    "chart": "FIGURE",
    "formula": "EQUATION_IMAGE",
    "number": "PAGE_NUMBER",
}
ROLES = {"title": "DOCUMENT_TITLE", "sectionheading": "HEADING_1", "pageheader": "HEADER", "pagefooter": "FOOTER", "pagenumber": "PAGE_NUMBER"}


def mapped(names: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key], F.lit(default))


def envelope(points: Column, width: Column, height: Column) -> Column:
    """Box around [x1, y1, x2, y2] or a flat polygon x, y, x, y, ...; the whole page if there is none."""
    xs, ys = F.filter(points, lambda _, i: i % 2 == 0), F.filter(points, lambda _, i: i % 2 == 1)
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    zero = F.lit(0.0)
    return F.when(F.coalesce(F.size(points), F.lit(0)) >= 4, box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))).otherwise(box(zero, zero, width.cast("double"), height.cast("double")))


def parsed(payload: Column, schema: str) -> Column:
    return F.from_json(payload, schema, {"mode": "FAILFAST"})


def local_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, width, height, payload to one row a line: texts, scores and boxes meet by position. A page without lines is an error."""
    res = parsed(F.col("payload"), "rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, dt_polys array<array<double>>")
    read = pages.withColumn("p", res).withColumn("texts", F.when(F.coalesce(F.size("p.rec_texts"), F.lit(0)) > 0, F.col("p.rec_texts")).otherwise(F.raise_error(F.lit("the page has no recognised lines")).cast("array<string>")))
    lines = read.select("doc_id", "page", "width", "height", "p", F.posexplode("texts").alias("ln", "text"))
    boxes = F.coalesce("p.rec_boxes", "p.dt_polys")
    return lines.select("doc_id", "page", "ln", "text", envelope(F.get(boxes, F.col("ln")), F.col("width"), F.col("height")).alias("b"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.get("p.rec_scores", F.col("ln")), F.lit(0.0)))).alias("confidence")).select("doc_id", "page", "ln", "text", "b.*", "confidence")


def local_regions(pages: DataFrame) -> DataFrame:
    """Layout payloads to regions with a type for each label; a page without boxes is one region as large as it."""
    res = parsed(F.col("payload"), "boxes array<struct<label:string,score:double,coordinate:array<double>>>")
    read = pages.withColumn("p", res).select("doc_id", "page", "width", "height", F.posexplode_outer("p.boxes").alias("ord", "r"))
    return read.select("doc_id", "page", F.coalesce("ord", F.lit(0)).alias("ord"), F.when(F.col("r").isNull(), "UNKNOWN").otherwise(mapped(LABELS, F.lower("r.label"), "UNKNOWN")).alias("block_type"), envelope(F.col("r.coordinate"), F.col("width"), F.col("height")).alias("b"), F.coalesce("r.score", F.lit(0.0)).alias("confidence"), F.coalesce("r.label", F.lit("full-page-fallback")).alias("raw_label")).select("doc_id", "page", "ord", "block_type", "b.*", "confidence", "raw_label")


_CLOUD = "paragraphs array<struct<content:string,role:string,polygon:array<double>,spans:array<struct<offset:int,length:int>>>>, lines array<struct<content:string,polygon:array<double>,spans:array<struct<offset:int,length:int>>>>, words array<struct<offset:int,length:int,confidence:double>>, tables array<struct<rows:int,columns:int,polygon:array<double>,cells:array<struct<row:int,column:int,row_span:int,column_span:int,content:string>>>>"


def span_confidence(words: Column, spans: Column) -> Column:
    """Mean confidence of the words of a page that lie in one of a paragraph's few spans; 0 without any."""
    held = F.filter(words, lambda w: F.exists(spans, lambda s: (w["offset"] >= s["offset"]) & (w["offset"] + w["length"] <= s["offset"] + s["length"])))
    total = F.aggregate(held, F.lit(0.0), lambda a, w: a + F.coalesce(w["confidence"], F.lit(0.0)))
    return F.coalesce(total / F.when(F.size(held) > 0, F.size(held)), F.lit(0.0))


def cloud_blocks(pages: DataFrame) -> DataFrame:
    """Paragraphs (or lines, if there are none) and tables of a cloud payload as blocks; tables have confidence 0."""
    read = pages.withColumn("p", parsed(F.col("payload"), _CLOUD))
    w, h = F.col("width"), F.col("height")
    make = lambda kind, text, poly, conf, rows, cols: F.struct(kind.alias("block_type"), text.alias("text"), envelope(poly, w, h).alias("b"), conf.cast("double").alias("confidence"), rows.cast("int").alias("rows"), cols.cast("int").alias("columns"))
    none = F.lit(None)
    words = F.coalesce("p.words", F.expr("cast(array() as array<struct<offset:int,length:int,confidence:double>>)"))
    paragraphs = F.transform(F.filter("p.paragraphs", lambda x: F.size(x["polygon"]) > 0), lambda x: make(mapped(ROLES, F.lower(F.coalesce(x["role"], F.lit(""))), "BODY_PARAGRAPH"), x["content"], x["polygon"], span_confidence(words, x["spans"]), none, none))
    lines = F.transform("p.lines", lambda x: make(F.lit("UNKNOWN"), x["content"], x["polygon"], span_confidence(words, x["spans"]), none, none))
    tables = F.transform("p.tables", lambda x: make(F.lit("TABLE"), F.lit(""), x["polygon"], F.lit(0.0), x["rows"], x["columns"]))
    found = F.concat(F.when(F.coalesce(F.size(paragraphs), F.lit(0)) > 0, paragraphs).otherwise(F.coalesce(lines, F.slice(tables, 1, 0), F.slice(paragraphs, 1, 0))), F.coalesce(tables, F.slice(paragraphs, 1, 0), F.slice(lines, 1, 0)))
    return read.select("doc_id", "page", F.posexplode(found).alias("ord", "k")).select("doc_id", "page", "ord", "k.block_type", "k.text", "k.b.*", "k.confidence", "k.rows", "k.columns")


def cloud_cells(pages: DataFrame) -> DataFrame:
    """doc_id, page, table, row, column, row_span, column_span, text: the cells of the tables of a cloud payload; a span that is not named is 1."""
    tables = pages.select("doc_id", "page", F.posexplode(parsed(F.col("payload"), _CLOUD)["tables"]).alias("table", "t"))
    cells = tables.select("doc_id", "page", "table", F.explode("t.cells").alias("c"))
    span = lambda name: F.greatest(F.coalesce(F.col(f"c.{name}"), F.lit(1)), F.lit(1)).alias(name)
    return cells.select("doc_id", "page", "table", "c.row", "c.column", span("row_span"), span("column_span"), F.coalesce("c.content", F.lit("")).alias("text"))


def desktop_lines(pages: DataFrame) -> DataFrame:
    """Desktop OCR records: a line's box is around its words' rectangles of four numbers, else the page; its confidence is unknown and counts as 0.5. Exactly one record a page."""
    schema = "records array<struct<lines:array<struct<text:string,words:array<struct<bounding_rect:array<double>>>>>>>"
    read = pages.withColumn("p", parsed(F.col("payload"), schema))
    one = F.when(F.size("p.records") == 1, F.col("p.records")[0]["lines"]).otherwise(F.raise_error(F.lit("not exactly one page record")).cast("array<struct<text:string,words:array<struct<bounding_rect:array<double>>>>>"))
    lines = read.select("doc_id", "page", "width", "height", F.posexplode(one).alias("ln", "l"))
    rects = F.filter(F.transform("l.words", lambda x: x["bounding_rect"]), lambda r: F.size(r) == 4)
    corners = F.flatten(F.transform(rects, lambda r: F.array(r[0], r[1], r[0] + r[2], r[1] + r[3])))
    return lines.select("doc_id", "page", "ln", F.coalesce("l.text", F.lit("")).alias("text"), envelope(corners, F.col("width"), F.col("height")).alias("b"), F.lit(0.5).alias("confidence"), F.lit(False).alias("confidence_available")).select("doc_id", "page", "ln", "text", "b.*", "confidence", "confidence_available")


def mock_pages(spark: SparkSession, pages: int, lines: int = 3, failing: tuple[int, ...] = ()) -> DataFrame:
    """Synthetic lines at computed places; pages listed as failing have none and a status that says so."""
    made = spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("ln"))
    failed = F.col("page").isin(*failing) if failing else F.lit(False)
    return made.select("page", "ln", F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), F.when(~failed, F.format_string("line %d of page %d", F.col("ln") + 1, F.col("page"))).alias("text"), F.lit(80.0).alias("x"), (100.0 + 60 * F.col("ln")).alias("y"), F.lit(640.0).alias("width"), F.lit(40.0).alias("height"), F.lit(0.99).alias("confidence"))


def full_page_layout(pages: DataFrame, inset: float = 0.0) -> DataFrame:
    """One region a page: inset by a share of its size, or the whole page as a fallback."""
    label = "full-page-fallback" if inset == 0 else "mock"
    return pages.select("doc_id", "page", F.lit("UNKNOWN" if inset == 0 else "BODY_PARAGRAPH").alias("block_type"), (F.col("width") * inset).alias("x"), (F.col("height") * inset).alias("y"), (F.col("width") * (1 - 2 * inset)).alias("width"), (F.col("height") * (1 - 2 * inset)).alias("height"), F.lit(label).alias("raw_label"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Canonical documents: JSON with a fixed schema; a malformed file fails."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def documents_or_none(spark: SparkSession, path: str) -> DataFrame:
    """The same, or no rows where the path does not exist. Spark resolves the path, so any store that it reads will do."""
    try:
        return documents(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DOCUMENT)


def write_documents(docs: DataFrame, path: str) -> None:
    """Canonical documents as JSON, a file each, nulls written out; readers see all of a write or nothing."""
    docs.write.mode("overwrite").option("maxRecordsPerFile", 1).option("ignoreNullFields", False).json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Page checkpoints, a folder a document: a page is replaced whole, and readers see either all of a write or nothing. Ids must be plain names."""
    safe = F.when(F.col("doc_id").cast("string").rlike("^[A-Za-z0-9_-]+$"), F.col("doc_id")).otherwise(F.raise_error(F.lit("unsafe id")).cast(pages.schema["doc_id"].dataType))
    pages.withColumn("doc_id", safe).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def checkpoint(spark: SparkSession, path: str, doc_id: str, page: int) -> DataFrame:
    """One page: the document's folder is all that is listed, and the page number reaches the scan."""
    return spark.read.parquet(path).where((F.col("doc_id") == doc_id) & (F.col("page_number") == page)).withColumn("asset", F.concat(F.lit("pages/"), F.lpad(F.col("page_number").cast("string"), 4, "0")))


def jobs(status: DataFrame, summary: DataFrame, manifest: DataFrame) -> DataFrame:
    """Jobs newest first with what is known of each; a job with a summary and no status is complete."""
    joined = status.join(summary, "job", "full").join(manifest, "job", "left")
    state = F.coalesce("state", F.when(F.col("summary").isNotNull(), "COMPLETED"))
    return joined.withColumn("state", state).orderBy(F.desc_nulls_last("updated_at"), "job")


def availability(settings: dict[str, bool]) -> list[tuple[str, bool, str]]:
    """Readiness of each provider by what is configured; secrets never show."""
    need = {"mock": [], "local": ["local_models"], "windows": ["windows"], "azure": ["azure_key"], "gemini": ["gemini_key"], "hybrid": ["local_models", "azure_key"], "maximum_accuracy": ["azure_key", "gemini_key"], "unlimited": ["gpu_8gb"]}
    return [(name, all(settings.get(k, False) for k in keys), ", ".join(k for k in keys if not settings.get(k, False))) for name, keys in need.items()]
