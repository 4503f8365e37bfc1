"""Whole documents: layout applied to a provider's blocks, pages reconciled, paragraphs rendered, text read back, reviews written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import layout as L
from quire.operators import report as O
from quire.operators import review as R
from quire.sources.derived import VISUAL

#: What begins an item of a list when it is rendered, and when the rendered text is checked.
BULLET_MARK = r"^\s*[-•●▪◦*]\s*"
NUMBER_MARK = r"^\s*\(?[0-9٠-٩]+[.)-]\s*"
CHECKED_MARK = r"^\s*(?:[•◦▪‣\-–—]|[0-9٠-٩]+[.)-])\s*"
#: Line ends, types that stand around a page's body, types that show their name where they have no text.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
FOOTERS = ["FOOTER", "PAGE_NUMBER"]
NAMED = ["UNKNOWN", "EQUATION_IMAGE", "DECORATIVE_REGION"]
LISTS = ["BULLET_LIST", "NUMBERED_LIST"]
TERMINAL_STATES = ["COMPLETED", "COMPLETED_WITH_ERRORS", "FAILED", "CANCELLED"]


def laid_out(lines: DataFrame, regions: DataFrame, ocr: DataFrame, fallback: DataFrame) -> DataFrame:
    """doc_id, ord, block_type, n_lines, origin of a page's blocks once its layout is applied.

    ocr: doc_id, ord, block_type, n_lines, has_table of the provider's own blocks; fallback: doc_id of pages whose only region
    stands for the whole page. Those keep the provider's blocks as they are if any has a type; all others get a block for every
    region with lines or of a visual type, the provider's tables, and one for each line outside.
    """
    typed = ocr.where("block_type <> 'UNKNOWN'").select("doc_id").distinct()
    verbatim = fallback.select("doc_id").distinct().join(typed, "doc_id", "left_semi")
    own = lambda df, origin: df.select("doc_id", "ord", "block_type", F.col("n_lines").cast("long").alias("n_lines"), F.lit(origin).alias("origin"))
    held = L.assign(lines, regions).join(verbatim, "doc_id", "left_anti")
    counted = held.where("ord is not null").groupBy("doc_id", "ord").agg(F.count("*").alias("n_lines"))
    placed = regions.join(verbatim, "doc_id", "left_anti").join(counted, ["doc_id", "ord"], "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    alone = held.where("ord is null").select("doc_id", (1000000 + F.col("ln")).alias("ord"), F.lit("UNKNOWN").alias("block_type"), F.lit(1).alias("n_lines"))
    laid = own(placed.where((F.col("n_lines") > 0) | F.col("block_type").isin(VISUAL)), "region").unionAll(own(ocr.where("has_table").join(verbatim, "doc_id", "left_anti"), "table")).unionAll(own(alone, "line"))
    # A page that nothing was laid out for keeps what it had.
    kept = ocr.join(laid.select("doc_id").distinct(), "doc_id", "left_anti")
    return laid.unionAll(own(kept, "ocr"))


def reconciled(blocks: DataFrame, verifier: DataFrame, matches: DataFrame, decide, failed: Column) -> DataFrame:
    """One row a page: status, blocks, triggered, corrected, unresolved, verifier_only.

    The blocks of both providers meet by `matches`; what disagrees or is uncertain goes to `decide`, which adds the columns of a
    decision; sufficient decisions are applied. failed: of a page; it stays as a row without blocks.
    """
    theirs = matches.select("doc_id", "ord", "verifier_ord").join(verifier.select("doc_id", F.col("ord").alias("verifier_ord"), F.col("literal").alias("theirs")), ["doc_id", "verifier_ord"])
    paired = blocks.join(theirs.select("doc_id", "ord", "theirs"), ["doc_id", "ord"], "left")
    judged = R.automatic_correction(decide(paired.withColumn("reason", R.trigger(F.col("confidence"), F.col("literal"), F.col("theirs")))))
    hit = F.col("reason").isNotNull()
    alone = verifier.where(F.trim("literal") != "").join(matches.select("doc_id", F.col("verifier_ord").alias("ord")), ["doc_id", "ord"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("alone"))
    pages = judged.groupBy("doc_id").agg(
        F.count("*").alias("blocks"),
        F.count_if(hit).alias("triggered"),
        F.count_if(hit & F.col("applied")).alias("corrected"),
        F.count_if(F.when(hit, F.col("unresolved_after")).otherwise(F.col("unresolved"))).alias("unresolved"),
    )
    n = lambda c: F.when(failed, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return pages.join(alone.withColumnRenamed("alone", "verifier_only"), "doc_id", "left").select("doc_id", F.when(failed, "FAILED").otherwise("COMPLETED").alias("status"), *[n(c) for c in ("blocks", "triggered", "corrected", "unresolved", "verifier_only")])


def rendered(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, part, seq, style, numbering, text: the paragraphs of every page.

    pages: doc_id, status, error. Header and footer are a paragraph each, their blocks beside each other. A page that is not
    complete is one paragraph that says so. Items of lists lose their mark and are numbered; other blocks part at blank lines.
    """
    held = blocks.join(pages.select("doc_id", "status"), "doc_id")
    around = held.where(F.col("block_type").isin("HEADER", *FOOTERS)).select("doc_id", F.when(F.col("block_type") == "HEADER", "header").otherwise("footer").alias("part"), "reading_order", "ord", "literal")
    joined = around.groupBy("doc_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "ord", "literal"))), lambda b: b["literal"]), " | ").alias("text"))
    both = pages.select("doc_id", F.explode(F.array(F.lit("header"), F.lit("footer"))).alias("part")).join(joined, ["doc_id", "part"], "left")
    outside = both.select("doc_id", "part", F.lit(0).cast("long").alias("seq"), F.lit("Normal").alias("style"), F.lit("").alias("numbering"), F.coalesce("text", F.lit("")).alias("text"))
    broken = pages.where("status <> 'COMPLETED'").select("doc_id", F.lit("failure").alias("part"), F.lit(1).cast("long").alias("seq"), F.lit("OCR Unknown").alias("style"), F.lit("").alias("numbering"), F.format_string("[Page %d failed: %s]", "doc_id", F.coalesce("error", F.lit("unknown error"))).alias("text"))
    kind = F.col("block_type")
    listed = kind.isin(*LISTS)
    mark = lambda line: F.when(kind == "BULLET_LIST", F.regexp_replace(line, BULLET_MARK, "")).otherwise(F.regexp_replace(line, NUMBER_MARK, ""))
    items = F.transform(F.filter(F.split("literal", LINE_END), lambda t: T.squeezed(t) != ""), mark)
    parts = F.when(listed, items).otherwise(F.split("literal", "\n\n"))
    body = held.where((F.col("status") == "COMPLETED") & ~kind.isin("HEADER", *FOOTERS)).select("doc_id", "reading_order", "ord", "block_type", F.posexplode(parts).alias("i", "t"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("reading_order", "ord", "i")).cast("long")
    shown = F.when((F.col("t") == "") & kind.isin(*NAMED), F.concat(F.lit("["), kind, F.lit(" - unresolved]"))).otherwise(F.col("t"))
    body = body.select("doc_id", F.lit("body").alias("part"), seq.alias("seq"), F.when(listed, "Normal").otherwise(O.style_of(kind)).alias("style"), F.when(kind == "BULLET_LIST", "bullet").when(kind == "NUMBERED_LIST", "number").otherwise("").alias("numbering"), shown.alias("text"))
    return outside.unionAll(broken).unionAll(body)


def extracted(paragraphs: DataFrame) -> DataFrame:
    """doc_id and text of rendered pages as a reader of the file gets them: the body, then header and footer, a line each."""
    place = F.when(F.col("part") == "header", 2).when(F.col("part") == "footer", 3).otherwise(1)
    parts = F.array_sort(F.collect_list(F.struct(place.alias("place"), "seq", "text")))
    return paragraphs.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def fragments(blocks: DataFrame) -> DataFrame:
    """doc_id, ord, f: what a rendered page must hold of each block - the items of lists without their mark, other texts whole."""
    lines = F.transform(F.filter(F.split("literal", LINE_END), lambda t: T.squeezed(t) != ""), lambda t: F.regexp_replace(t, CHECKED_MARK, ""))
    texts = F.when(F.col("block_type").isin(*LISTS), lines).otherwise(F.array("literal"))
    shown = blocks.where(~F.col("block_type").isin("FIGURE", "DECORATIVE_REGION"))
    return shown.select("doc_id", "ord", F.explode(texts).alias("f")).select("doc_id", "ord", T.squeezed(F.col("f")).alias("f")).where("f <> ''")


def judged_writes(batch: DataFrame, pages: DataFrame) -> DataFrame:
    """A batch of writes (doc_id, human_approved) with the code of each: 422 without a human's approval, 404 for an unknown page, else 201."""
    known = batch.join(pages.select("doc_id").distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    return known.withColumn("code", F.when(~F.coalesce("human_approved", F.lit(False)), 422).when(F.col("known").isNull(), 404).otherwise(201)).drop("known")


def with_added(blocks: DataFrame, accepted: DataFrame) -> DataFrame:
    """doc_id, ord, block_type, reading_order, literal, approved, confidence, unresolved, added: blocks and those that a reviewer adds, whose literal text is empty."""
    own = blocks.select("doc_id", "ord", "block_type", "reading_order", "literal", F.lit(None).cast("string").alias("approved"), "confidence", "unresolved", F.lit(False).alias("added"))
    new = accepted.select("doc_id", "ord", "block_type", F.col("reading_order").cast("long"), F.lit("").alias("literal"), F.col("text").alias("approved"), F.lit(1.0).alias("confidence"), F.lit(False).alias("unresolved"), F.lit(True).alias("added"))
    return own.unionAll(new)


def cancelled(jobs: DataFrame) -> DataFrame:
    """Jobs (state, cancel_requested) after a request to cancel: a job that has ended keeps its status."""
    return jobs.withColumn("cancel_requested", F.col("cancel_requested") & ~F.col("state").isin(*TERMINAL_STATES))


def manifest(pages: DataFrame, root: str) -> DataFrame:
    """page, category, source_image, and what a review fills in later, of a new ground truth."""
    image = F.concat(F.lit(f"{root}/page-"), F.lpad(F.col("page").cast("string"), 4, "0"), F.lit(".png"))
    return pages.select("page", "category", image.alias("source_image"), F.lit(False).alias("human_reviewed"), F.lit(None).cast("string").alias("reviewer"))


def approved(truth: DataFrame, reviews: DataFrame) -> DataFrame:
    """A ground truth with the pages that reviews (page, reviewer) approve; of several the least reviewer by name stands."""
    latest = reviews.groupBy("page").agg(F.min("reviewer").alias("by"))
    joined = truth.join(latest, "page", "left")
    return joined.withColumns({"human_reviewed": F.col("human_reviewed") | F.col("by").isNotNull(), "reviewer": F.coalesce("by", "reviewer")}).drop("by")


def compared(truth: DataFrame, pages: DataFrame) -> DataFrame:
    """page, outcome of each page of a ground truth (page, sha) beside the pages of a job (page, sha): ok, hash differs, or missing page."""
    theirs = pages.select("page", F.col("sha").alias("theirs"))
    return truth.join(theirs, "page", "left").select("page", F.when(F.col("theirs").isNull(), "missing page").when(F.col("theirs") != F.col("sha"), "hash differs").otherwise("ok").alias("outcome"))


def structured(bounds: DataFrame, instructions: DataFrame) -> DataFrame:
    """doc_id, ord, before_ln, after_ln, boundary, confidence: boundaries of instructed blocks, replaced.

    bounds: lines with before_ln, the line before them in their block; instructions: doc_id, ord, after_line, new_boundary,
    new_confidence - what follows a line. Pairs of lines that no instruction names have no boundary any more.
    """
    pairs = bounds.where("before_ln is not null").select("doc_id", "ord", "before_ln", F.col("ln").alias("after_ln"))
    told = instructions.select("doc_id", "ord", F.col("after_line").alias("before_ln"), F.col("new_boundary").alias("boundary"), F.col("new_confidence").alias("confidence"))
    return pairs.join(told, ["doc_id", "ord", "before_ln"])


def require_training_disabled(flag: bool) -> None:
    """Evaluation data never trains a model."""
    if flag:
        raise ValueError("training must stay disabled")


def audited(blocks: DataFrame, warnings: DataFrame) -> DataFrame:
    """doc_id, checks, issues: what a page's structure shows, and what a human must look at. warnings: doc_id and an array of a page's own."""
    has = lambda *kinds: F.bool_or(F.col("block_type").isin(*kinds))
    pages = blocks.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("unresolved").alias("open"), has("TABLE").alias("table"), has(*R.HEADINGS).alias("heading"), has("FIGURE", "EQUATION_IMAGE").alias("visual"))
    listed = lambda *parts: F.array_compact(F.array(*parts))
    checks = listed(
        F.format_string("%d canonical blocks", "n"),
        F.format_string("%d unresolved", "open"),
        F.lit("reading order serialized"),
        F.lit("one DOCX page mapped to one source page"),
        F.when(F.col("table"), "editable table structure present"),
        F.when(F.col("heading"), "semantic heading present"),
        F.when(F.col("visual"), "source visual crop present or queued"),
    )
    own = F.coalesce("warnings", F.expr("cast(array() as array<string>)"))
    issues = F.concat(own, listed(F.when(F.col("open") > 0, F.format_string("%d OCR block(s) still require human resolution", "open")), F.lit("visual fidelity and reading comfort require human approval")))
    return pages.join(warnings, "doc_id", "left").select("doc_id", F.array_join(checks, "; ").alias("checks"), F.array_join(issues, "; ").alias("issues"))
