"""Gates, verification policy, corrections, patches, queues: ordered rules as columns, latest-wins as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Types that are never verified as text, and headings.
NOT_TEXT = ["FIGURE", "DECORATIVE_REGION", "EQUATION_IMAGE"]
HEADINGS = ["DOCUMENT_TITLE", "CHAPTER_TITLE", "HEADING_1", "HEADING_2", "HEADING_3"]
MODES = ["mock", "local", "windows", "azure", "hybrid", "ai_verified", "maximum_accuracy", "unlimited"]
#: The benchmark's pages with what they are there for.
BENCHMARK_PAGES = [
    (4, "normal-text"), (7, "heading"), (12, "normal-text"), (18, "questions"), (25, "lists"), (31, "normal-text"), (36, "heading"), (42, "western-digits"),
    (48, "arabic-indic-digits"), (53, "mixed-arabic-english"), (60, "normal-text"), (67, "colored-box"), (74, "questions"), (81, "answer-choices"), (88, "one-column"),
    (95, "two-column"), (102, "lists"), (109, "heading"), (116, "mixed-arabic-english"), (123, "normal-text"), (130, "western-digits"), (137, "arabic-indic-digits"),
    (144, "colored-box"), (151, "questions"), (158, "answer-choices"), (165, "two-column"), (172, "table-candidate"), (184, "difficult"), (197, "difficult"), (209, "table-or-toc"),
]


def selected_pages(selection: Column, total: Column) -> Column:
    """Sorted page numbers of a selection: first5 or smoke, all, or a comma list; an error if any is no page."""
    chosen = F.lower(F.trim(selection))
    listed = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(chosen, ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p).try_cast("int"))))
    wrong = (F.size(listed) == 0) | F.exists(listed, lambda p: p.isNull() | (p < 1) | (p > total))
    return (
        F.when(chosen.isin("first5", "smoke"), F.sequence(F.lit(1), F.least(total, F.lit(5))))
        .when(chosen == "all", F.sequence(F.lit(1), total))
        .when(wrong, F.raise_error(F.concat(F.lit("pages must be within 1.."), total.cast("string"))).cast("array<int>"))
        .otherwise(listed)
    )


def consent(provider: Column, page: Column, opt_in: Column, providers: Column, pages: Column) -> Column:
    """Whether a page may go to a provider; no list of pages means all."""
    return F.coalesce(opt_in & F.array_contains(providers, provider) & (pages.isNull() | F.array_contains(pages, page)), F.lit(False))


def crop_consent(page: Column, full_page: Column, opt_in: Column, providers: Column, pages: Column, allow_full: Column) -> Column:
    return consent(F.lit("gemini"), page, opt_in, providers, pages) & (~full_page | allow_full)


def admission(mode: Column, device: Column, verification: Column, formatting: Column, visual_qa: Column, opt_in: Column, full_page: Column, pages: Column, confirmed: Column, has_azure: Column, has_gemini: Column) -> Column:
    """HTTP-like code of the first gate that refuses a job, 200 if none does."""
    azure = mode.isin("azure", "hybrid", "maximum_accuracy")
    gemini = mode.isin("ai_verified", "maximum_accuracy") | (verification != "off") | (formatting != "off") | visual_qa
    return (
        F.when(~mode.isin(*MODES), 422)
        .when(~device.isin("cpu", "gpu"), 422)
        .when((azure | gemini) & ~opt_in, 403)
        .when(azure & ~has_azure, 503)
        .when(gemini & ~has_gemini, 503)
        .when(((formatting != "off") | visual_qa) & ~full_page, 403)
        .when((pages > 5) & ~confirmed, 409)
        .otherwise(200)
    )


def verification_reasons(scope: str, kind: Column, text: Column, confidence: Column, unsure: Column, disagrees: Column, direction: Column, least: float = 0.85, english: bool = True, digits: bool = True, headings: bool = True) -> Column:
    """Sorted reasons to verify a block under a scope: off, uncertain, important or every."""
    none = F.expr("cast(array() as array<string>)")
    if scope == "off":
        return none
    skipped = kind.isin(*NOT_TEXT) | (F.trim(text) == "")
    if scope == "every":
        return F.when(skipped, none).otherwise(F.array(F.lit("every-text-block")))
    important = scope == "important"
    rules = [(confidence < least, "low-confidence"), (disagrees, "provider-disagreement"), (direction == "NEUTRAL", "uncertain-direction"), (unsure, "uncertain-boundary")]
    if important or english:
        rules.append((text.rlike("[A-Za-z]"), "English"))
    if important or digits:
        rules.append((text.rlike("[0-9٠-٩%٪]"), "digits-or-percentage"))
    if important or headings:
        rules.append((kind.isin(*HEADINGS), "heading"))
    if important:
        rules.append((kind.isin("QUESTION", "ANSWER_OPTION", "TABLE"), "important-structure"))
    return F.when(skipped, none).otherwise(F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))))


def trigger(confidence: Column, mine: Column, theirs: Column) -> Column:
    """Why a block goes to adjudication by default: disagreement first, then low confidence, else null."""
    return F.when(theirs.isNotNull() & (T.nfc(mine) != T.nfc(theirs)), "disagreement").when(confidence < 0.72, "low-confidence")


def automatic_correction(blocks: DataFrame, least: float = 0.95) -> DataFrame:
    """Adds changed, sufficient, protected, applied, approved and unresolved_after to blocks with a decision (selected, decision_confidence, decision_unresolved, visual)."""
    changed = F.coalesce(F.col("selected") != F.col("literal"), F.lit(False))
    sufficient = ~F.col("decision_unresolved") & F.col("selected").isNotNull() & (F.col("decision_confidence") >= least)
    # An empty selection counts as none here.
    protected = T.protected_reasons(F.when(F.coalesce(F.col("selected"), F.lit("")) != "", F.col("selected")).otherwise(F.col("literal")), F.col("block_type"))
    out = blocks.withColumns({"changed": changed, "sufficient": sufficient, "protected": protected})
    applied = F.col("visual") & F.col("changed") & F.col("sufficient") & (F.size("protected") == 0)
    after = F.when(applied, False).when(F.col("visual"), ~F.col("sufficient") | (F.size("protected") > 0)).otherwise(F.col("decision_unresolved") | F.col("changed"))
    return out.withColumn("applied", applied).withColumn("approved", F.when(F.col("applied"), F.col("selected"))).withColumn("unresolved_after", after)


def corrections(blocks: DataFrame) -> DataFrame:
    """Blocks whose approved text differs from the literal one, with who approved. human and automatic are structs of reason and confidence, or null."""
    approval = F.coalesce(F.col("human"), F.col("automatic"))
    return blocks.where("approved is not null and approved <> literal").select(
        "doc_id",
        "ord",
        "literal",
        F.col("approved").alias("corrected"),
        F.coalesce(approval["reason"], F.lit("Approved correction")).alias("reason"),
        F.coalesce(approval["confidence"], F.lit(1.0)).alias("confidence"),
        (F.col("automatic").isNotNull() & F.col("human").isNull()).alias("automatic"),
    )


def patched(blocks: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Blocks under an append-only log of patches (doc_id, ord, seq and fields): of each field the latest value that is not null. A patched block is resolved; its literal text never changes."""
    latest = patches.groupBy("doc_id", "ord").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"new_{f}") for f in fields], F.count("*").alias("patches"))
    joined = blocks.join(latest, ["doc_id", "ord"], "left")
    changed = {f: F.coalesce(f"new_{f}", f) for f in fields if f != "literal"}
    return joined.withColumns(changed | {"unresolved": F.col("unresolved") & F.col("patches").isNull(), "patches": F.coalesce("patches", F.lit(0))}).drop(*[f"new_{f}" for f in fields])


def latest_status(events: DataFrame, key: str, at: list[str], value: str) -> DataFrame:
    """The last value of each key in an event log: an aggregate, so that a key with many events is merged map-side."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*at)).alias(value), F.count("*").alias("events"))


def review_queue(pages: DataFrame) -> DataFrame:
    """Blocks to one row a page: low_confidence, english, has_table."""
    return pages.groupBy("doc_id").agg(
        F.bool_or(F.col("unresolved") | (F.col("confidence") < 0.7)).alias("low_confidence"),
        F.bool_or(F.col("literal").rlike(T.ENGLISH_PAGE)).alias("english"),
        F.bool_or(F.col("block_type") == "TABLE").alias("has_table"),
    )
