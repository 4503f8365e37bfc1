"""Jobs: what admits them, what is left of them, how they went, and what they leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import review as R

Gate = tuple[Column, int, str]


def outcome(gates: list[Gate]) -> Column:
    """code and reason of the first gate that refuses; 200 and null if none does. A gate that cannot tell (null) lets pass."""
    found = lambda code, reason: F.struct(F.lit(code).alias("code"), F.lit(reason).cast("string").alias("reason"))
    answer = F.when(gates[0][0], found(*gates[0][1:]))
    for refused, code, reason in gates[1:]:
        answer = answer.when(refused, found(code, reason))
    return answer.otherwise(found(200, None))


def admission_gates(azure_ready: bool, gemini_ready: bool, verification: bool, formatting: bool, visual_qa: bool, gated: str, max_bytes: int) -> list[Gate]:
    """The gates of a request in the order in which they are asked.

    Requests: mode, device, ai_verification, ai_formatting, ai_visual_qa, opt_in, full_page, size, signature, pages (null where the
    file cannot be read), confirmed. gated: why the gated model refuses.
    """
    mode, size, pages = F.col("mode"), F.col("size"), F.col("pages")
    verifies, formats, looks = F.col("ai_verification") != "off", F.col("ai_formatting") != "off", F.col("ai_visual_qa")
    azure = mode.isin("azure", "hybrid", "maximum_accuracy")
    gemini = mode.isin("ai_verified", "maximum_accuracy") | verifies | formats | looks
    return [
        (~mode.isin(*R.MODES), 422, "unknown mode"),
        (~F.col("device").isin("cpu", "gpu"), 422, "unknown device"),
        ((azure | gemini) & ~F.col("opt_in"), 403, "cloud needs consent"),
        (azure & F.lit(not azure_ready), 503, "azure is not configured"),
        (gemini & F.lit(not gemini_ready), 503, "gemini is not configured"),
        (verifies & F.lit(not verification), 403, "verification is disabled"),
        (formats & F.lit(not formatting), 403, "formatting is disabled"),
        (looks & F.lit(not visual_qa), 403, "visual checks are disabled"),
        ((formats | looks) & ~F.col("full_page"), 403, "full pages need consent of their own"),
        (mode == "unlimited", 503, gated),
        (size > max_bytes, 413, "too large"),
        ((size < 5) | (F.col("signature") != "%PDF-"), 422, "no PDF"),
        (pages.isNull(), 422, "the PDF cannot be read"),
        ((pages > 5) & ~F.col("confirmed"), 409, "more than five pages need a confirmation"),
    ]


def approval_gates() -> list[Gate]:
    """Gates of the approval of a page (training, classification, truth_sha, sha, unapproved; sha and unapproved are null for a page that the job lacks)."""
    return [
        (F.col("training") | (F.col("classification") != "EVALUATION_ONLY"), 409, "not for evaluation only"),
        (F.col("sha").isNull() | F.col("unapproved").isNull(), 404, "missing page"),
        (F.col("sha") != F.col("truth_sha"), 409, "hash differs"),
        (F.col("unapproved") > 0, 409, "blocks without approval"),
    ]


def benchmark_admission(documents: DataFrame, pages: DataFrame, required: DataFrame) -> DataFrame:
    """doc, code, reason, missing: whether a benchmark may be made of a document - one for evaluation only that has all required pages.

    documents: doc, classification; pages: doc, page; required: page, a short list. missing: how many of them a document lacks.
    """
    wanted = required.select("page").distinct()
    n = wanted.count()
    had = pages.select("doc", "page").distinct().join(F.broadcast(wanted), "page", "left_semi").groupBy("doc").agg(F.count("*").alias("had"))
    counted = documents.join(had, "doc", "left").withColumn("missing", F.lit(n).cast("long") - F.coalesce("had", F.lit(0)))
    gates = [(F.col("classification") != "EVALUATION_ONLY", 409, "not for evaluation only"), (F.col("missing") > 0, 409, "pages are missing")]
    return counted.withColumn("o", outcome(gates)).select("doc", "o.code", "o.reason", "missing")


def queued(queue: DataFrame, pages: DataFrame) -> DataFrame:
    """A review queue (doc_id and reasons as booleans) with the failed pages (doc_id, failed), which have no blocks to be queued for."""
    reasons = [c for c in queue.columns if c != "doc_id"]
    failed = pages.where("failed").select("doc_id").distinct().withColumn("failed", F.lit(True))
    no = F.lit(False)
    joined = queue.join(failed, "doc_id", "full").select("doc_id", *[F.coalesce(c, no).alias(c) for c in reasons], F.coalesce("failed", no).alias("failed"))
    return joined.where(F.greatest("failed", *reasons))


def to_resume(requested: DataFrame, done: DataFrame, sources: DataFrame) -> DataFrame:
    """job, page, action of the pages asked for: process, skip (a checkpoint has it), or refuse, where the job's source has changed.

    requested: job, page; done: job, page; sources: job, sha_before, sha_now. A job without a known source is refused.
    """
    had = done.select("job", "page").distinct().withColumn("done", F.lit(True))
    same = sources.select("job", (F.col("sha_before") == F.col("sha_now")).alias("same"))
    joined = requested.select("job", "page").distinct().join(same, "job", "left").join(had, ["job", "page"], "left")
    action = F.when(~F.coalesce("same", F.lit(False)), "refuse").when(F.col("done"), "skip").otherwise("process")
    return joined.select("job", "page", action.alias("action"))


def rolled_up(pages: DataFrame) -> DataFrame:
    """job, accounted, failed (sorted page numbers), warnings, api_calls, cost, elapsed_seconds. pages: job, page, failed, warnings, api_calls, cost, at.

    A page without a cost counts as free. The list of failed pages is that of one job.
    """
    micros = F.unix_micros(F.max("at").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))
    return pages.groupBy("job").agg(
        F.count_distinct("page").alias("accounted"),
        F.sort_array(F.collect_set(F.when(F.col("failed"), F.col("page")))).alias("failed"),
        F.sum("warnings").alias("warnings"),
        F.sum("api_calls").alias("api_calls"),
        F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"),
        F.bround(micros / 1000000.0, 1).alias("elapsed_seconds"),
    )


def summary(jobs: DataFrame) -> DataFrame:
    """job and the summary of each rolled-up job in Markdown."""
    failed = F.when(F.size("failed") > 0, F.array_join(F.col("failed").cast("array<string>"), ", ")).otherwise("none")
    parts = [F.lit("# Run"), F.format_string("- Pages accounted for: %d", "accounted"), F.concat(F.lit("- Failed pages: "), failed), F.format_string("- Warnings: %d", "warnings"), F.concat(F.lit("- Elapsed: "), F.format_string("%.1f", "elapsed_seconds"), F.lit(" s"))]
    return jobs.select("job", F.concat_ws("\n", *parts).alias("markdown"))


def issues(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord, kind, confidence: unresolved blocks, and failed pages (doc_id, error) with their error as kind and no block."""
    open_blocks = blocks.where("unresolved").select("doc_id", "ord", F.col("block_type").alias("kind"), "confidence")
    failed = pages.where("error is not null").select("doc_id", F.lit(None).cast("long").alias("ord"), F.col("error").alias("kind"), F.lit(None).cast("double").alias("confidence"))
    return open_blocks.unionByName(failed)


def unresolved_by(blocks: DataFrame, *keys: str) -> DataFrame:
    """Blocks and unresolved ones by keys, with totals: a row whose key is 'total' sums over it."""
    rolled = blocks.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("unresolved").alias("open"))
    shown = [F.when(F.grouping(k) == 1, "total").otherwise(F.col(k)).alias(k) for k in keys]
    # The roll-up expands the counts of the groups, not the blocks.
    return rolled.rollup(*keys).agg(*[s.alias(f"{k}_") for s, k in zip(shown, keys, strict=True)], F.sum("n").alias("blocks"), F.sum("open").alias("unresolved")).select(*[F.col(f"{k}_").alias(k) for k in keys], "blocks", "unresolved")


def bootstrap(pages: DataFrame, key: str, value: str, rounds: int = 200) -> DataFrame:
    """pages, mean, low, high: the mean of a value over pages and its 95 % percentile interval over `rounds` resamplings.

    Each page has a weight a round, Poisson with mean 1, told from a hash of key and round: no page moves, no order matters, and
    what leaves a task is one sum a round. Integers sum exactly. Pages without a value do not count; no pages, no interval.
    """
    held = pages.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    drawn = held.select("k", "v", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("b"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("k").cast("string"), F.col("b").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0
    # Round 0 takes every page once: it is the sample itself.
    weight = F.when(F.col("b") == 0, 1).otherwise(sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0)))
    means = drawn.select("b", "v", weight.alias("w")).groupBy("b").agg(F.sum("w").alias("n"), (F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    own, other = F.col("b") == 0, F.when(F.col("b") > 0, F.col("m"))
    ends = [F.round(F.percentile(other, F.lit(q)), 6).alias(n) for n, q in (("low", 0.025), ("high", 0.975))]
    return means.agg(F.coalesce(F.max(F.when(own, F.col("n"))), F.lit(0)).cast("long").alias("pages"), F.round(F.max(F.when(own, F.col("m"))), 6).alias("mean"), *ends)


#: The distribution function of a Poisson variable with mean 1, at 0 to 7.
POISSON = [0.36787944, 0.73575888, 0.9196986, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]


def reversed_tokens(a: Column, b: Column) -> Column:
    """Whether one text has exactly the other's tokens in reverse, and is not the same."""
    return (a != b) & (F.reverse(F.split(a, " ")) == F.split(b, " "))


def compacted(payload: Column, fields: list[str]) -> Column:
    """JSON of those fields of a JSON object that are there and not null, in the order of `fields`; null for what is no JSON object."""
    read = F.try_parse_json(payload)
    kept = []
    for name in fields:
        value = F.try_variant_get(read, f"$.{name}", "variant")
        kept.append(F.when(~F.is_variant_null(value), value).alias(name))
    return F.when(F.schema_of_variant(read).startswith("OBJECT"), F.to_json(F.struct(*kept)))


#: What an export leaves behind, by name.
OUTPUTS = {
    "literal_docx": "output/literal.docx",
    "polished_docx": "output/polished.docx",
    "correction_json": "output/correction_report.json",
    "correction_html": "output/correction_report.html",
    "review_report": "output/review_report.html",
}


def exported(documents: DataFrame) -> DataFrame:
    """doc_id, outputs (name to path), available, error: an export whose PDF failed (pdf_error) leaves all else and says why."""
    fixed = F.create_map(*[F.lit(x) for kv in OUTPUTS.items() for x in kv])
    pdf = F.create_map(F.lit("rendered_pdf"), F.lit("output/rendered.pdf"))
    good = F.col("pdf_error").isNull()
    return documents.select("doc_id", F.when(good, F.map_concat(fixed, pdf)).otherwise(fixed).alias("outputs"), good.alias("available"), F.col("pdf_error").alias("error"))


#: What is counted in the XML of a rendered document.
MARKS = {"section_breaks": 'w:type="nextPage"', "bidi_paragraphs": "<w:bidi", "rtl_runs": "<w:rtl", "tables": "<w:tbl>"}


def xml_counters(documents: DataFrame) -> DataFrame:
    """doc_id, a count for each of MARKS, text_length, passed. documents: doc_id, xml, text, missing (fragments that the text lacks, an array)."""
    occurrences = lambda mark: F.expr("(length(xml) - length(replace(xml, '{0}', ''))) div length('{0}')".format(mark))
    return documents.select("doc_id", *[occurrences(mark).alias(name) for name, mark in MARKS.items()], F.length("text").cast("long").alias("text_length"), (F.size("missing") == 0).alias("passed"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cost of a call by prices a million tokens; null without a price."""
    return (tokens_in * price_in + tokens_out * price_out) / 1000000.0


def page_cost(pages: Column, price: Column) -> Column:
    """Cost of pages by a price for a thousand; null without a price."""
    return pages * price / 1000.0
