"""Queries over evidence: reconciliation, gates, corrections, queues, jobs, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import documents as D
from quire.operators import layout as L
from quire.operators import matching as M
from quire.operators import report as O
from quire.operators import review as R
from quire.plans.layout_queries import all_blocks
from quire.plans.registry import query
from quire.sources import derived as S
from quire.sources.storage import stored

_STYLE_SQL = "CASE block_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.STYLES.items()) + " ELSE 'Normal' END"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = stored(all_blocks(spark, sf_dir))
    return found, L.hypothesis(found)


def _with_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks beside the verifier's block that the greedy match gives them."""
    found, hyp = _both(spark, sf_dir)
    matches = M.primary_to_verifier(found, hyp).select("doc_id", "ord", "verifier_ord")
    theirs = matches.join(hyp.select("doc_id", F.col("ord").alias("verifier_ord"), F.col("literal").alias("theirs")), ["doc_id", "verifier_ord"])
    return found.join(theirs.select("doc_id", "ord", "theirs"), ["doc_id", "ord"], "left")


#: The greedy match in SQL, for these pages: a verifier block is nearest to the block of its own number, and a region whose own one
#: is missing takes that of the small region inside it, which comes later, where they are alike enough.
_GREEDY_SQL = f"""WITH {S.BLOCKS_SQL}, near AS (SELECT b.doc_id, b.ord, h.ord AS verifier_ord, b.width * b.height + h.width * h.height AS areas, CASE WHEN b.block_type = h.block_type THEN 0.05E0 ELSE 0.0E0 END AS same,
  greatest(0, least(b.x + b.width, h.x + h.width) - greatest(b.x, h.x)) * greatest(0, least(b.y + b.height, h.y + h.height) - greatest(b.y, h.y)) AS common
  FROM blocks b JOIN hyp h ON b.doc_id = h.doc_id AND (b.ord = h.ord OR (b.ord < 500000 AND b.ord % 2 = 0 AND h.ord = b.ord + 1))),
scored AS (SELECT doc_id, ord, verifier_ord, common / nullif(areas - common, 0) + same AS score FROM near),
taken AS (SELECT * FROM scored s WHERE verifier_ord <> ord AND score >= 0.2E0 AND NOT EXISTS (SELECT 1 FROM scored o WHERE o.doc_id = s.doc_id AND o.ord = s.ord AND o.verifier_ord = s.ord)),
matched AS (SELECT * FROM taken UNION ALL SELECT * FROM scored s WHERE verifier_ord = ord AND score >= 0.2E0 AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc_id = s.doc_id AND t.verifier_ord = s.ord))"""


@query(f"{_GREEDY_SQL} SELECT doc_id, ord, verifier_ord, round(score, 6) AS score FROM matched")
def provider_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, hyp = _both(spark, sf_dir)
    return M.primary_to_verifier(found, hyp).withColumn("score", F.round("score", 6))


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, count(*) AS verifier_only FROM hyp WHERE ord >= 2000000 GROUP BY doc_id")
def verifier_only_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, hyp = _both(spark, sf_dir)
    return M.verifier_only(hyp, M.primary_to_verifier(found, hyp)).groupBy("doc_id").agg(F.count("*").alias("verifier_only"))


_PAIR_SQL = f"{_GREEDY_SQL}, pair AS (SELECT b.*, h.literal AS theirs FROM blocks b LEFT JOIN matched m ON b.doc_id = m.doc_id AND b.ord = m.ord LEFT JOIN hyp h ON h.doc_id = m.doc_id AND h.ord = m.verifier_ord)"


@query(f"{_PAIR_SQL} SELECT doc_id, ord, CASE WHEN theirs IS NOT NULL AND nfc_normalize(literal) <> nfc_normalize(theirs) THEN 'disagreement' ELSE 'low-confidence' END AS reason FROM pair WHERE (theirs IS NOT NULL AND nfc_normalize(literal) <> nfc_normalize(theirs)) OR confidence < 0.72E0")
def disagreement_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_verifier(spark, sf_dir).withColumn("reason", R.trigger(F.col("confidence"), F.col("literal"), F.col("theirs")))
    return rows.where("reason is not null").select("doc_id", "ord", "reason")


def _reasons_sql(important: bool) -> str:
    rules = [
        ("confidence < 0.85E0", "low-confidence"),
        (r"theirs IS NOT NULL AND trim(regexp_replace(literal, '\s+', ' ', 'g')) <> trim(regexp_replace(theirs, '\s+', ' ', 'g'))", "provider-disagreement"),
        ("unsure", "uncertain-boundary"),
        ("regexp_matches(literal, '[A-Za-z]')", "English"),
        ("regexp_matches(literal, '[0-9٠-٩%٪]')", "digits-or-percentage"),
        ("block_type IN ('DOCUMENT_TITLE', 'CHAPTER_TITLE', 'HEADING_1', 'HEADING_2', 'HEADING_3')", "heading"),
    ]
    if important:
        rules.append(("block_type IN ('QUESTION', 'ANSWER_OPTION', 'TABLE')", "important-structure"))
    listed = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules)
    return f"{_PAIR_SQL} SELECT doc_id, ord, array_to_string(list_sort(list_filter([{listed}], lambda r: r IS NOT NULL)), ',') AS reasons FROM pair WHERE block_type NOT IN ('FIGURE', 'DECORATIVE_REGION', 'EQUATION_IMAGE') AND trim(literal) <> ''"


def _reasons(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    disagrees = F.col("theirs").isNotNull() & (T.squeezed(F.col("literal")) != T.squeezed(F.col("theirs")))
    reasons = R.verification_reasons(scope, F.col("block_type"), F.col("literal"), F.col("confidence"), F.col("unsure"), disagrees, F.lit("RTL"))
    rows = _with_verifier(spark, sf_dir).where(~F.col("block_type").isin(*R.NOT_TEXT) & (F.trim("literal") != ""))
    return rows.select("doc_id", "ord", F.array_join(reasons, ",").alias("reasons"))


@query(_reasons_sql(False))
def verification_reasons_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir, "uncertain")


@query(_reasons_sql(True))
def verification_reasons_important(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir, "important")


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, ord, 'every-text-block' AS reasons FROM blocks WHERE block_type NOT IN ('FIGURE', 'DECORATIVE_REGION', 'EQUATION_IMAGE') AND trim(literal) <> ''")
def verification_reasons_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir, "every")


def _protected_sql(text: str) -> str:
    return f"""array_to_string(list_sort(list_filter([CASE WHEN regexp_matches({text}, '[A-Za-z]') THEN 'English terms' END, CASE WHEN regexp_matches({text}, '[0-9٠-٩]') THEN 'numbers or dates' END,
 CASE WHEN regexp_matches({text}, '%|٪') THEN 'percentages' END, CASE WHEN regexp_matches({text}, '(?i)(?:m/s|km|kg|mg|cm|mm|°C|Hz|Pa)(?:[^\\p{{L}}\\p{{N}}_]|$)') THEN 'units or scientific terminology' END,
 CASE WHEN block_type IN ('QUESTION', 'ANSWER_OPTION') THEN 'question numbers or answer choices' END, CASE WHEN block_type = 'EQUATION_IMAGE' THEN 'equations' END], lambda r: r IS NOT NULL)), ',')"""


@query(f"WITH {S.BLOCKS_SQL} SELECT doc_id, ord, {_protected_sql('literal')} AS reasons FROM blocks")
def protected_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_blocks(spark, sf_dir).select("doc_id", "ord", F.array_join(T.protected_reasons(F.col("literal"), F.col("block_type")), ",").alias("reasons"))


#: Decisions as an input table: by arithmetic, with texts that hold no protected content for some.
_DECISION_SQL = f"""WITH {S.BLOCKS_SQL}, dec AS (SELECT *, CASE WHEN (doc_id + ord) % 3 = 0 THEN NULL WHEN (doc_id + ord) % 3 = 1 THEN literal ELSE '«—»' END AS selected,
  CASE WHEN ord % 4 = 0 THEN 0.9E0 ELSE 0.97E0 END AS dconf, (doc_id + ord) % 5 = 0 AS dunres, doc_id % 2 = 0 AS visual FROM blocks),
judged AS (SELECT *, coalesce(selected <> literal, FALSE) AS changed, NOT dunres AND selected IS NOT NULL AND dconf >= 0.95E0 AS sufficient, {_protected_sql("coalesce(nullif(selected, ''), literal)")} AS protected FROM dec)"""


@query(f"""{_DECISION_SQL} SELECT doc_id, ord, changed, visual AND changed AND sufficient AND protected = '' AS applied,
 CASE WHEN visual AND changed AND sufficient AND protected = '' THEN FALSE WHEN visual THEN NOT sufficient OR protected <> '' ELSE dunres OR changed END AS unresolved_after FROM judged""")
def auto_correction_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("doc_id", "ord", "changed", "applied", "unresolved_after")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("doc_id") + F.col("ord")
    rows = all_blocks(spark, sf_dir).withColumns(
        {
            "selected": F.when(s % 3 == 1, F.col("literal")).when(s % 3 == 2, "«—»"),
            "decision_confidence": F.when(F.col("ord") % 4 == 0, 0.9).otherwise(0.97),
            "decision_unresolved": s % 5 == 0,
            "visual": F.col("doc_id") % 2 == 0,
        }
    )
    return R.automatic_correction(rows)


@query(f"""{_DECISION_SQL}, a AS (SELECT *, CASE WHEN visual AND changed AND sufficient AND protected = '' THEN selected END AS approved FROM judged)
SELECT doc_id, ord, md5(literal) AS literal_md5, md5(coalesce(approved, nfc_normalize(literal))) AS polished_md5, approved IS NOT NULL AS corrected FROM a""")
def polished_vs_literal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("doc_id", "ord", F.md5(F.col("literal").cast("binary")).alias("literal_md5"), F.md5(F.coalesce("approved", T.nfc(F.col("literal"))).cast("binary")).alias("polished_md5"), F.col("approved").isNotNull().alias("corrected"))


@query(f"""{_DECISION_SQL}, a AS (SELECT *, CASE WHEN visual AND changed AND sufficient AND protected = '' THEN selected WHEN (doc_id + ord) % 17 = 0 THEN literal || '.' END AS approved, visual AND changed AND sufficient AND protected = '' AS auto, (doc_id + ord) % 17 = 0 AS human FROM judged)
SELECT doc_id, ord, md5(approved) AS corrected_md5, CASE WHEN human THEN 'Human review' WHEN auto THEN 'Visual verification' ELSE 'Approved correction' END AS reason, CASE WHEN human THEN 1.0E0 WHEN auto THEN dconf ELSE 1.0E0 END AS confidence, auto AND NOT human AS automatic FROM a WHERE approved IS NOT NULL AND approved <> literal""")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = (F.col("doc_id") + F.col("ord")) % 17 == 0
    evidence = lambda reason, c: F.struct(F.lit(reason).alias("reason"), c.alias("confidence"))
    rows = decisions(spark, sf_dir)
    rows = rows.withColumns(
        {
            "approved": F.coalesce("approved", F.when(human, F.concat("literal", F.lit(".")))),
            "human": F.when(human, evidence("Human review", F.lit(1.0))),
            "automatic": F.when(F.col("applied"), evidence("Visual verification", F.col("decision_confidence"))),
        }
    )
    return R.corrections(rows).select("doc_id", "ord", F.md5(F.col("corrected").cast("binary")).alias("corrected_md5"), "reason", "confidence", "automatic")


@query(f"""WITH {S.BLOCKS_SQL}, page AS (SELECT doc_id, bool_or(unresolved OR confidence < 0.7E0) AS low_confidence, bool_or(regexp_matches(literal, '[A-z]')) AS english, bool_or(block_type = 'TABLE') AS has_table FROM blocks GROUP BY doc_id)
SELECT * FROM page WHERE low_confidence OR english OR has_table""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.review_queue(all_blocks(spark, sf_dir)).where("low_confidence or english or has_table")


@query("SELECT doc_id, (doc_id * 7919) % 104729 AS place FROM documents ORDER BY 2, 1 LIMIT 20")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty pages in a fixed pseudo-random order. The limit is the feature."""
    return S.table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * 7919) % 104729).alias("place")).orderBy("place", "doc_id").limit(20)


_PATCH_SQL = f"""WITH {S.BLOCKS_SQL}, patch AS (SELECT event_id, event_id % (SELECT count(DISTINCT doc_id) FROM documents) AS doc_id, (event_id % 7) * 2 AS ord, CASE WHEN event_type = 'error' THEN NULL ELSE 'patch ' || event_id END AS approved, CASE WHEN event_type = 'click' THEN 'HEADING_2' END AS block_type FROM events),
latest AS (SELECT doc_id, ord, max_by(approved, event_id) FILTER (approved IS NOT NULL) AS approved, max_by(block_type, event_id) FILTER (block_type IS NOT NULL) AS new_type, count(*) AS patches FROM patch GROUP BY doc_id, ord)"""


@query(f"{_PATCH_SQL} SELECT b.doc_id, b.ord, coalesce(l.new_type, b.block_type) AS block_type, l.approved, b.unresolved AND l.patches IS NULL AS unresolved, coalesce(l.patches, 0) AS patches, md5(b.literal) AS literal_md5 FROM blocks b LEFT JOIN latest l ON b.doc_id = l.doc_id AND b.ord = l.ord")
def block_patches_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.table(spark, sf_dir, "documents").select(F.count_distinct("doc_id").alias("n"))
    events = S.table(spark, sf_dir, "events").withColumn("n", n.scalar())
    patches = events.select((F.col("event_id") % F.col("n")).alias("doc_id"), ((F.col("event_id") % 7) * 2).alias("ord"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "error", F.concat(F.lit("patch "), F.col("event_id").cast("string"))).alias("approved"), F.when(F.col("event_type") == "click", "HEADING_2").alias("block_type"))
    base = all_blocks(spark, sf_dir).withColumn("approved", F.lit(None).cast("string"))
    return R.patched(base, patches, ["approved", "block_type"]).select("doc_id", "ord", "block_type", "approved", "unresolved", "patches", F.md5(F.col("literal").cast("binary")).alias("literal_md5"))


@query("""SELECT user_id AS job, max_by(CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY user_id""")
def job_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state of each job in an event log."""
    state = F.when(F.col("event_type") == "signup", "QUEUED").when(F.col("event_type").isin("view", "click"), "RUNNING").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("FAILED")
    events = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "ts", "event_id", state.alias("state"))
    return R.latest_status(events, "job", ["ts", "event_id"], "state")


@query("""SELECT user_id AS job, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS processed,
 CAST(floor(least(99, greatest(4, 100.0E0 * sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*))) + 0.5) AS BIGINT) AS percent FROM events GROUP BY user_id""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count_if(F.col("event_type") == "purchase")
    share = F.least(F.lit(99.0), F.greatest(F.lit(4.0), 100.0 * done / F.count("*")))
    return S.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job")).agg(F.count_if(F.col("event_type") == "error").alias("failed"), done.alias("processed"), F.floor(share + 0.5).alias("percent"))


@query("""SELECT DISTINCT user_id AS job, event_id % 50 AS page FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = e.user_id AND d.event_id % 50 = e.event_id % 50 AND d.event_type = 'purchase')""")
def retry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed pages of a job that no later attempt completed."""
    pages = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), (F.col("event_id") % 50).alias("page"), "event_type")
    return pages.where("event_type = 'error'").select("job", "page").distinct().join(pages.where("event_type = 'purchase'").select("job", "page").distinct(), ["job", "page"], "left_anti")


@query("""SELECT s.selection, CAST(s.page AS INTEGER) AS page FROM (VALUES ('first5', 1), ('first5', 2), ('first5', 3), ('all', 1), ('all', 2), ('all', 3), ('3, 1,1', 1), ('3, 1,1', 3), (' SMOKE ', 1), (' SMOKE ', 2), (' SMOKE ', 3)) s(selection, page)""")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("first5",), ("all",), ("3, 1,1",), (" SMOKE ",)], "selection string")
    return rows.select("selection", F.explode(R.selected_pages(F.col("selection"), F.lit(3))).alias("page"))


@query("""SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 < 3) AS azure, doc_id % 2 = 0 AND (doc_id % 5 = 0 OR doc_id % 7 < 3) AND (doc_id % 4 <> 0 OR doc_id % 6 = 0) AS gemini_crop FROM documents""")
def consent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consent of pages by arithmetic: opt-in for even ids, azure but for multiples of three, all pages for multiples of five, else pages 0 to 2."""
    d = F.col("doc_id")
    providers = F.when(d % 3 != 0, F.array(F.lit("azure"), F.lit("gemini"))).otherwise(F.array(F.lit("gemini")))
    pages = F.when(d % 5 != 0, F.array(*map(F.lit, range(3))))
    page = (d % 7).cast("int")
    return S.table(spark, sf_dir, "documents").select("doc_id", R.consent(F.lit("azure"), page, d % 2 == 0, providers, pages).alias("azure"), R.crop_consent(page, d % 4 == 0, d % 2 == 0, providers, pages, d % 6 == 0).alias("gemini_crop"))


_ADMISSION_SQL = """WITH j AS (SELECT doc_id, ['local','azure','ai_verified','mock','hybrid','nonsense'][CAST(doc_id % 6 + 1 AS INTEGER)] AS mode, CASE WHEN doc_id % 29 = 0 THEN 'tpu' ELSE 'cpu' END AS device,
 CASE WHEN doc_id % 4 = 0 THEN 'important' ELSE 'off' END AS ver, CASE WHEN doc_id % 9 = 0 THEN 'structural' ELSE 'off' END AS fmt, doc_id % 31 = 0 AS qa, doc_id % 2 = 0 AS opt, doc_id % 5 = 0 AS fullp, doc_id % 11 AS pages, doc_id % 3 = 0 AS confirmed, doc_id % 8 <> 0 AS has_a, doc_id % 13 <> 0 AS has_g FROM documents)
SELECT doc_id, CAST(CASE WHEN mode = 'nonsense' THEN 422 WHEN device = 'tpu' THEN 422
 WHEN (mode IN ('azure','hybrid','maximum_accuracy') OR mode IN ('ai_verified','maximum_accuracy') OR ver <> 'off' OR fmt <> 'off' OR qa) AND NOT opt THEN 403
 WHEN mode IN ('azure','hybrid','maximum_accuracy') AND NOT has_a THEN 503
 WHEN (mode IN ('ai_verified','maximum_accuracy') OR ver <> 'off' OR fmt <> 'off' OR qa) AND NOT has_g THEN 503
 WHEN (fmt <> 'off' OR qa) AND NOT fullp THEN 403 WHEN pages > 5 AND NOT confirmed THEN 409 ELSE 200 END AS INTEGER) AS code FROM j"""


@query(_ADMISSION_SQL)
def job_admission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    mode = F.element_at(F.array(*map(F.lit, ["local", "azure", "ai_verified", "mock", "hybrid", "nonsense"])), (d % 6 + 1).cast("int"))
    off = lambda c, on: F.when(c, on).otherwise("off")
    code = R.admission(mode, F.when(d % 29 == 0, "tpu").otherwise("cpu"), off(d % 4 == 0, "important"), off(d % 9 == 0, "structural"), d % 31 == 0, d % 2 == 0, d % 5 == 0, d % 11, d % 3 == 0, d % 8 != 0, d % 13 != 0)
    return S.table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))


@query(f"""WITH {S.BLOCKS_SQL}, u AS (SELECT doc_id, count(*) AS blocks, CAST(sum(CASE WHEN block_type NOT IN ('FIGURE', 'DECORATIVE_REGION') AND (doc_id + ord) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unapproved FROM blocks GROUP BY doc_id)
SELECT u.doc_id, u.blocks, u.unapproved, u.unapproved = 0 AND coalesce(l.quality, 0) = 1 AS approvable FROM u LEFT JOIN labels l ON u.doc_id = l.doc_id""")
def page_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose every text block a human has approved (here: all but a third, by arithmetic)."""
    open_block = ~F.col("block_type").isin("FIGURE", "DECORATIVE_REGION") & ((F.col("doc_id") + F.col("ord")) % 3 == 0)
    pages = all_blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(open_block).alias("unapproved"))
    labels = S.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return pages.join(labels, "doc_id", "left").select("doc_id", "blocks", "unapproved", ((F.col("unapproved") == 0) & (F.coalesce("quality", F.lit(0)) == 1)).alias("approvable"))


@query("SELECT count(*) AS pages, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS reviewed, bool_and(quality = 1) AS ready FROM labels")
def ground_truth_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "labels").agg(F.count("*").alias("pages"), F.count_if(F.col("quality") == 1).alias("reviewed"), F.bool_and(F.col("quality") == 1).alias("ready"))


@query("SELECT CAST(p.page AS INTEGER) AS page, p.category FROM (VALUES " + ", ".join(f"({n}, '{c}')" for n, c in R.BENCHMARK_PAGES) + ") p(page, category) WHERE p.page NOT IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)")
def missing_benchmark_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame(R.BENCHMARK_PAGES, "page int, category string")
    return pages.join(S.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("page")), "page", "left_anti")


@query(f"""WITH {S.BLOCKS_SQL}, frag AS (SELECT doc_id, ord, unnest(CASE WHEN block_type IN ('BULLET_LIST', 'NUMBERED_LIST') THEN list_transform(regexp_split_to_array(literal, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^\\s*(?:[•◦▪‣\\-–—]|[0-9٠-٩]+[.)-])\\s*', '')) ELSE [literal] END) AS f FROM blocks WHERE block_type NOT IN ('FIGURE', 'DECORATIVE_REGION')),
page AS (SELECT doc_id, trim(regexp_replace(string_agg(literal, chr(10) ORDER BY reading_order), '\\s+', ' ', 'g')) AS t FROM hyp GROUP BY doc_id),
c AS (SELECT doc_id, ord, trim(regexp_replace(f, '\\s+', ' ', 'g')) AS f FROM frag)
SELECT c.doc_id, c.ord, count(*) AS missing FROM c LEFT JOIN page p ON c.doc_id = p.doc_id WHERE c.f <> '' AND NOT contains(coalesce(p.t, ''), c.f) GROUP BY c.doc_id, c.ord""")
def docx_fragment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of blocks that the rendered page (here: the hypothesis) does not hold."""
    found, hyp = _both(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "literal")))
    page = hyp.groupBy("doc_id").agg(T.squeezed(F.array_join(F.transform(ordered, lambda b: b["literal"]), "\n")).alias("t"))
    return D.fragments(found).join(page, "doc_id", "left").where(~F.contains(F.coalesce("t", F.lit("")), F.col("f"))).groupBy("doc_id", "ord").agg(F.count("*").alias("missing"))


@query(f"""WITH {S.BLOCKS_SQL} SELECT doc_id, md5(string_agg('<li data-type="' || block_type || '">' || replace(replace(replace(replace(replace(literal, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</li>', chr(10) ORDER BY reading_order)) AS html_md5 FROM blocks GROUP BY doc_id""")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's blocks as escaped HTML, in reading order."""
    item = F.concat(F.lit('<li data-type="'), "block_type", F.lit('">'), T.html_escaped(F.col("literal")), F.lit("</li>"))
    parts = F.array_sort(F.collect_list(F.struct("reading_order", item.alias("h"))))
    return all_blocks(spark, sf_dir).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["h"]), "\n").cast("binary")).alias("html_md5"))
