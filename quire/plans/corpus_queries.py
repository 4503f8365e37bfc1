"""Corpus hygiene queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import corpus as C
from quire.plans.registry import query
from quire.sources import derived as S

_HASH = r"sha256(translate(trim(regexp_replace(text, '\s+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
_FAMILY_SQL = f"h AS (SELECT doc_id, lang, {_HASH} AS hash FROM documents), f AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY hash) AS family FROM h)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents")


@query(f"WITH h AS (SELECT doc_id, {_HASH} AS hash FROM documents) SELECT hash, min(doc_id) AS first_doc, count(*) AS copies FROM h GROUP BY hash HAVING count(*) > 1")
def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_groups(_docs(spark, sf_dir))


@query()
def near_duplicate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.near_duplicate_families(_docs(spark, sf_dir))


@query(f"WITH {_FAMILY_SQL} SELECT doc_id, family FROM f")
def document_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.families(_docs(spark, sf_dir)).select("doc_id", "family")


@query()
def family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's split; a family of near copies is never divided."""
    return C.near_families(_docs(spark, sf_dir)).select("doc_id", "family", C.split_of(F.col("family")).alias("split"))


@query(f"WITH {_FAMILY_SQL}, s AS (SELECT family, CASE WHEN doc_id % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM f) SELECT family, count(DISTINCT split) AS splits, count(*) AS documents FROM s GROUP BY family HAVING count(DISTINCT split) > 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families that a split by document (here: by id) would divide."""
    rows = C.families(_docs(spark, sf_dir)).select("family", F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test").alias("split"))
    grouped = rows.groupBy("family").agg(F.min("split").alias("a"), F.max("split").alias("b"), F.count("*").alias("documents")).where("a <> b")
    return grouped.select("family", F.lit(2).cast("long").alias("splits"), "documents")


@query("SELECT DISTINCT d.doc_id, b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.contamination(_docs(spark, sf_dir), S.table(spark, sf_dir, "benchmark"))


@query("SELECT lang, count(*) AS documents, CAST(sum(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END) AS BIGINT) AS without_text, CAST(sum(CASE WHEN n_chars <> length(text) THEN 1 ELSE 0 END) AS BIGINT) AS wrong_length, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def admission_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = S.table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l"))
    return _docs(spark, sf_dir).join(labelled, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("without_text"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_length"), F.count_if(F.col("l").isNull()).alias("unlabelled"))


@query("WITH r AS (SELECT d.doc_id, lang, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY (d.doc_id * 7919) % 104729, d.doc_id) AS k FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, lang, quality FROM r WHERE k <= 5")
def stratified_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each language and label. The quota is the feature."""
    from pyspark.sql import Window

    rows = _docs(spark, sf_dir).select("doc_id", "lang").join(S.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    order = Window.partitionBy("lang", "quality").orderBy((F.col("doc_id") * 7919) % 104729, "doc_id")
    return rows.withColumn("k", F.row_number().over(order)).where("k <= 5").select("doc_id", "lang", "quality")


@query()
def hashed_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quota_sample(_docs(spark, sf_dir).select("doc_id", "lang", "source"), ["lang"], "doc_id", 10).drop("pick")
