"""The pipeline's stages against plain reckoning on a small table."""

import zlib

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from quire.llm import jaccard, packing, quality, secrets, toxicity
from quire.llm.registry import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from quire.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(stored(f(spark, out[-1], SF)))
    return out


def test_columns_and_names(spark, stages):
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_classifiers_keep_clean_documents(spark, stages):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [{r.doc_id for r in df.select("doc_id").collect()} for df in stages[:-1]]
    assert kept[1] < kept[0] and kept[2] < kept[1]
    clean = [d for d, r in labels.items() if r.quality and d in kept[0]]
    assert sum(d in kept[1] for d in clean) >= 0.95 * len(clean)
    junk = [d for d, r in labels.items() if not r.quality]
    assert sum(d in kept[1] for d in junk) <= 0.4 * len(junk)


def test_one_document_of_each_group_stays(spark, stages):
    groups = {}
    for r in jaccard.join(stages[2]).collect():
        groups.setdefault(r.component_id if r.n_shingles else ("empty", r.doc_id), []).append(r.doc_id)
    assert {r.doc_id for r in stages[3].collect()} == {min(g) for g in groups.values()}


def test_secrets_are_gone(spark, stages):
    before = {r.doc_id: r.spans for r in secrets.digest(stages[3]).collect()}
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        assert r.n_chars == len(r.text)
        if not before[r.doc_id]:
            assert r.text == texts[r.doc_id]
    assert all(r.n_assign == r.n_access == 0 for r in secrets.digest(stages[4]).collect())


def test_every_token_is_packed_once(spark, stages):
    encoder = packing.Encoder(vocabulary("byte_bpe_50k.json"))
    ids = {r.doc_id: encoder.one(r.text or "") + b"\1\0\0\0" for r in stages[4].collect()}
    check_packing(stages[5].collect(), ids)


def check_packing(rows, ids):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == ids.keys()
    for d, found in pieces.items():
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d]) // 4
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[d][4 * r.start : 4 * at])
        assert at == len(ids[d]) // 4
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_survivors_with_nulls_and_repeats(spark):
    rows = [(3, "a b c d e f g", 1), (3, "a b c d e f g", 2), (1, "A b c d e f g", 3), (1, "A b c d e f g", 3), (None, "a b c d e f g", 4), (None, None, 5), (None, "", 5), (9, "x y", 6), (9, "x z", 6), (None, "null only", 7), (None, "null only", 7)]
    got = sorted(((r.doc_id, r.text) for r in jaccard.survivors(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()), key=str)
    assert got == sorted([(1, "A b c d e f g"), (None, None), (None, ""), (9, "x y"), (9, "x z"), (None, "null only")], key=str)
    assert jaccard.survivors(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_classifiers_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5, 0.5), (1, None, 5, 0.5), (2, "", 5, 0.5), (None, "word " * 9000, 5, 0.5), (3, "you idiot, you stupid moron", 5, 0.5)], "doc_id long, text string, label int, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for f in (quality.classify, toxicity.detect):
            rows = f(spark, docs, labels).collect()
            assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
            assert f(spark, docs.limit(0), labels).count() == 0
    assert [r.predicted for r in toxicity.detect(spark, docs, none).where("doc_id = 3").collect()] == [1]


def test_run_on_odd_tables(spark, tmp_path):
    """The whole of run() on empty, unlabelled, null and wide tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clashing = {c: F.lit("x") for c in ("__d", "__k", "row", "score", "group", "class", "label", "spans", "kept")}
    odd = docs.limit(40).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars")).withColumns(clashing)
    odd = odd.unionAll(odd.where("doc_id < 9")).unionAll(odd.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    for name, table, marks in (("odd", odd, labels), ("unlabelled", docs, labels.limit(0)), ("empty", docs.limit(0), labels)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        marks.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = P.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name != "empty")
        assert {r.doc_id for r in rows} <= {r.doc_id for r in table.collect()}
        kept = table
        for _, f in P.STAGES[:-1] if name == "odd" else []:
            kept = f(spark, kept, f"{tmp_path}/{name}")
            assert kept.columns == table.columns
