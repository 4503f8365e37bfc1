"""The registered queries: whole tables, contracts, oracles, held-out accuracy."""

import hashlib
import os
import zlib

import duckdb
import pandas as pd
import pytest
from quire.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    wanted = duck.sql(registry.oracle_sql()[name]).fetchdf()
    order = sorted(got.columns)
    whole = {c: "int64" for c in order if pd.api.types.is_integer_dtype(wanted[c])}
    plain = lambda df: df[order].astype(whole).sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(plain(got), plain(wanted))


@pytest.mark.parametrize(("name", "label", "folds", "left_out", "threshold"), [("op1_toxicity", "toxic", 4, 2, 0.3), ("op7_quality", "quality", 3, 1, 0.5)])
def test_held_out_accuracy(spark, name, label, folds, left_out, threshold):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in registry.queries()[name](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % folds == left_out)
        assert r.predicted == (r.score >= threshold) and 0 <= r.score <= 1
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out}
    assert sum(rows[d].predicted == y for d, y in truth.items()) >= 0.97 * len(truth)
    for kind in (0, 1):
        own = [d for d, y in truth.items() if y == kind]
        assert sum(rows[d].predicted == kind for d in own) >= 0.9 * len(own)


def test_url_query(spark):
    rows = registry.queries()["op2_url_filter"](spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        rest = urls[r.page_id].split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0] + [len(rest)])
        path = rest[end:].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (rest[:end].lower(), path)
        assert r.verdict in ("allow", "block")


def test_fingerprint_query(spark):
    rows = {r.doc_id: r for r in registry.queries()["op5_fingerprints"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[d])
        changed = texts[d][: n - n // 2] + texts[after][: n // 2]
        assert rows[d].n_chars == n and rows[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
    long = [r for r in rows.values() if r.n_chars > 600]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)


def test_packing_query(spark):
    from quire.llm import packing
    from test_pipeline import check_packing

    encoder = packing.Encoder(registry.vocabulary("byte_bpe_50k.json"))
    ids = {r.doc_id: encoder.one(r.text or "") + b"\1\0\0\0" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.queries()["op10_packing"](spark, SF).collect()
    check_packing(rows, ids)
    for parts in (1, 64, 211):
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(parts)
        lengths = {}
        for r in packing.pack(docs, registry.vocabulary("byte_bpe_50k.json")).collect():
            lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
        used = sum(lengths.values())
        padded = sum(n if n & (n - 1) == 0 else packing.WINDOW for n in lengths.values())
        assert used / padded > 0.985, parts


def test_bpe_query(spark):
    """Every text of the table against the library."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(registry.vocabulary("word_bpe_49k.json"))
    plain.no_truncation()
    plain.no_padding()
    rows = {r.doc_id: r for r in registry.queries()["op3_bpe"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = plain.encode(d.text or "", add_special_tokens=False).ids
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()
