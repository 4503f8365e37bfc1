"""Payload mappings and storage."""

import json

import pytest
from pyspark.sql import functions as F
from quire.sources import payloads as P


def page(spark, payload):
    return spark.createDataFrame([("d", 1, 1000, 1400, json.dumps(payload))], "doc_id string, page int, width int, height int, payload string")


def test_local_lines(spark):
    rows = P.local_lines(page(spark, {"rec_texts": ["a", "b", "c"], "rec_scores": [1.5, -1], "rec_boxes": [[1, 2, 11, 22]]})).orderBy("ln").collect()
    assert [(r.text, r.confidence, r.x, r.width) for r in rows] == [("a", 1.0, 1.0, 10.0), ("b", 0.0, 0.0, 1000.0), ("c", 0.0, 0.0, 1000.0)]
    with pytest.raises(Exception, match="no recognised lines"):
        P.local_lines(page(spark, {"rec_texts": []})).collect()
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        P.local_lines(page(spark, {}).withColumn("payload", F.lit("{no json"))).collect()


def test_regions(spark):
    rows = P.local_regions(page(spark, {"boxes": [{"label": "Chart", "score": 0.5, "coordinate": [0, 0, 5, 6]}, {"label": "odd", "score": 0.5, "coordinate": [0, 0, 9, 0, 9, 8, 0, 8]}]})).orderBy("ord").collect()
    assert [(r.block_type, r.width, r.height) for r in rows] == [("FIGURE", 5.0, 6.0), ("UNKNOWN", 9.0, 8.0)]
    assert [(r.raw_label, r.width) for r in P.local_regions(page(spark, {"boxes": []})).collect()] == [("full-page-fallback", 1000.0)]


def test_cloud_blocks(spark):
    poly = [0, 0, 10, 0, 10, 5, 0, 5]
    payload = {
        "paragraphs": [{"content": "t", "role": "Title", "polygon": poly, "spans": [{"offset": 0, "length": 5}]}, {"content": "gone", "polygon": []}],
        "lines": [],
        "words": [{"offset": 0, "length": 2, "confidence": 0.5}, {"offset": 3, "length": 2, "confidence": 1.0}, {"offset": 4, "length": 9, "confidence": 0.0}],
        "tables": [{"rows": 2, "columns": 3, "polygon": None, "cells": []}],
    }
    rows = P.cloud_blocks(page(spark, payload)).orderBy("ord").collect()
    assert [(r.block_type, r.confidence, r.rows) for r in rows] == [("DOCUMENT_TITLE", 0.75, None), ("TABLE", 0.0, 2)]
    only_lines = P.cloud_blocks(page(spark, {"lines": [{"content": "x", "polygon": poly, "spans": []}]})).collect()
    assert [(r.block_type, r.text, r.confidence) for r in only_lines] == [("UNKNOWN", "x", 0.0)]


def test_desktop_lines(spark):
    rows = P.desktop_lines(page(spark, {"records": [{"lines": [{"text": "a", "words": [{"bounding_rect": [5, 6, 10, 4]}, {"bounding_rect": [1]}, {"bounding_rect": [20, 2, 5, 5]}]}, {"text": "b", "words": []}]}]})).orderBy("ln").collect()
    assert [(r.x, r.y, r.width, r.height, r.confidence) for r in rows] == [(5.0, 2.0, 20.0, 8.0, 0.5), (0.0, 0.0, 1000.0, 1400.0, 0.5)]
    with pytest.raises(Exception, match="exactly one"):
        P.desktop_lines(page(spark, {"records": []})).collect()


def test_mock_and_layouts(spark):
    assert [r.status for r in P.mock_pages(spark, 2, 1, (2,)).orderBy("page").collect()] == ["COMPLETED", "FAILED"]
    assert P.full_page_layout(page(spark, {}), 0.08).first().x == 80.0


def test_storage(spark, tmp_path):
    doc = {"id": "a", "title": "t", "pages": [{"page_number": 1, "width": 10, "height": 20, "blocks": [{"id": "b", "literal_text": "x", "confidence": 0.5}]}]}
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    assert P.documents(spark, str(tmp_path / "doc.json")).select(F.explode("pages").alias("p")).first().p.blocks[0].literal_text == "x"
    assert P.documents_or_none(spark, str(tmp_path / "none.json")).count() == 0
    store = str(tmp_path / "pages")
    made = lambda d, n, s: spark.createDataFrame([(d, n, s)], "doc_id string, page_number int, status string")
    P.write_pages(made("a", 1, "FAILED").unionAll(made("b", 2, "COMPLETED")), store)
    P.write_pages(made("a", 1, "COMPLETED"), store)
    row = P.checkpoint(spark, store, "a", 1).first()
    assert (row.status, row.asset) == ("COMPLETED", "pages/0001")
    assert P.checkpoint(spark, store, "b", 2).count() == 1
    with pytest.raises(Exception, match="unsafe id"):
        P.write_pages(made("../x", 1, "FAILED"), store)


def test_jobs_and_availability(spark):
    status = spark.createDataFrame([("a", "RUNNING", 5)], "job string, state string, updated_at long")
    summary = spark.createDataFrame([("b", "done")], "job string, summary string")
    manifest = spark.createDataFrame([("a", "m")], "job string, manifest string")
    assert [(r.job, r.state, r.manifest) for r in P.jobs(status, summary, manifest).collect()] == [("a", "RUNNING", "m"), ("b", "COMPLETED", None)]
    ready = {n: (ok, missing) for n, ok, missing in P.availability({"azure_key": True})}
    assert ready["azure"] == (True, "") and ready["maximum_accuracy"] == (False, "gemini_key")


def test_stored_tables_go_with_their_scratch(spark):
    import os

    from quire.sources.storage import scratch, stored

    kept = []
    with scratch(spark, kept):
        first = stored(spark.range(5))
        kept.append(stored(first.where("id > 2")))
    assert not os.path.exists(first._stored_at) and sorted(r.id for r in kept[0].collect()) == [3, 4]


def test_the_entry_needs_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, check=True)
