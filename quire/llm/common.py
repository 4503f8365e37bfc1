"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.storage import discard, scratch, stored

__all__ = ["BATCH", "bounded", "discard", "fold", "labelled", "scratch", "slices", "stored"]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids: crc32 of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: Bytes of an Arrow batch on its way to or from a Python worker; each executor core holds a few of them, in the JVM and in Python.
BATCH = "4m"


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are small, unless someone has set their size: the default lets a batch have 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) in ("67108864b", "67108864", "64MB", "64m"):
        df.sparkSession.conf.set(name, BATCH)
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", budget: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with about budget bytes of text each, and at least a row. Bounds what a Python worker holds at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and held + n > budget:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


def labelled(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents outside the fold left out, the bound being a documented parameter.

    The documents are those with the least hash of the id, so that the choice is the same at every run and spread over all
    sources. Null ids and null labels take no part; of several labels of one id the largest holds, of several rows of one id
    that with the least hash of its text, so that no id gives more than a row.
    """
    chosen = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != left_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # `rows` bounds the side that is broadcast, and what is left after one row an id.
    found = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("own")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("own").alias("own")).select("doc_id", "own.text", "label")
