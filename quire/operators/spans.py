"""Words in spans: an interval containment join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Both sides meet in stretches of this many characters, so that a long document is no product of its words and spans.
STRETCH = 1000


def words(docs: DataFrame) -> DataFrame:
    """doc_id, start, length of the words between single spaces: running sums by document."""
    steps = docs.select("doc_id", F.posexplode(F.transform(F.split("text", " "), lambda w: F.length(w) + 1)).alias("i", "step"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return steps.select("doc_id", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("start"), (F.col("step") - 1).alias("length"))


def inside(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Words (doc_id, start, length, ...) with each span (doc_id, span, from, to) that holds them whole."""
    spread = spans.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("from") / STRETCH), F.floor(F.col("to") / STRETCH))))
    keyed = found.withColumn("stretch", F.floor(F.col("start") / STRETCH))
    return keyed.join(spread, ["doc_id", "stretch"]).where("start >= from and start + length <= to")
