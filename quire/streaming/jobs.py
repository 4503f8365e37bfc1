"""Streams: an extension beyond batch evaluation. Job events to windowed counts and to the latest state of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The event files of a folder, by name, as a stream. Times without a zone are UTC's."""
    zoned = ", ".join(f"{f.name} {'timestamp' if f.dataType.simpleString() == 'timestamp_ntz' else f.dataType.simpleString()}" for f in schema.fields)
    return spark.readStream.schema(zoned).option("pathGlobFilter", name).parquet(folder)


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; late ones within the watermark still count, and state older than it is dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def latest(stream: DataFrame) -> DataFrame:
    """Last event type of each user: one row of state a user."""
    return stream.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("events"))


def deduplicated(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, with state bounded by the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(result: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> None:
    """Works off what is there and ends; every batch replaces the result (complete) or adds to it (append)."""
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
