"""Micro-batch counterparts: an index that follows a stream of notes, and a running usage summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelake.operators import index


def usage_stream(spark: SparkSession, path: str) -> DataFrame:
    """A growing JSON-lines log as a stream."""
    return spark.readStream.schema("ts timestamp, command string, status string, duration_ms double").json(path)


def windowed_usage(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, command, events, errors) by time window; later events than ``late`` are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "command")
    return grouped.agg(F.count("*").alias("events"), F.count_if(F.col("status") != "ok").alias("errors")).select(F.col("window.start").alias("start"), "command", "events", "errors")


def follow(changed: DataFrame, weights: dict[str, float], folder: str, checkpoint: str, key: str = "path", every: str | None = None) -> StreamingQuery:
    """Keeps the index in a folder up to date with a stream of new and changed rows; rows that don't
    come stay. A batch that is tried again finds its rows indexed and changes nothing. Without
    ``every``, a processing time, it takes what there is and ends."""

    def take(batch: DataFrame, _: int) -> None:
        index.update(batch, weights, folder, key, whole=False)
        index.settle(batch.sparkSession, folder)

    writer = changed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
