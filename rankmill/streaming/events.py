"""Structured Streaming over behaviour events: an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, value_sum) of events(ts, event_type, value), batch or stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value_sum")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", "value_sum"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n) with sessions that end after a gap, batch or stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"
    )


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once, within the watermark where the events are a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if e.isStreaming else e.dropDuplicates([key])
