"""Streams of status and queue events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def status_stream(events: DataFrame) -> DataFrame:
    """events (doc_id, event_id, status, error) -> the state of each touched document after every batch.

    A streaming aggregation for update mode: the highest event id decides, in any arrival order. The error is that of
    the last event that sets or clears one.
    """
    settles = F.when(F.col("status").isin("pending", "indexed", "failed"), F.col("event_id"))
    error = F.when(F.col("status") == "failed", F.substring("error", 1, 500))
    return events.groupBy("doc_id").agg(
        F.max_by("status", "event_id").alias("status"), F.max_by(error, settles).alias("last_error"),
        F.count("*").alias("n_events"))


def dedup_stream(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Queue events without repeats of a payload inside the delay; the watermark bounds the state."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["payload"])
