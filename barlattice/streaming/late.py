"""A streaming extension: sessions of events with the panel's late-data policy (late rows are dropped, never backfilled)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Count and sum per window and event type; rows later than the watermark are dropped.

    ``events`` (event_id, ts, event_type, value) may be a stream or a table. Repeats of one event_id
    at one ts count once.
    """
    seen = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        seen = seen.withWatermark("ts", delay)
    once = seen.dropDuplicates(["event_id", "ts"])
    g = once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
