"""Streams, beyond what batch reports need: findings counted by event-time window, and edits applied as
they come. A stream's state is bounded by its watermark; a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) by tumbling window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, end, n) of runs of events with no gap longer than given."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def replay_safe(stream: DataFrame, path: str, key: str):
    """A writer that appends each batch once: a batch's folder is named by its number and replaced if it
    is written again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write)
