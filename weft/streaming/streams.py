"""Streams over append-only events: wear counters, usage windows, idempotent intake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wear_counter_stream(wears: DataFrame, watermark: str = "1 day") -> DataFrame:
    """item_id, day, times_worn, last_worn_at, to be merged into a table of counters; wears of the watermark's span still count."""
    timed = wears.withColumn("worn_at", F.col("worn_at").cast("timestamp")).withWatermark("worn_at", watermark)
    return timed.groupBy("item_id", F.window("worn_at", "1 day")).agg(F.count(F.lit(1)).alias("times_worn"), F.max("worn_at").alias("last_worn_at")).select("item_id", F.col("window.start").alias("day"), "times_worn", "last_worn_at")


def usage_windows(calls: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "1 day") -> DataFrame:
    """start, endpoint, calls, tokens for each window (sliding if `slide` is given).

    In append mode a window comes once, when the watermark has passed its end; rows that come later are dropped.
    """
    timed = calls.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", watermark)
    window = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    return timed.groupBy(window, "endpoint").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), "endpoint", "calls", "tokens")


def unique_results(results: DataFrame, at: str = "received_at", watermark: str = "1 day") -> DataFrame:
    """One result for each request_id within the watermark."""
    return results.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark).dropDuplicatesWithinWatermark(["request_id"])
