"""Queries that run as streams over what is there, and must equal the same job over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.plans.fixtures import view
from weft.storage import scratch_folder, stored
from weft.streaming import counters as C
from weft.streaming import streams as S


def _live(spark, d):
    """The events as a stream; their time is cast, as watermarks need."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    live = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a pattern may also name a file, a plain path only a folder
    return live.withColumn("ts", F.col("ts").cast("timestamp"))


def _appended(spark, stream, folder):
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return stored(spark.read.schema(stream.schema).parquet(f"{folder}/out"))


def wear_counter_table(spark, d):
    """Counters that a stream of wears keeps, joined to the items that were worn."""
    items = view(spark, d, "items").select("item_id")
    worn = F.col("user_id") % 50 + 50 * (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 40)
    wears = _live(spark, d).where("event_type IN ('view', 'click')").select(worn.alias("item_id"), F.col("ts").alias("worn_at")).join(items, "item_id")
    with scratch_folder(spark) as folder:
        C.keep_counters(S.wear_counter_stream(wears), f"{folder}/table", f"{folder}/progress").awaitTermination()
        counted = C.counted_items(items, C.current_counters(spark, f"{folder}/table")).where("times_worn > 0")
        return stored(counted.select("item_id", "times_worn", F.date_format("last_worn_at", "yyyy-MM-dd HH:mm:ss").alias("last_worn_at")))


def _usage(spark, d, slide):
    calls = _live(spark, d).select(F.col("event_type").alias("endpoint"), F.col("ts").alias("created_at"), (F.col("event_id") % 500).alias("tokens"))
    with scratch_folder(spark) as folder:
        closed = _appended(spark, S.usage_windows(calls, "1 hour", slide), folder)
    return closed.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def usage_windows_closed(spark, d):
    """Usage by hour, for the hours that ended a day before the latest call."""
    return _usage(spark, d, None)


def usage_windows_sliding(spark, d):
    """The same for hours that begin at each half hour."""
    return _usage(spark, d, "30 minutes")


def unique_intake(spark, d):
    """Requests whose results arrived, each once however often it was sent."""
    results = _live(spark, d).select((F.col("event_id") % 1000 * 7 + F.col("user_id") % 7).cast("string").alias("request_id"), F.lit("2024-01-01").cast("timestamp").alias("received_at"))
    with scratch_folder(spark) as folder:
        return _appended(spark, S.unique_results(results).select("request_id"), folder)


def _windows_sql(step: int) -> str:
    return f"""WITH a AS (SELECT *, max(created_at) OVER () - INTERVAL 1 DAY AS limit_at FROM ai_usage),
      w AS (SELECT *, time_bucket(INTERVAL {step} MINUTE, created_at) - to_minutes(CAST({step} * k AS INT)) AS start FROM a, range({60 // step}) t(k))
      SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, endpoint, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM w WHERE start + INTERVAL 1 HOUR <= limit_at GROUP BY ALL"""


QUERIES = {
    wear_counter_table: "SELECT item_id, count(*) AS times_worn, strftime(max(worn_at), '%Y-%m-%d %H:%M:%S') AS last_worn_at FROM wear_events GROUP BY item_id",
    usage_windows_closed: _windows_sql(60),
    usage_windows_sliding: _windows_sql(30),
    unique_intake: "SELECT DISTINCT CAST(event_id % 1000 * 7 + user_id % 7 AS VARCHAR) AS request_id FROM events",
}
