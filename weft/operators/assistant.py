"""Assistant: conversations, routing, usage, notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.ranks import nearest_rank


def conversation_rollup(turns: DataFrame) -> DataFrame:
    """conv_id, messages, users, assistants, chars, last_role, last_text of each conversation; also tokens and mean_ms where `turns` has tokens and latency_ms."""
    extra = {"tokens": F.sum("tokens").alias("tokens"), "latency_ms": F.avg("latency_ms").alias("mean_ms")}
    more = [c for k, c in extra.items() if k in turns.columns]
    last = F.max_by(F.struct("role", "text"), "turn")
    rows = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"),
        F.sum(F.length("text")).alias("chars"), *more, last.alias("last"),
    )
    return rows.withColumns({"last_role": F.col("last.role"), "last_text": F.col("last.text")}).drop("last")


def usage_report(calls: DataFrame) -> DataFrame:
    """endpoint, provider, calls, success_rate, tokens, cost, mean_ms for each provider of an endpoint, each endpoint, and overall."""
    return calls.rollup("endpoint", "provider").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.avg(F.col("success").cast("double")), 4).alias("success_rate"), F.sum("tokens").alias("tokens"),
        F.round(F.sum(F.col("cost_usd").cast("decimal(18,8)")), 5).cast("double").alias("cost"), F.round(F.avg("latency_ms"), 3).alias("mean_ms"),
    )


def usage_by_day(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.to_date("created_at").alias("day"), "endpoint").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


def latency_p95(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by (endpoint, if not given), p95_ms by nearest rank, half-even."""
    return nearest_rank(calls, "latency_ms", 0.95, by or ["endpoint"], "p95_ms")


def unread_notifications(notes: DataFrame, now: str) -> DataFrame:
    """user_id, unread, due: unread notifications, and those of them whose time has come."""
    due = F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= F.lit(now).cast("timestamp"))
    return notes.where("read_at is null").groupBy("user_id").agg(F.count(F.lit(1)).alias("unread"), F.count_if(due).alias("due"))
