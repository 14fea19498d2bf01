"""Queries over plans, conversations and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import assistant as A
from weft.operators import planner as P
from weft.plans.fixtures import view

NOW = "2024-01-15 12:00:00"
#: Keys of the canned replies, in order.
KEYS = ["date", "formal", "weather", "travel"]


def weather_as_of(spark, d):
    out = P.weather_as_of(view(spark, d, "calendar_events"), view(spark, d, "weather_snapshots"))
    return out.select("event_id", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"))


def due_reminders(spark, d):
    return P.due_reminders(view(spark, d, "calendar_events"), NOW).select("event_id")


def reminder_runs(spark, d):
    return P.reminder_runs(view(spark, d, "calendar_events")).select("event_id", F.date_format("run_at", "yyyy-MM-dd HH:mm:ss").alias("run_at"))


def events_in_trips(spark, d):
    return P.events_in_trips(view(spark, d, "user_calendar"), view(spark, d, "trips")).select("user_id", "trip_no", "event_id")


def trip_days(spark, d):
    return P.trip_days(view(spark, d, "trips")).withColumn("day", F.col("day").cast("string"))


def capsules(spark, d):
    """A trip for every eight items of a user, so that the limit leaves none out."""
    packed = view(spark, d, "items").select(F.expr("item_id div 400 * 50 + user_id").alias("trip"), "item_id", "slot")
    return P.capsule(packed, 8)


def capsule_choice(spark, d):
    """Trips of up to 24 items of a user, of which nine go into the luggage."""
    packed = view(spark, d, "items").select(F.expr("item_id div 1200 * 50 + user_id").alias("trip"), "item_id", "slot")
    return P.capsule(packed, 9)


def capsule_items(spark, d):
    """The nine items themselves, the warmest of each slot first."""
    packed = view(spark, d, "items").select(F.expr("item_id div 1200 * 50 + user_id").alias("trip"), "item_id", "slot", (-F.col("warmth")).alias("cold"))
    return P.pack_capsule(packed, 9, ["cold"]).select("trip", "item_id", "slot")


def _plans(spark, d):
    """Three outfits for each event that has a reminder; the others have no plan."""
    return view(spark, d, "calendar_events").where("remind_enabled").select("event_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")).select("event_id", (F.col("event_id") * 10 + F.col("k")).alias("outfit_id"), (F.col("event_id") * F.col("k") % 7).alias("score"))


def plan_calendar(spark, d):
    return P.plan_calendar(view(spark, d, "calendar_events"), _plans(spark, d))


def unplanned_events(spark, d):
    return P.unplanned(view(spark, d, "calendar_events"), _plans(spark, d)).select("event_id")


def conversation_rollup(spark, d):
    return A.conversation_rollup(view(spark, d, "interactions"))


def keyword_routes(spark, d):
    keys = ["the", "der", "que", "les"]
    return view(spark, d, "interactions").where("role = 'user'").groupBy(text.route_keyword(F.col("text"), keys).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def usage_report(spark, d):
    return A.usage_report(view(spark, d, "ai_usage"))


def usage_by_day(spark, d):
    return A.usage_by_day(view(spark, d, "ai_usage")).withColumn("day", F.col("day").cast("string"))


def usage_latency_p95_by_day(spark, d):
    calls = view(spark, d, "ai_usage").withColumn("day", F.to_date("created_at").cast("string"))
    return A.latency_p95(calls, ["provider", "day"])


def usage_latency_p95(spark, d):
    return A.latency_p95(view(spark, d, "ai_usage"))


def unread_notifications(spark, d):
    notes = view(spark, d, "events").select((F.col("user_id") % 50).alias("user_id"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("read_at"), F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp")).alias("scheduled_at"))
    return A.unread_notifications(notes, NOW)


def identity_keys(spark, d):
    c = view(spark, d, "customer")
    email = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), "c_name", F.lit("@Example.COM ")))
    phone = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("+49 (0) "), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", text.identity_key(email, phone, F.lit("apple"), F.col("c_name")).alias("key"))


#: Every choice of counts that fits, the best one first; then items by rank.
_CHOICE = """p AS (SELECT item_id // 1200 * 50 + user_id AS trip, item_id, slot, warmth, CASE WHEN slot IN ('top', 'bottom', 'shoes') THEN slot ELSE 'other' END AS kind FROM items),
      have AS (SELECT trip, count(*) FILTER (slot = 'top') AS t, count(*) FILTER (slot = 'bottom') AS b, count(*) FILTER (slot = 'shoes') AS s FROM p GROUP BY trip),
      ways AS (SELECT trip, x, y, z, row_number() OVER (PARTITION BY trip ORDER BY (CASE WHEN t > 0 THEN x ELSE 1 END) * (CASE WHEN b > 0 THEN y ELSE 1 END) * (CASE WHEN s > 0 THEN z ELSE 1 END) DESC, x DESC, y DESC, z DESC) AS place
        FROM have, range(10) a(x), range(10) b(y), range(10) c(z) WHERE x <= t AND y <= b AND z <= s AND x + y + z <= 9),
      best AS (SELECT * FROM ways WHERE place = 1),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY trip, kind ORDER BY warmth DESC, item_id) AS r FROM p),
      taken AS (SELECT r.* FROM ranked r JOIN best USING (trip) WHERE r.r <= CASE kind WHEN 'top' THEN x WHEN 'bottom' THEN y WHEN 'shoes' THEN z ELSE 9 - x - y - z END)"""

QUERIES = {
    weather_as_of: "SELECT e.event_id, strftime(w.captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at FROM calendar_events e ASOF LEFT JOIN weather_snapshots w ON e.user_id = w.user_id AND e.starts_at >= w.captured_at",
    due_reminders: f"SELECT event_id FROM calendar_events WHERE remind_enabled AND NOT reminder_sent AND starts_at - to_minutes(reminder_minutes_before) <= TIMESTAMP '{NOW}' AND starts_at > TIMESTAMP '{NOW}'",
    reminder_runs: """SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS run_at FROM (SELECT event_id, starts_at, starts_at - to_minutes(reminder_minutes_before) AS due_at, time_bucket(INTERVAL 15 MINUTE, starts_at - INTERVAL 2 HOUR) AS t0 FROM calendar_events WHERE remind_enabled AND NOT reminder_sent),
      LATERAL (SELECT unnest(generate_series(t0, starts_at, INTERVAL 15 MINUTE)) AS t) WHERE t >= due_at AND t < starts_at""",
    events_in_trips: "SELECT t.user_id, t.trip_no, e.event_id FROM trips t JOIN user_calendar e ON e.user_id = t.user_id AND CAST(e.starts_at AS DATE) BETWEEN t.starts_on AND t.ends_on",
    trip_days: "SELECT user_id, trip_no, CAST(CAST(starts_on + CAST(k AS INT) AS DATE) AS VARCHAR) AS day, CAST(k + 1 AS INT) AS day_no FROM (SELECT *, unnest(range(date_diff('day', starts_on, ends_on) + 1)) AS k FROM trips)",
    capsules: """WITH p AS (SELECT item_id // 400 * 50 + user_id AS trip, slot, row_number() OVER (PARTITION BY item_id // 400 * 50 + user_id ORDER BY item_id) AS r FROM items),
      c AS (SELECT trip, count(*) FILTER (slot = 'top') AS tops, count(*) FILTER (slot = 'bottom') AS bottoms, count(*) FILTER (slot = 'shoes') AS shoes, count(*) AS items FROM p WHERE r <= 8 GROUP BY 1) SELECT *, tops * bottoms * shoes AS outfits FROM c""",
    capsule_choice: f"""WITH {_CHOICE}, c AS (SELECT trip, count(*) FILTER (slot = 'top') AS tops, count(*) FILTER (slot = 'bottom') AS bottoms, count(*) FILTER (slot = 'shoes') AS shoes, count(*) AS items FROM taken GROUP BY trip)
      SELECT *, tops * bottoms * shoes AS outfits FROM c""",
    capsule_items: f"WITH {_CHOICE} SELECT trip, item_id, slot FROM taken",
    plan_calendar: """WITH p AS (SELECT event_id, event_id * 10 + k AS outfit_id, row_number() OVER (PARTITION BY event_id ORDER BY event_id * k % 7 DESC, k) AS r FROM calendar_events, range(1, 4) t(k) WHERE remind_enabled)
      SELECT e.event_id, p.outfit_id FROM calendar_events e LEFT JOIN p ON p.event_id = e.event_id AND p.r = 1""",
    unplanned_events: "SELECT event_id FROM calendar_events WHERE NOT remind_enabled",
    conversation_rollup: """SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, CAST(sum(length(text)) AS BIGINT) AS chars, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text FROM interactions GROUP BY 1""",
    keyword_routes: "SELECT CASE WHEN contains(lower(text), 'the') THEN 'the' WHEN contains(lower(text), 'der') THEN 'der' WHEN contains(lower(text), 'que') THEN 'que' WHEN contains(lower(text), 'les') THEN 'les' ELSE 'fallback' END AS route, count(*) AS n FROM interactions WHERE role = 'user' GROUP BY 1",
    usage_report: "SELECT endpoint, provider, count(*) AS calls, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 4) AS success_rate, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 5) AS cost, round(avg(latency_ms), 3) AS mean_ms FROM ai_usage GROUP BY ROLLUP (endpoint, provider)",
    usage_by_day: "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, endpoint, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM ai_usage GROUP BY 1, 2",
    usage_latency_p95_by_day: "WITH r AS (SELECT provider, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, latency_ms, row_number() OVER (PARTITION BY provider, CAST(created_at AS DATE) ORDER BY latency_ms) - 1 AS k, count(*) OVER (PARTITION BY provider, CAST(created_at AS DATE)) AS n FROM ai_usage) SELECT provider, day, latency_ms AS p95_ms FROM r WHERE k = round_even(0.95 * (n - 1), 0)",
    usage_latency_p95: "WITH r AS (SELECT endpoint, latency_ms, row_number() OVER (PARTITION BY endpoint ORDER BY latency_ms) - 1 AS k, count(*) OVER (PARTITION BY endpoint) AS n FROM ai_usage) SELECT endpoint, latency_ms AS p95_ms FROM r WHERE k = round_even(0.95 * (n - 1), 0)",
    unread_notifications: f"SELECT user_id % 50 AS user_id, count(*) AS unread, count(*) FILTER (event_id % 4 = 0 OR ts <= TIMESTAMP '{NOW}') AS due FROM events WHERE event_id % 3 <> 0 GROUP BY 1",
    identity_keys: "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(c_name || '@example.com') WHEN 1 THEN '490' || c_custkey ELSE substr(sha256('apple:' || c_name), 1, 20) END AS key FROM customer",
}
