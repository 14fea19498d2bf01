"""Plans: weather as of an event, reminders, trips, packing, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.storage import join_same


def weather_as_of(events: DataFrame, snapshots: DataFrame, by: str = "user_id", days: int = 31) -> DataFrame:
    """Each event with the newest snapshot of its user at or before its start (temperature_c, captured_at; null if none).

    Both sides are one stream ordered by time, a snapshot before an event of the same
    time.  A user's stream is cut into spans of `days`, each a window of its own that
    starts from the last snapshot of the spans before, so a user with very many rows is
    spread over many tasks.
    """
    a = snapshots.select(by, F.col("captured_at").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event_id"), F.struct("captured_at", "snapshot_id", "temperature_c").alias("w"))
    b = events.select(by, F.col("starts_at").alias("at"), F.lit(1).alias("kind"), F.col("event_id").cast("long").alias("event_id"), F.lit(None).cast(a.schema["w"].dataType).alias("w"))
    rows = a.unionByName(b).withColumn("span", F.floor(F.datediff(F.to_date("at"), F.to_date(F.lit("1970-01-01"))) / days))
    spans = rows.groupBy(by, "span").agg(F.max("w").alias("last"))
    earlier = Window.partitionBy(by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(by, "span", F.max("last").over(earlier).alias("carried"))
    inside = Window.partitionBy(by, "span").orderBy("at", "kind", F.col("w.snapshot_id")).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("seen", F.last("w", ignorenulls=True).over(inside)).where("kind = 1").join(carried, [by, "span"])
    best = F.coalesce("seen", "carried")
    return filled.select("event_id", by, F.col("at").alias("starts_at"), best["captured_at"].alias("captured_at"), best["temperature_c"].alias("temperature_c"))


def due_reminders(events: DataFrame, now: str) -> DataFrame:
    """Events whose reminder is on, not sent, and due at `now`, before the event starts."""
    at = F.col("starts_at") - F.make_interval(mins=F.col("reminder_minutes_before"))
    t = F.lit(now).cast(events.schema["starts_at"].dataType)
    return events.where(F.col("remind_enabled") & ~F.col("reminder_sent") & (at <= t) & (F.col("starts_at") > t))


def reminder_runs(events: DataFrame, minutes: int = 15) -> DataFrame:
    """event_id, run_at: every run in which an event's unsent reminder is due, of a job that runs each `minutes` from the epoch on.

    What `due_reminders` finds at each of these times, over the whole table at once and without a shuffle.
    Events without a start, or without a run between reminder and start, have no row.
    """
    every = minutes * 60_000_000
    at = F.col("starts_at").cast("timestamp")
    first, behind = (F.ceil(F.unix_micros(t) / F.lit(every)) for t in (at - F.make_interval(mins=F.col("reminder_minutes_before")), at))
    waiting = events.where(F.col("remind_enabled") & ~F.col("reminder_sent")).select("event_id", first.alias("first"), behind.alias("behind")).where("first < behind")
    return waiting.select("event_id", F.explode(F.expr("sequence(first, behind - 1)")).alias("k")).select("event_id", F.timestamp_micros(F.col("k") * every).alias("run_at"))


def events_in_trips(events: DataFrame, trips: DataFrame) -> DataFrame:
    """user_id, trip_no, event_id, starts_at: events on a day of a trip of their user (range join on days).

    Trips are laid out by month, so that user and month are an equality and only days are compared.
    """
    months = F.explode(F.sequence(F.trunc("starts_on", "month"), F.trunc("ends_on", "month"), F.expr("interval 1 month"))).alias("m")
    spans = trips.select("user_id", "trip_no", "starts_on", "ends_on", months)
    days = events.select("user_id", "event_id", "starts_at", F.to_date("starts_at").alias("day"), F.trunc(F.to_date("starts_at"), "month").alias("m"))
    return days.join(spans, ["user_id", "m"]).where(F.col("day").between(F.col("starts_on"), F.col("ends_on"))).select("user_id", "trip_no", "event_id", "starts_at")


def trip_days(trips: DataFrame) -> DataFrame:
    """user_id, trip_no, day, day_no."""
    return trips.select("user_id", "trip_no", F.posexplode(F.sequence("starts_on", "ends_on")).alias("k", "day")).select("user_id", "trip_no", "day", (F.col("k") + 1).alias("day_no"))


#: Slots that make an outfit, in the order in which they get what can't be dealt evenly, and the columns of their counts.
SLOTS = {"top": "tops", "bottom": "bottoms", "shoes": "shoes"}


def even_counts(have: dict[str, Column], limit: Column) -> dict[str, Column]:
    """How many of each slot to take, so that their product is greatest with at most `limit` in all.

    The product of numbers with a given sum grows the more even they are, so all slots are filled to one level as far as they reach;
    what is left, fewer than there are slots above the level, goes to these in order.  A slot without items leaves its share to the others.
    """
    low, middle, high = (F.sort_array(F.array(*have.values()))[i] for i in range(3))
    two = F.floor((limit - low) / 2)
    level = F.when(limit >= low + middle + high, high).when(F.floor(limit / 3) < low, F.floor(limit / 3)).when(two < middle, two).otherwise(limit - low - middle)
    taken = {s: F.least(n, level) for s, n in have.items()}
    left = limit - sum(taken.values())
    out, above = {}, F.lit(0)
    for slot, n in have.items():
        above = above + (n > level).cast("int")
        out[slot] = (taken[slot] + F.when((n > level) & (above <= left), 1).otherwise(0)).cast("long")
    return out


def pack_capsule(packed: DataFrame, limit: int, order: list[str] | None = None) -> DataFrame:
    """The items of `packed` (trip, item_id, slot) that go into each trip's luggage: at most `limit`, chosen so that they make the most outfits.

    Of each slot the first items in `order` (by id if none is given) are taken; items of other slots fill what is left.
    """
    counts = packed.groupBy("trip").agg(*[F.count_if(F.col("slot") == s).alias(f"n_{n}") for s, n in SLOTS.items()])
    chosen = even_counts({s: F.col(f"n_{n}") for s, n in SLOTS.items()}, F.lit(limit))
    plan = counts.select("trip", *[c.alias(f"take_{SLOTS[s]}") for s, c in chosen.items()])
    plan = plan.withColumn("take_other", F.lit(limit) - sum(F.col(f"take_{n}") for n in SLOTS.values()))
    kind = F.when(F.col("slot").isin([*SLOTS]), F.col("slot")).otherwise(F.lit("other"))
    w = Window.partitionBy("trip", "kind").orderBy(*(order or []), "item_id")
    ranked = packed.withColumn("kind", kind).withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    take = F.col("take_other")
    for slot, name in SLOTS.items():
        take = F.when(F.col("kind") == slot, F.col(f"take_{name}")).otherwise(take)
    return join_same(ranked, plan, ["trip"]).where(F.col("r") <= take).select(*packed.columns)


def capsule(packed: DataFrame, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """trip, tops, bottoms, shoes, items, outfits (their product) from packed items (trip, item_id, slot), or from those that `pack_capsule` takes."""
    if limit is not None:
        packed = pack_capsule(packed, limit, order)
    out = packed.groupBy("trip").agg(*[F.count_if(F.col("slot") == s).alias(n) for s, n in SLOTS.items()], F.count(F.lit(1)).alias("items"))
    return out.withColumn("outfits", F.col("tops") * F.col("bottoms") * F.col("shoes"))


def plan_calendar(events: DataFrame, plans: DataFrame) -> DataFrame:
    """event_id, outfit_id of the best planned outfit (highest score, then least id), null for an event with none."""
    best = plans.groupBy("event_id").agg(F.max_by("outfit_id", F.struct("score", -F.col("outfit_id"))).alias("outfit_id"))
    return events.select("event_id").join(best, "event_id", "left")


def unplanned(events: DataFrame, plans: DataFrame) -> DataFrame:
    return events.join(plans.select("event_id").distinct(), "event_id", "left_anti")
