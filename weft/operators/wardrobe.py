"""Wardrobe items: projection of results, merging, search, counters and insight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.scoring import storable
from weft.functions.text import matches_search

MERGED = ["category", "color", "pattern", "style", "material"]


def flatten_item(df: DataFrame, attributes: list[str]) -> DataFrame:
    """Each attribute struct<value, confidence, source> as name_value and name_confidence; an omitted one is null with confidence 0."""
    return df.withColumns({f"{a}_value": F.col(f"{a}.value") for a in attributes} | {f"{a}_confidence": F.coalesce(F.col(f"{a}.confidence"), F.lit(0.0)) for a in attributes})


def confidence_by_attribute(names: list[str]) -> Column:
    """Map name -> confidence of the attributes with a value (colour has none)."""
    entries = F.array(*[F.struct(F.lit(a).alias("key"), F.col(f"{a}_conf").alias("value")) for a in names])
    values = F.array(*[F.col(a) for a in names])
    return F.map_from_entries(F.filter(entries, lambda x, i: F.get(values, i).isNotNull()))


def wardrobe_patch(df: DataFrame) -> DataFrame:
    """Adds secondary_colors (null if empty) and confidence_by_attribute."""
    secondary = F.when(F.size("secondary") > 0, F.col("secondary"))
    return df.withColumn("secondary_colors", secondary).withColumn("confidence_by_attribute", confidence_by_attribute(["category", "pattern", "style", "material"]))


def result_warnings(df: DataFrame) -> DataFrame:
    """Adds warnings: no items and no reason, an unusable image, each item to review with its reasons.

    df: success, reason, usable, items array<struct<id, needs_review, review_reason array>>.
    """
    none = F.when(~F.col("success") & (F.coalesce("reason", F.lit("")) == ""), "no items and no reason were returned")
    image = F.when(~F.coalesce("usable", F.lit(True)), "image quality was below the usable threshold")
    reasons = lambda x: F.when(F.size(x["review_reason"]) > 0, F.concat(F.lit(": "), F.array_join(x["review_reason"], ", "))).otherwise("")
    review = F.transform(F.filter("items", lambda x: x["needs_review"]), lambda x: F.concat(F.lit("item "), x["id"], F.lit(" needs review"), reasons(x)))
    return df.withColumn("warnings", F.concat(F.filter(F.array(none, image), lambda x: x.isNotNull()), F.coalesce(review, F.array().cast("array<string>"))))


def merge_patches(items: DataFrame, patches: DataFrame, floor: float = 0.2) -> DataFrame:
    """Items with their patches merged in, and new items.

    A patch's value counts if it is not null, its confidence can be stored and the
    attribute was not corrected by the user.  items: item_id, MERGED, corrected (array of
    names); patches: item_id, MERGED, name_conf (colour needs none), at most one an item.
    """
    named = patches.select("item_id", *[F.col(a).alias(f"new_{a}") for a in MERGED], *[F.col(f"{a}_conf").alias(f"conf_{a}") for a in MERGED if a != "color"])
    joined = items.join(named, "item_id", "left")
    merged = {}
    for a in MERGED:
        strong = F.lit(True) if a == "color" else storable(F.col(f"conf_{a}"), floor)
        free = ~F.coalesce(F.array_contains("corrected", a), F.lit(False))
        merged[a] = F.coalesce(F.when(strong & free, F.col(f"new_{a}")), F.col(a))
    kept = joined.withColumns(merged).select(items.columns)
    fresh = named.join(items.select("item_id"), "item_id", "left_anti")
    rows = {a: F.when(F.lit(True) if a == "color" else storable(F.col(f"conf_{a}"), floor), F.col(f"new_{a}")) for a in MERGED}
    new = fresh.select("item_id", *[c.alias(a) for a, c in rows.items()], F.array().cast("array<string>").alias("corrected"))
    return kept.unionByName(new, allowMissingColumns=True)


def latest_values(attributes: DataFrame) -> DataFrame:
    """item_id, name, value, updated_at: the latest value of each attribute; the greater value on a tie."""
    best = F.max_by(F.struct("value", "updated_at"), F.struct("updated_at", "value")).alias("v")
    return attributes.groupBy("item_id", "name").agg(best).select("item_id", "name", "v.*")


def search_items(items: DataFrame, query: str = "", category: str = "All") -> DataFrame:
    """Items whose name, colour or style contains the query, of one category (All: any)."""
    found = items.where(matches_search(query, F.col("name"), F.col("color"), F.col("style")))
    return found if category == "All" else found.where(F.col("category") == category)


def active_items(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") == "active")


def wear_counters(wears: DataFrame) -> DataFrame:
    """item_id, times_worn, last_worn_at."""
    return wears.groupBy("item_id").agg(F.count(F.lit(1)).alias("times_worn"), F.max("worn_at").alias("last_worn_at"))


def with_counters(items: DataFrame, wears: DataFrame) -> DataFrame:
    return items.join(wear_counters(wears), "item_id", "left").withColumn("times_worn", F.coalesce("times_worn", F.lit(0)))


def counter_drift(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, counter, stored, recomputed where they differ; a missing row counts as null."""
    a = stored.select(key, *[F.col(c).alias(f"s_{c}") for c in columns])
    b = fresh.select(key, *[F.col(c).alias(f"f_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(f"s_{c}").cast("string").alias("stored"), F.col(f"f_{c}").cast("string").alias("recomputed")) for c in columns])
    return a.join(b, key, "full").select(key, F.explode(pairs).alias("d")).select(key, "d.*").where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def stat_strip(items: DataFrame) -> DataFrame:
    """user_id, category, n by category, by user (category null) and overall (both null)."""
    return items.rollup("user_id", "category").agg(F.count(F.lit(1)).alias("n"))


def most_worn(items: DataFrame, wears: DataFrame, k: int = 3) -> DataFrame:
    worn = with_counters(items, wears).where("times_worn > 0")
    w = Window.partitionBy("user_id").orderBy(F.desc("times_worn"), "item_id")
    return worn.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("user_id", "item_id", "times_worn", "rank")


def unworn_since(items: DataFrame, wears: DataFrame, as_of: str, days: int = 60, created: str | None = None) -> DataFrame:
    """Items whose last wear (or creation, if never worn) is earlier than as_of - days; never worn without a creation date counts."""
    last = F.coalesce(F.to_date("last_worn_at"), F.to_date(created) if created else F.lit(None).cast("date"))
    limit = F.date_sub(F.to_date(F.lit(as_of)), days)
    return with_counters(items, wears).withColumn("last_used", last).where(F.col("last_used").isNull() | (F.col("last_used") < limit))


def cost_per_wear(items: DataFrame, wears: DataFrame) -> DataFrame:
    """item_id, price, times_worn, cost_per_wear (null if never worn)."""
    return with_counters(items, wears).select("item_id", "price", "times_worn", (F.col("price") / F.nullif(F.col("times_worn"), F.lit(0))).alias("cost_per_wear"))


def style_shares(items: DataFrame) -> DataFrame:
    """user_id, style, n, percent, dominant (the most frequent style, first by name on a tie)."""
    counts = items.where("style is not null").groupBy("user_id", "style").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id")
    ranked = counts.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "style")))
    return ranked.select("user_id", "style", "n", F.round(100 * F.col("n") / F.sum("n").over(w), 2).alias("percent"), (F.col("r") == 1).alias("dominant"))


def color_palette(items: DataFrame) -> DataFrame:
    """user_id, palette: colours by count, then name, as `name:count` texts."""
    counts = items.groupBy("user_id", "color").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "color")))
    return counts.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["color"], (-x["k"]).cast("string"))), ",").alias("palette"))


def style_evolution(scored: DataFrame, months: int = 6) -> DataFrame:
    """user_id, month, score: the mean of the last `months` months up to each user's latest, months without rows included."""
    by = scored.groupBy("user_id", F.to_date(F.date_trunc("month", "at")).alias("month")).agg(F.avg("score").alias("score")).where("month is not null")
    latest = Window.partitionBy("user_id").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, 0)
    recent = by.withColumn("last", F.max("month").over(latest)).where(F.col("month") >= F.add_months("last", -(months - 1)))
    told = recent.groupBy("user_id").agg(F.max("last").alias("last"), F.map_from_entries(F.collect_list(F.struct("month", "score"))).alias("scores"))
    spine = told.select("user_id", "scores", F.explode(F.sequence(F.add_months("last", -(months - 1)), F.col("last"), F.expr("interval 1 month"))).alias("month"))
    return spine.select("user_id", "month", F.when(F.col("user_id").isNotNull(), F.try_element_at("scores", F.col("month"))).alias("score"))


def style_memory(signals: DataFrame) -> DataFrame:
    """user_id, preference, value (mean), observations, confidence 1 - 1/(1+n), source of the latest signal."""
    n = F.count(F.lit(1))
    return signals.groupBy("user_id", "preference").agg(F.avg("signal").alias("value"), n.alias("observations"), (1 - 1 / (1 + n)).alias("confidence"), F.max_by("source", F.struct("at", "source")).alias("source"))


def merge_style_memory(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and new memories of a preference as one: means weighted by observations, the new source."""
    both = stored.withColumn("age", F.lit(0)).unionByName(fresh.withColumn("age", F.lit(1)))
    n = F.sum("observations")
    return both.groupBy("user_id", "preference").agg((F.sum(F.col("value") * F.col("observations")) / n).alias("value"), n.alias("observations"), (1 - 1 / (1 + n)).alias("confidence"), F.max_by("source", "age").alias("source"))


def recently_added(items: DataFrame, order: str, k: int = 4) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc(order), F.desc("item_id"))
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
