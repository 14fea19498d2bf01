"""Outfits: completeness, scores, recommendations, candidates, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.color import NEUTRAL_FAMILIES
from weft.functions.rules import CONTRAST_CONFLICTS

REQUIRED = ["top", "bottom", "shoes"]
#: Weight of each factor of the match score.
FACTORS = {
    "color_harmony": 0.16, "style_compatibility": 0.13, "occasion_fit": 0.14, "weather_match": 0.12, "season_match": 0.08, "personal_preference": 0.14,
    "body_fit_preference": 0.06, "recent_usage": 0.06, "wardrobe_availability": 0.05, "trend_compatibility": 0.03, "user_feedback": 0.03,
}


def completeness(outfit_items: DataFrame) -> DataFrame:
    """outfit_id, missing (required slots without an item, in order), complete."""
    slots = outfit_items.groupBy("outfit_id").agg(F.collect_set("slot").alias("slots"))
    missing = F.array_except(F.array(*[F.lit(s) for s in REQUIRED]), F.col("slots"))
    return slots.select("outfit_id", missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def slot_conflicts(outfit_items: DataFrame) -> DataFrame:
    """outfit_id, slot, n of slots with more than one item."""
    return outfit_items.groupBy("outfit_id", "slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def layer_order(outfit_items: DataFrame) -> DataFrame:
    """outfit_id, slots: an outfit's slots from the innermost layer out; of equal layers by slot, a null layer counts as 0."""
    order = F.struct(F.coalesce("layer_order", F.lit(0)).alias("layer"), F.col("slot").alias("slot"))
    return outfit_items.groupBy("outfit_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["slot"]).alias("slots"))


def outfits_per_item(outfit_items: DataFrame) -> DataFrame:
    return outfit_items.groupBy("item_id").agg(F.count_distinct("outfit_id").alias("n_outfits"))


def pair_harmony(a: Column, b: Column) -> Column:
    """Harmony of two colour families."""
    clash = F.lit(False)
    for x, y in CONTRAST_CONFLICTS:
        clash = clash | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return F.when(a == b, 1.0).when(a.isin(NEUTRAL_FAMILIES) | b.isin(NEUTRAL_FAMILIES), 0.8).when(clash, 0.0).otherwise(0.5)


def mean_harmony(families: Column) -> Column:
    """Mean harmony of the unordered pairs of an array of families; null for fewer than two."""
    size = F.size(families)
    later = lambda i: F.slice(families, i + 2, F.greatest(size - i - 1, F.lit(0)))
    pairs = F.flatten(F.transform(families, lambda x, i: F.transform(later(i), lambda y: pair_harmony(x, y))))
    return F.when(size > 1, F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / F.size(pairs))


def color_harmony(outfit_items: DataFrame) -> DataFrame:
    """outfit_id, value: mean harmony of the unordered item pairs, made inside one row of families; null for one item.

    An outfit has at most one item a slot, so the array is short.
    """
    one = outfit_items.groupBy("outfit_id").agg(F.array_sort(F.collect_list("color_family")).alias("f"))
    return one.select("outfit_id", mean_harmony(F.col("f")).alias("value"))


def style_compatibility(outfit_items: DataFrame) -> DataFrame:
    """outfit_id, value: share of the items with the outfit's most frequent style."""
    counts = outfit_items.groupBy("outfit_id", "style").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("outfit_id").agg((F.max("n") / F.sum("n")).alias("value"))


def personal_preference(outfit_items: DataFrame, liked: DataFrame) -> DataFrame:
    """outfit_id, value: mean over items of 1 for a preferred colour, 0 for an avoided one, else 0.5.

    liked: user_id, color, preferred boolean.
    """
    joined = outfit_items.join(liked, ["user_id", "color"], "left")
    return joined.groupBy("outfit_id").agg(F.avg(F.when(F.col("preferred"), 1.0).when(~F.col("preferred"), 0.0).otherwise(0.5)).alias("value"))


def recent_usage(outfit_items: DataFrame, counters: DataFrame, as_of: str) -> DataFrame:
    """outfit_id, value: mean over items of days since the last wear over 14, at most 1; never worn is 1."""
    days = F.datediff(F.to_date(F.lit(as_of)), F.to_date("last_worn_at"))
    joined = outfit_items.join(counters, "item_id", "left")
    return joined.groupBy("outfit_id").agg(F.avg(F.coalesce(F.least(F.lit(1.0), days / 14), F.lit(1.0))).alias("value"))


def availability(outfit_items: DataFrame) -> DataFrame:
    return outfit_items.groupBy("outfit_id").agg(F.avg((F.col("status") == "active").cast("double")).alias("value"))


def user_feedback(feedback: DataFrame) -> DataFrame:
    """outfit_id, value: mean rating / 5, else likes / (likes + dislikes), else null."""
    likes, dislikes = F.count_if(F.col("type") == "liked"), F.count_if(F.col("type") == "disliked")
    return feedback.groupBy("outfit_id").agg(F.coalesce(F.avg("rating") / 5, likes / F.nullif(likes + dislikes, F.lit(0))).alias("value"))


def item_factors(outfit_items: DataFrame, liked: DataFrame, counters: DataFrame, as_of: str) -> DataFrame:
    """outfit_id and five factors of the match score, each as its own function has it, in one grouping.

    outfit_items: outfit_id, item_id, user_id, color, color_family, style, status; liked: user_id, color, preferred; counters: item_id, last_worn_at.
    """
    rows = outfit_items.join(liked.select("user_id", "color", "preferred"), ["user_id", "color"], "left").join(counters.select("item_id", "last_worn_at"), "item_id", "left")
    days = F.datediff(F.to_date(F.lit(as_of)), F.to_date("last_worn_at"))
    one = rows.groupBy("outfit_id").agg(
        F.array_sort(F.collect_list("color_family")).alias("f"), F.collect_list(F.coalesce("style", F.lit(""))).alias("s"),
        F.avg(F.when(F.col("preferred"), 1.0).when(~F.col("preferred"), 0.0).otherwise(0.5)).alias("personal_preference"),
        F.avg(F.coalesce(F.least(F.lit(1.0), days / 14), F.lit(1.0))).alias("recent_usage"), F.avg((F.col("status") == "active").cast("double")).alias("wardrobe_availability"),
    )
    most = F.array_max(F.transform(F.array_distinct("s"), lambda x: F.size(F.filter("s", lambda y: y == x))))
    return one.select("outfit_id", mean_harmony(F.col("f")).alias("color_harmony"), (most / F.size("s")).alias("style_compatibility"), "personal_preference", "recent_usage", "wardrobe_availability")


def match_score(factors: DataFrame) -> DataFrame:
    """outfit_id, score 0..100 from long rows (outfit_id, factor, value in 0..1); missing factors drop out and the weights are scaled."""
    weights = F.create_map(*[F.lit(x) for item in FACTORS.items() for x in item])
    told = factors.where("value is not null").withColumn("w", F.try_element_at(weights, F.col("factor")))
    share = F.sum(F.col("w") * F.col("value")) / F.sum("w")
    return told.groupBy("outfit_id").agg(F.floor(F.round(100 * share, 9) + 0.5).cast("int").alias("score"))


def recommend(scored: DataFrame, now: str, min_score: int = 55, k: int = 12) -> DataFrame:
    """The k best outfits of each user that score enough and have not expired."""
    fit = scored.where((F.col("score") >= min_score) & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "outfit_id")
    return fit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidate_outfits(items: DataFrame, per_slot: int = 40, order: list[Column] | None = None) -> DataFrame:
    """user_id, top, bottom, shoes: every combination of a user's `per_slot` first active items of each slot, in the caller's `order`, then by id.

    The number of items a slot is the feature's own limit: it bounds the product of one user.
    """
    w = Window.partitionBy("user_id", "slot").orderBy(*(order or []), "item_id")
    first = items.where((F.col("status") == "active") & F.col("slot").isin(REQUIRED)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_slot)
    parts = [first.where(F.col("slot") == s).select("user_id", F.col("item_id").alias(s)) for s in REQUIRED]
    return parts[0].join(parts[1], "user_id").join(parts[2], "user_id")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """outfit_id, liked, disliked, worn, rated, mean_rating."""
    return feedback.groupBy("outfit_id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in ("liked", "disliked", "worn", "rated")], F.avg("rating").alias("mean_rating"))


def wardrobe_gaps(items: DataFrame) -> DataFrame:
    """user_id, slot: required slots in which a user has no active item."""
    spine = items.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(s) for s in REQUIRED])).alias("slot"))
    return spine.join(items.where("status = 'active'").select("user_id", "slot").distinct(), ["user_id", "slot"], "left_anti")


def formality_cube(items: DataFrame) -> DataFrame:
    """user_id, category, style, n over all groupings of category and style within a user."""
    return items.groupingSets([["user_id", "category", "style"], ["user_id", "category"], ["user_id", "style"], ["user_id"]], "user_id", "category", "style").agg(F.count(F.lit(1)).alias("n"))


def imbalance_alerts(items: DataFrame) -> DataFrame:
    """user_id, category, casual, formal where a category is casual (4 or more) with hardly a formal item (1 at most)."""
    counts = items.groupBy("user_id", "category").agg(F.count_if(F.col("style") == "casual").alias("casual"), F.count_if(F.col("style") == "formal").alias("formal"))
    return counts.where("casual >= 4 and formal <= 1")
