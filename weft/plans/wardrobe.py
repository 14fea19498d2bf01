"""Queries over wardrobe items, wears and style."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import itemtable, pages
from weft.operators import wardrobe as W
from weft.plans.fixtures import purchases, view
from weft.storage import scratch_folder, stored

AS_OF = "2024-02-01"


def _patches(spark, d):
    """One patch an item from the garment of the same number."""
    g = view(spark, d, "garments")
    return g.select(F.col("garment_id").alias("item_id"), *[F.when(F.col("garment_id") % k != 0, F.col(a)).alias(a) for k, a in ((3, "category"), (5, "color"), (7, "pattern"), (4, "style"), (6, "material"))], *[F.col(f"{a}_conf") for a in ("category", "pattern", "style", "material")])


def flattened_items(spark, d):
    g = view(spark, d, "garments")
    parts = {a: F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("value"), F.col(f"{a}_conf").alias("confidence"), F.lit("zero_shot").alias("source"))) for a in ("category", "material", "pattern", "style")}
    flat = W.flatten_item(g.select("garment_id", *[c.alias(a) for a, c in parts.items()]), list(parts))
    return flat.select("garment_id", *[f"{a}_{k}" for a in parts for k in ("value", "confidence")])


def wardrobe_patches(spark, d):
    g = view(spark, d, "garments").withColumn("secondary", F.when(F.col("garment_id") % 2 == 0, F.array("zero_shot_color")).otherwise(F.array().cast("array<string>")))
    out = W.wardrobe_patch(g)
    conf = F.array_join(F.array_sort(F.map_keys("confidence_by_attribute")), ",")
    return out.select("garment_id", F.array_join("secondary_colors", ",").alias("secondary_colors"), conf.alias("told"), F.round(F.try_element_at("confidence_by_attribute", F.lit("style")), 4).alias("style_conf"))


def result_warnings(spark, d):
    g = view(spark, d, "garments")
    item = F.struct(F.col("garment_id").cast("string").alias("id"), (F.col("category_conf") < 0.3).alias("needs_review"), F.when(F.col("seg_filled"), F.array(F.lit("occluded_garment"))).otherwise(F.array().cast("array<string>")).alias("review_reason"))
    results = g.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("seg_quality").alias("q"))
    results = results.select("image_id", F.lit(True).alias("success"), F.lit(None).cast("string").alias("reason"), (F.col("q") >= 0.05).alias("usable"), "items")
    return W.result_warnings(results).select("image_id", F.array_join("warnings", " | ").alias("warnings"))


def merged_items(spark, d):
    items = view(spark, d, "items").withColumn("corrected", F.when(F.col("item_id") % 10 == 0, F.array(F.lit("color"), F.lit("style"))).otherwise(F.array().cast("array<string>")))
    out = W.merge_patches(items.select("item_id", *W.MERGED, "corrected"), _patches(spark, d))
    return out.select("item_id", *W.MERGED)


def merged_table(spark, d):
    """The same items as a table on disk, into which the patches are merged."""
    items = view(spark, d, "items").withColumn("corrected", F.when(F.col("item_id") % 10 == 0, F.array(F.lit("color"), F.lit("style"))).otherwise(F.array().cast("array<string>")))
    with scratch_folder(spark) as folder:
        itemtable.write_items(items.select("item_id", *W.MERGED, "corrected"), f"{folder}/items", 16)
        itemtable.merge_into(spark, f"{folder}/items", _patches(spark, d), buckets=16)
        return stored(itemtable.read_items(spark, f"{folder}/items").select("item_id", *W.MERGED))


def latest_attributes(spark, d):
    e = view(spark, d, "events").select((F.col("event_id") % 500).alias("item_id"), F.col("event_type").alias("name"), F.col("props").alias("value"), F.col("ts").alias("updated_at"))
    return W.latest_values(e).select("item_id", "name", "value")


def item_search(spark, d):
    return W.search_items(view(spark, d, "items"), "  BL ", "All").select("item_id", "category")


def item_search_category(spark, d):
    return W.search_items(view(spark, d, "items"), "casual", "jeans").select("item_id")


def item_search_indexed(spark, d):
    """A search through the trigrams of all items."""
    items = view(spark, d, "items")
    with scratch_folder(spark) as folder:
        itemtable.write_search_index(items, f"{folder}/grams")
        return stored(itemtable.search_indexed(items, spark.read.parquet(f"{folder}/grams"), " Street ").select("item_id", "style"))


def item_page(spark, d):
    rows, info = pages.page_of(view(spark, d, "items"), ["user_id", "item_id"], 3, 25)
    return rows.select("item_id", F.lit(info["total"]).cast("long").alias("total"), F.lit(info["has_next"]).alias("has_next"))


def wear_event_page(spark, d):
    """A page in the middle of all wears, by its number; its range is found without sorting what lies before it."""
    wears = view(spark, d, "wear_events").select("item_id", "event_id")
    middle = wears.count() // 2 // 50 + 1
    return pages.page_of(wears, ["item_id", "event_id"], middle, 50)[0]


def wear_event_next_page(spark, d):
    """The page that follows the latest wear."""
    wears = view(spark, d, "wear_events").select("item_id", "event_id")
    last = wears.agg(F.expr("max_by(item_id, event_id)"), F.max("event_id")).first()
    return pages.page_after(wears, ["item_id", "event_id"], tuple(last), 100)


def active_item_counts(spark, d):
    return W.active_items(view(spark, d, "items")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def wear_counters(spark, d):
    return W.with_counters(view(spark, d, "items"), view(spark, d, "wear_events")).select("item_id", "times_worn", F.date_format("last_worn_at", "yyyy-MM-dd HH:mm:ss").alias("last_worn_at"))


def counter_drift(spark, d):
    fresh = W.wear_counters(view(spark, d, "wear_events"))
    stored = fresh.withColumn("times_worn", F.when(F.col("item_id") % 9 == 0, F.col("times_worn") + 1).otherwise(F.col("times_worn"))).where("item_id % 13 <> 0")
    return W.counter_drift(stored, fresh, "item_id", ["times_worn"])


def stat_strip(spark, d):
    return W.stat_strip(view(spark, d, "items"))


def most_worn(spark, d):
    return W.most_worn(view(spark, d, "items"), view(spark, d, "wear_events")).withColumn("rank", F.col("rank").cast("long"))


def unworn_items(spark, d):
    return W.unworn_since(view(spark, d, "items"), view(spark, d, "wear_events"), AS_OF, 10).select("item_id", "times_worn")


def cost_per_wear(spark, d):
    return W.cost_per_wear(view(spark, d, "items"), view(spark, d, "wear_events")).select("item_id", "times_worn", F.round("cost_per_wear", 4).alias("cost_per_wear"))


def style_shares(spark, d):
    return W.style_shares(view(spark, d, "items"))


def color_palettes(spark, d):
    return W.color_palette(view(spark, d, "items"))


def category_mix(spark, d):
    return view(spark, d, "items").groupBy("category", "color_family").agg(F.count(F.lit(1)).alias("n"))


def style_evolution(spark, d):
    months = view(spark, d, "lineitem").withColumn("l_shipdate", F.to_date(F.date_trunc("month", "l_shipdate")))  # before the joins: a month is shorter than a time
    scored = purchases(spark, d, months, last="orders").select("user_id", F.col("purchased_on").alias("at"), F.col("price").alias("score"))
    return W.style_evolution(scored, 6).select("user_id", F.col("month").cast("string").alias("month"), F.floor("score").alias("score"))


def _signals(spark, d):
    e = view(spark, d, "events")
    return e.select((F.col("user_id") % 50).alias("user_id"), F.col("event_type").alias("preference"), (F.col("event_id") % 5 / 4).alias("signal"), F.when(F.col("event_id") % 2 == 0, "wear_history").otherwise("chat").alias("source"), F.col("ts").alias("at"))


def style_memory(spark, d):
    return W.style_memory(_signals(spark, d)).select("user_id", "preference", F.round("value", 6).alias("value"), "observations", F.round("confidence", 6).alias("confidence"), "source")


def style_memory_merge(spark, d):
    s = _signals(spark, d)
    old = W.style_memory(s.where("preference in ('view', 'click')"))
    out = W.merge_style_memory(old, W.style_memory(s.where("preference <> 'view'")))
    return out.select("user_id", "preference", F.round("value", 6).alias("value"), "observations", F.round("confidence", 6).alias("confidence"))


def recently_added(spark, d):
    return W.recently_added(view(spark, d, "items"), "price", 4).select("user_id", "item_id", F.col("rank").cast("long").alias("rank"))


def decoded_lists(spark, d):
    e = view(spark, d, "events").withColumn("l", text.decode_list(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat_ws(",", "event_type", F.col("user_id").cast("string")))))
    return e.select("event_id", F.size("l").alias("n"), F.try_element_at("l", F.lit(2)).alias("second"))


def decoded_json(spark, d):
    return view(spark, d, "events").select("event_id", text.decode_json(F.col("props"), "k long")["k"].alias("k"))


_COUNT = "c AS (SELECT item_id, count(*) AS times_worn, max(worn_at) AS last_worn_at FROM wear_events GROUP BY 1)"
_PATCH = "p AS (SELECT garment_id AS item_id, CASE WHEN garment_id % 3 <> 0 THEN category END AS category, CASE WHEN garment_id % 5 <> 0 THEN color END AS color, CASE WHEN garment_id % 7 <> 0 THEN pattern END AS pattern, CASE WHEN garment_id % 4 <> 0 THEN style END AS style, CASE WHEN garment_id % 6 <> 0 THEN material END AS material, category_conf, pattern_conf, style_conf, material_conf FROM garments)"
_SIGNAL = "s AS (SELECT user_id % 50 AS user_id, event_type AS preference, event_id % 5 / 4.0 AS signal, CASE WHEN event_id % 2 = 0 THEN 'wear_history' ELSE 'chat' END AS source, ts AS seen FROM events)"
_OLD = "t AS (SELECT user_id, preference, avg(signal) AS v, count(*) AS n FROM s {w} GROUP BY 1, 2)"

QUERIES = {
    flattened_items: "SELECT garment_id, " + ", ".join(f"{a} AS {a}_value, CASE WHEN {a} IS NULL THEN 0 ELSE {a}_conf END AS {a}_confidence" for a in ("category", "material", "pattern", "style")) + " FROM garments",
    wardrobe_patches: """SELECT garment_id, CASE WHEN garment_id % 2 = 0 THEN zero_shot_color END AS secondary_colors,
      concat_ws(',', CASE WHEN category IS NOT NULL THEN 'category' END, CASE WHEN material IS NOT NULL THEN 'material' END, CASE WHEN pattern IS NOT NULL THEN 'pattern' END, CASE WHEN style IS NOT NULL THEN 'style' END) AS told,
      CASE WHEN style IS NOT NULL THEN round(style_conf, 4) END AS style_conf FROM garments""",
    result_warnings: """WITH r AS (SELECT image_id, min(seg_quality) AS q, string_agg('item ' || garment_id || ' needs review' || CASE WHEN seg_filled THEN ': occluded_garment' ELSE '' END, ' | ' ORDER BY CAST(garment_id AS VARCHAR)) FILTER (category_conf < 0.3) AS w FROM garments GROUP BY 1)
      SELECT image_id, concat_ws(' | ', CASE WHEN q < 0.05 THEN 'image quality was below the usable threshold' END, w) AS warnings FROM r""",
    merged_items: f"""WITH {_PATCH} SELECT i.item_id, coalesce(CASE WHEN category_conf >= 0.2 THEN p.category END, i.category) AS category, coalesce(CASE WHEN i.item_id % 10 <> 0 THEN p.color END, i.color) AS color,
        coalesce(CASE WHEN pattern_conf >= 0.2 THEN p.pattern END, i.pattern) AS pattern, coalesce(CASE WHEN style_conf >= 0.2 AND i.item_id % 10 <> 0 THEN p.style END, i.style) AS style, coalesce(CASE WHEN material_conf >= 0.2 THEN p.material END, i.material) AS material
      FROM items i LEFT JOIN p ON p.item_id = i.item_id
      UNION ALL SELECT item_id, CASE WHEN category_conf >= 0.2 THEN category END, color, CASE WHEN pattern_conf >= 0.2 THEN pattern END, CASE WHEN style_conf >= 0.2 THEN style END, CASE WHEN material_conf >= 0.2 THEN material END FROM p WHERE item_id NOT IN (SELECT item_id FROM items)""",
    merged_table: f"""WITH {_PATCH} SELECT i.item_id, coalesce(CASE WHEN category_conf >= 0.2 THEN p.category END, i.category) AS category, coalesce(CASE WHEN i.item_id % 10 <> 0 THEN p.color END, i.color) AS color,
        coalesce(CASE WHEN pattern_conf >= 0.2 THEN p.pattern END, i.pattern) AS pattern, coalesce(CASE WHEN style_conf >= 0.2 AND i.item_id % 10 <> 0 THEN p.style END, i.style) AS style, coalesce(CASE WHEN material_conf >= 0.2 THEN p.material END, i.material) AS material
      FROM items i LEFT JOIN p ON p.item_id = i.item_id
      UNION ALL SELECT item_id, CASE WHEN category_conf >= 0.2 THEN category END, color, CASE WHEN pattern_conf >= 0.2 THEN pattern END, CASE WHEN style_conf >= 0.2 THEN style END, CASE WHEN material_conf >= 0.2 THEN material END FROM p WHERE item_id NOT IN (SELECT item_id FROM items)""",
    latest_attributes: """WITH r AS (SELECT event_id % 500 AS item_id, event_type AS name, props AS value, row_number() OVER (PARTITION BY event_id % 500, event_type ORDER BY ts DESC, props DESC) AS k FROM events) SELECT item_id, name, value FROM r WHERE k = 1""",
    item_search: "SELECT item_id, category FROM items WHERE lower(name) LIKE '%bl%' OR lower(color) LIKE '%bl%' OR lower(style) LIKE '%bl%'",
    item_search_indexed: "SELECT item_id, style FROM items WHERE lower(name) LIKE '%street%' OR lower(color) LIKE '%street%' OR lower(style) LIKE '%street%'",
    item_search_category: "SELECT item_id FROM items WHERE category = 'jeans' AND (lower(name) LIKE '%casual%' OR lower(color) LIKE '%casual%' OR lower(style) LIKE '%casual%')",
    wear_event_page: "WITH r AS (SELECT item_id, event_id, row_number() OVER (ORDER BY item_id, event_id) - 1 AS place, count(*) OVER () AS n FROM wear_events) SELECT item_id, event_id FROM r WHERE place // 50 = n // 2 // 50",
    wear_event_next_page: "WITH l AS (SELECT item_id AS i, event_id AS e FROM wear_events ORDER BY event_id DESC LIMIT 1) SELECT item_id, event_id FROM wear_events, l WHERE item_id > i OR (item_id = i AND event_id > e) ORDER BY item_id, event_id LIMIT 100",
    item_page: "SELECT item_id, (SELECT count(*) FROM items) AS total, (SELECT count(*) FROM items) > 75 AS has_next FROM items ORDER BY user_id, item_id LIMIT 25 OFFSET 50",
    active_item_counts: "SELECT user_id, count(*) AS n FROM items WHERE status = 'active' GROUP BY 1",
    wear_counters: f"WITH {_COUNT} SELECT i.item_id, coalesce(times_worn, 0) AS times_worn, strftime(last_worn_at, '%Y-%m-%d %H:%M:%S') AS last_worn_at FROM items i LEFT JOIN c ON c.item_id = i.item_id",
    counter_drift: f"WITH {_COUNT} SELECT item_id, 'times_worn' AS counter, CASE WHEN item_id % 13 <> 0 THEN CAST(times_worn + 1 AS VARCHAR) END AS stored, CAST(times_worn AS VARCHAR) AS recomputed FROM c WHERE item_id % 9 = 0 OR item_id % 13 = 0",
    stat_strip: "SELECT user_id, category, count(*) AS n FROM items GROUP BY ROLLUP (user_id, category)",
    most_worn: f"WITH {_COUNT}, r AS (SELECT i.user_id, i.item_id, times_worn, row_number() OVER (PARTITION BY i.user_id ORDER BY times_worn DESC, i.item_id) AS rank FROM items i JOIN c ON c.item_id = i.item_id) SELECT * FROM r WHERE rank <= 3",
    unworn_items: f"WITH {_COUNT} SELECT i.item_id, coalesce(times_worn, 0) AS times_worn FROM items i LEFT JOIN c ON c.item_id = i.item_id WHERE last_worn_at IS NULL OR CAST(last_worn_at AS DATE) < DATE '{AS_OF}' - 10",
    cost_per_wear: f"WITH {_COUNT} SELECT i.item_id, coalesce(times_worn, 0) AS times_worn, round(price / times_worn, 4) AS cost_per_wear FROM items i LEFT JOIN c ON c.item_id = i.item_id",
    style_shares: """WITH n AS (SELECT user_id, style, count(*) AS n FROM items GROUP BY 1, 2) SELECT user_id, style, n, round(100 * n / sum(n) OVER (PARTITION BY user_id), 2) AS percent,
      row_number() OVER (PARTITION BY user_id ORDER BY n DESC, style) = 1 AS dominant FROM n""",
    color_palettes: "WITH n AS (SELECT user_id, color, count(*) AS n FROM items GROUP BY 1, 2) SELECT user_id, string_agg(color || ':' || n, ',' ORDER BY n DESC, color) AS palette FROM n GROUP BY 1",
    category_mix: "SELECT category, color_family, count(*) AS n FROM items GROUP BY 1, 2",
    style_evolution: """WITH b AS (SELECT user_id, CAST(date_trunc('month', purchased_on) AS DATE) AS month, avg(price) AS score FROM purchases GROUP BY 1, 2), l AS (SELECT user_id, max(month) AS last FROM b GROUP BY 1),
      s AS (SELECT user_id, CAST(last - to_months(CAST(k AS INT)) AS DATE) AS month FROM l, range(6) r(k)) SELECT s.user_id, CAST(s.month AS VARCHAR) AS month, CAST(floor(b.score) AS BIGINT) AS score FROM s LEFT JOIN b ON b.user_id = s.user_id AND b.month = s.month""",
    style_memory: f"WITH {_SIGNAL} SELECT user_id, preference, round(avg(signal), 6) AS value, count(*) AS observations, round(1 - 1 / (1 + count(*)), 6) AS confidence, arg_max(source, row(seen, source)) AS source FROM s GROUP BY 1, 2",
    style_memory_merge: f"""WITH {_SIGNAL}, b AS (SELECT user_id, preference, avg(signal) AS v, count(*) AS n FROM s WHERE preference IN ('view', 'click') GROUP BY 1, 2 UNION ALL SELECT user_id, preference, avg(signal), count(*) FROM s WHERE preference <> 'view' GROUP BY 1, 2)
      SELECT user_id, preference, round(sum(v * n) / sum(n), 6) AS value, CAST(sum(n) AS BIGINT) AS observations, round(1 - 1 / (1 + sum(n)), 6) AS confidence FROM b GROUP BY 1, 2""",
    recently_added: "WITH r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY price DESC, item_id DESC) AS rank FROM items) SELECT * FROM r WHERE rank <= 4",
    decoded_lists: "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS second FROM events",
    decoded_json: "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events",
}
