"""Queries over outfits, recommendations and shopping."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import bestoutfits as B
from weft.operators import outfits as O
from weft.operators import shopping as S
from weft.operators.wardrobe import wear_counters
from weft.plans.fixtures import purchases, view

AS_OF = "2024-02-01"
#: Purchases of which a task sorts so many.
ROWS_A_TASK = 500_000


def _worn(spark, d):
    """Items of outfits with their attributes."""
    return view(spark, d, "outfit_items").select("outfit_id", "slot", "item_id").join(view(spark, d, "items").select("item_id", "user_id", "color", "color_family", "style", "status"), "item_id")


def _feedback(spark, d):
    e = view(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "liked").when(F.col("event_type") == "error", "disliked").when(F.col("event_type") == "view", "worn").otherwise("rated")
    return e.select((F.col("event_id") % 3000).alias("outfit_id"), kind.alias("type"), F.when(kind == "rated", F.col("event_id") % 5 + 1).cast("int").alias("rating"))


def outfit_completeness(spark, d):
    return O.completeness(view(spark, d, "outfit_items")).select("outfit_id", F.array_join("missing", ",").alias("missing"), "complete")


def slot_conflicts(spark, d):
    rows = view(spark, d, "lineitem").select(F.col("l_orderkey").alias("outfit_id"), F.col("l_partkey").alias("item_id")).join(view(spark, d, "items"), "item_id")
    return O.slot_conflicts(rows)


def outfits_per_item(spark, d):
    return O.outfits_per_item(view(spark, d, "outfit_items"))


def color_harmony(spark, d):
    return O.color_harmony(_worn(spark, d)).select("outfit_id", F.round("value", 6).alias("value"))


def style_compatibility(spark, d):
    return O.style_compatibility(_worn(spark, d)).select("outfit_id", F.round("value", 6).alias("value"))


def _liked(spark, d):
    pairs = view(spark, d, "items").select("user_id", "color").distinct()
    return pairs.where("(user_id + length(color)) % 3 <> 0").withColumn("preferred", (F.col("user_id") + F.length("color")) % 3 == 1)


def _wide(spark, d):
    """All factors that the tables tell, one row an outfit: one join and one grouping of its items, and its feedback."""
    told = O.item_factors(_worn(spark, d), _liked(spark, d), wear_counters(view(spark, d, "wear_events")), AS_OF).withColumn("worn", F.lit(True))
    return told.join(O.user_feedback(_feedback(spark, d)).withColumnRenamed("value", "user_feedback").withColumn("rated", F.lit(True)), "outfit_id", "full")


def _factors(spark, d):
    part = lambda name, told: F.when(F.col(told), F.struct(F.lit(name).alias("factor"), F.col(name).cast("double").alias("value")))
    parts = [*(part(n, "worn") for n in ("color_harmony", "style_compatibility", "personal_preference", "recent_usage", "wardrobe_availability")), part("user_feedback", "rated")]
    return _wide(spark, d).select("outfit_id", F.explode(F.array_compact(F.array(*parts))).alias("p")).select("outfit_id", "p.*")


def match_factors(spark, d):
    return _factors(spark, d).select("outfit_id", "factor", F.round("value", 5).alias("value"))


def match_scores(spark, d):
    rounded = _factors(spark, d).withColumn("value", F.round("value", 5))
    return O.match_score(rounded)


def recommendations(spark, d):
    scored = O.match_score(_factors(spark, d).withColumn("value", F.round("value", 5))).join(view(spark, d, "outfits").select("outfit_id", "user_id", F.date_add(F.to_date("created_at"), 400).cast("timestamp").alias("expires_at")), "outfit_id")
    return O.recommend(scored, "1997-01-01 00:00:00").select("user_id", "outfit_id", "score", F.col("rank").cast("long").alias("rank"))


def best_outfits(spark, d):
    """The twelve best of all combinations of each user's items, none left out; an item's own value is made of its warmth and price."""
    items = view(spark, d, "items").withColumn("value", F.expr("(warmth * 7 + CAST(floor(price) AS BIGINT)) % 101"))
    return B.best_outfits(items)


def candidate_outfits(spark, d):
    """The operator's own limit, the cheapest items first; the combinations are many, so they are told by user and top."""
    made = O.candidate_outfits(view(spark, d, "items"), order=[F.col("price")])
    return made.groupBy("user_id", "top").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bottom").alias("bottoms"), F.sum("bottom").alias("bottom_sum"), F.count_distinct("shoes").alias("pairs"), F.sum("shoes").alias("shoe_sum"))


def layers(spark, d):
    rows = view(spark, d, "outfit_items").withColumn("layer_order", F.when(F.col("item_id") % 5 != 0, F.col("item_id") % 3))
    return O.layer_order(rows).select("outfit_id", F.array_join("slots", ",").alias("slots"))


def feedback_summary(spark, d):
    return O.feedback_summary(_feedback(spark, d)).withColumn("mean_rating", F.round("mean_rating", 6))


def wardrobe_gaps(spark, d):
    """Small wardrobes, of at most eight items each, in which gaps occur by themselves."""
    return O.wardrobe_gaps(view(spark, d, "items").withColumn("user_id", F.expr("item_id div 400 * 50 + user_id")))


def formality_sets(spark, d):
    return O.formality_cube(view(spark, d, "items"))


def imbalance_alerts(spark, d):
    rows = view(spark, d, "items").withColumn("style", F.when(F.col("item_id") % 3 == 0, "formal").otherwise("casual"))
    return O.imbalance_alerts(rows.withColumn("category", F.col("slot")))


def shopping_picks(spark, d):
    items = view(spark, d, "items")
    products = items.select(F.col("item_id").alias("product_id"), ((F.col("user_id") + 1) % 50).alias("user_id"), "slot", "color_family")
    return S.completes_outfits(products, items)


def lowest_prices(spark, d):
    p = purchases(spark, d).select(F.col("item_id").alias("product_id"), F.col("purchased_on").alias("seen_at"), "price")
    parts = view(spark, d, "lineitem").count() // ROWS_A_TASK + 1
    low = S.lowest_price(p, parts=parts).repartition(parts, "product_id").sortWithinPartitions("product_id", "seen_at", "price")  # added up in this order, as the mean's last digit depends on it
    return low.groupBy("product_id").agg(F.min("lowest_so_far").alias("least"), F.round(F.avg("lowest_so_far"), 3).alias("mean_low"))


def price_alerts(spark, d):
    p = purchases(spark, d).select(F.col("item_id").alias("product_id"), F.col("purchased_on").alias("seen_at"), "price")
    wishes = view(spark, d, "items").select("user_id", F.col("item_id").alias("product_id"), (F.col("price") * 20).alias("target_price"), (F.col("item_id") % 3 != 0).alias("alert_enabled"), "status")
    return S.price_alerts(wishes, p).select("user_id", "product_id", "price")


def spend(spark, d):
    return S.spend(purchases(spark, d)).withColumns({"total": F.round(F.col("total").cast("double"), 2), "month": F.col("month").cast("string")})


_WORN = "w AS (SELECT o.outfit_id, o.slot, o.item_id, i.user_id, i.color, i.color_family AS f, i.style, i.status FROM outfit_items o JOIN items i ON i.item_id = o.item_id)"
_FB = "fb AS (SELECT event_id % 3000 AS outfit_id, CASE event_type WHEN 'click' THEN 'liked' WHEN 'error' THEN 'disliked' WHEN 'view' THEN 'worn' ELSE 'rated' END AS type, CASE WHEN event_type NOT IN ('click', 'error', 'view') THEN event_id % 5 + 1 END AS rating FROM events)"
_HARM = """hp AS (SELECT a.outfit_id, CASE WHEN a.f = b.f THEN 1.0 WHEN a.f IN ('black', 'white', 'gray', 'beige') OR b.f IN ('black', 'white', 'gray', 'beige') THEN 0.8
    WHEN (least(a.f, b.f), greatest(a.f, b.f)) IN (('blue', 'yellow'), ('purple', 'yellow')) THEN 0.0 ELSE 0.5 END AS h FROM w a JOIN w b ON a.outfit_id = b.outfit_id AND a.slot < b.slot),
harm AS (SELECT o.outfit_id, (SELECT avg(h) FROM hp WHERE hp.outfit_id = o.outfit_id) AS value FROM (SELECT DISTINCT outfit_id FROM w) o)"""
_COMP = "comp AS (SELECT outfit_id, max(n) / sum(n) AS value FROM (SELECT outfit_id, style, count(*) AS n FROM w GROUP BY 1, 2) GROUP BY 1)"
_ALL = f"""{_WORN}, {_FB}, {_HARM}, {_COMP},
cnt AS (SELECT item_id, max(worn_at) AS last FROM wear_events GROUP BY 1),
fac AS (SELECT outfit_id, 'color_harmony' AS factor, value FROM harm UNION ALL SELECT outfit_id, 'style_compatibility', value FROM comp
  UNION ALL SELECT outfit_id, 'personal_preference', avg(CASE (user_id + length(color)) % 3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.5 END) FROM w GROUP BY 1
  UNION ALL SELECT outfit_id, 'recent_usage', avg(coalesce(least(1.0, date_diff('day', CAST(last AS DATE), DATE '{AS_OF}') / 14), 1.0)) FROM w LEFT JOIN cnt ON cnt.item_id = w.item_id GROUP BY 1
  UNION ALL SELECT outfit_id, 'wardrobe_availability', avg(CASE WHEN status = 'active' THEN 1.0 ELSE 0.0 END) FROM w GROUP BY 1
  UNION ALL SELECT outfit_id, 'user_feedback', coalesce(avg(rating) / 5, count(*) FILTER (type = 'liked') / nullif(count(*) FILTER (type IN ('liked', 'disliked')), 0)) FROM fb GROUP BY 1),
rounded AS (SELECT outfit_id, factor, round(value, 5) AS value, CASE factor WHEN 'color_harmony' THEN 0.16 WHEN 'style_compatibility' THEN 0.13 WHEN 'personal_preference' THEN 0.14 WHEN 'recent_usage' THEN 0.06 WHEN 'wardrobe_availability' THEN 0.05 ELSE 0.03 END AS k FROM fac),
score AS (SELECT outfit_id, CAST(floor(round(100 * sum(CAST(k AS DOUBLE) * value) / sum(CAST(k AS DOUBLE)), 9) + 0.5) AS INT) AS score FROM rounded WHERE value IS NOT NULL GROUP BY 1)"""

#: Tenths of harmony of two families.
_HARMONY = "CASE WHEN {a} = {b} THEN 10 WHEN {a} IN ('black', 'white', 'gray', 'beige') OR {b} IN ('black', 'white', 'gray', 'beige') THEN 8 WHEN {a} || '-' || {b} IN ('blue-yellow', 'yellow-blue', 'purple-yellow', 'yellow-purple') THEN 0 ELSE 5 END"

QUERIES = {
    outfit_completeness: """SELECT outfit_id, concat_ws(',', CASE WHEN count(*) FILTER (slot = 'top') = 0 THEN 'top' END, CASE WHEN count(*) FILTER (slot = 'bottom') = 0 THEN 'bottom' END, CASE WHEN count(*) FILTER (slot = 'shoes') = 0 THEN 'shoes' END) AS missing,
      count(DISTINCT slot) FILTER (slot IN ('top', 'bottom', 'shoes')) = 3 AS complete FROM outfit_items GROUP BY 1""",
    slot_conflicts: "SELECT l_orderkey AS outfit_id, slot, count(*) AS n FROM lineitem JOIN items ON item_id = l_partkey GROUP BY 1, 2 HAVING count(*) > 1",
    outfits_per_item: "SELECT item_id, count(DISTINCT outfit_id) AS n_outfits FROM outfit_items GROUP BY 1",
    color_harmony: f"WITH {_WORN}, {_HARM} SELECT outfit_id, round(value, 6) AS value FROM harm",
    style_compatibility: f"WITH {_WORN}, {_COMP} SELECT outfit_id, round(value, 6) AS value FROM comp",
    match_factors: f"WITH {_ALL} SELECT outfit_id, factor, value FROM rounded",
    match_scores: f"WITH {_ALL} SELECT outfit_id, score FROM score",
    recommendations: f"""WITH {_ALL}, r AS (SELECT o.user_id, o.outfit_id, s.score, row_number() OVER (PARTITION BY o.user_id ORDER BY s.score DESC, o.outfit_id) AS rank FROM score s JOIN outfits o ON o.outfit_id = s.outfit_id
      WHERE s.score >= 55 AND CAST(o.created_at AS DATE) + 400 > TIMESTAMP '1997-01-01') SELECT * FROM r WHERE rank <= 12""",
    best_outfits: f"""WITH i AS (SELECT user_id, item_id, slot, color_family AS f, style AS s, (warmth * 7 + CAST(floor(price) AS BIGINT)) % 101 AS v FROM items WHERE status = 'active' AND slot IN ('top', 'bottom', 'shoes')),
      c AS (SELECT t.user_id, t.item_id AS top, b.item_id AS bottom, h.item_id AS shoes, t.v + b.v + h.v AS own,
        {_HARMONY.format(a='t.f', b='b.f')} + {_HARMONY.format(a='t.f', b='h.f')} + {_HARMONY.format(a='b.f', b='h.f')} AS harmony,
        CASE WHEN t.s = b.s AND b.s = h.s THEN 3 WHEN t.s = b.s OR t.s = h.s OR b.s = h.s THEN 2 ELSE 1 END AS alike
        FROM i t JOIN i b ON b.user_id = t.user_id AND b.slot = 'bottom' JOIN i h ON h.user_id = t.user_id AND h.slot = 'shoes' WHERE t.slot = 'top'),
      p AS (SELECT user_id, top, bottom, shoes, CAST(160 * harmony + 1300 * alike + 25 * own AS BIGINT) AS points FROM c),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY points DESC, top, bottom, shoes) AS place FROM p)
      SELECT user_id, top, bottom, shoes, points, CAST(floor(points * 100 / 16200.0 + 0.5) AS INT) AS score, CAST(place AS INT) AS rank FROM r WHERE place <= 12""",
    candidate_outfits: """WITH f AS (SELECT user_id, item_id, slot, row_number() OVER (PARTITION BY user_id, slot ORDER BY price, item_id) AS r FROM items WHERE status = 'active' AND slot IN ('top', 'bottom', 'shoes')),
      p AS (SELECT * FROM f WHERE r <= 40), b AS (SELECT user_id, count(*) AS n, sum(item_id) AS s FROM p WHERE slot = 'bottom' GROUP BY 1), c AS (SELECT user_id, count(*) AS n, sum(item_id) AS s FROM p WHERE slot = 'shoes' GROUP BY 1)
      SELECT p.user_id, p.item_id AS top, b.n * c.n AS n, b.n AS bottoms, CAST(b.s * c.n AS BIGINT) AS bottom_sum, c.n AS pairs, CAST(c.s * b.n AS BIGINT) AS shoe_sum FROM p JOIN b ON b.user_id = p.user_id JOIN c ON c.user_id = p.user_id WHERE p.slot = 'top'""",
    layers: "SELECT outfit_id, string_agg(slot, ',' ORDER BY CASE WHEN item_id % 5 <> 0 THEN item_id % 3 ELSE 0 END, slot) AS slots FROM outfit_items GROUP BY 1",
    feedback_summary: f"WITH {_FB} SELECT outfit_id, count(*) FILTER (type = 'liked') AS liked, count(*) FILTER (type = 'disliked') AS disliked, count(*) FILTER (type = 'worn') AS worn, count(*) FILTER (type = 'rated') AS rated, round(avg(rating), 6) AS mean_rating FROM fb GROUP BY 1",
    wardrobe_gaps: """WITH i AS (SELECT item_id // 400 * 50 + user_id AS user_id, slot, status FROM items) SELECT u.user_id, s.slot FROM (SELECT DISTINCT user_id FROM i) u, (VALUES ('top'), ('bottom'), ('shoes')) s(slot)
      WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.user_id = u.user_id AND i.slot = s.slot AND i.status = 'active')""",
    formality_sets: "SELECT user_id, category, style, count(*) AS n FROM items GROUP BY GROUPING SETS ((user_id, category, style), (user_id, category), (user_id, style), (user_id))",
    imbalance_alerts: "SELECT user_id, slot AS category, count(*) FILTER (item_id % 3 <> 0) AS casual, count(*) FILTER (item_id % 3 = 0) AS formal FROM items GROUP BY 1, 2 HAVING count(*) FILTER (item_id % 3 <> 0) >= 4 AND count(*) FILTER (item_id % 3 = 0) <= 1",
    shopping_picks: """WITH p AS (SELECT item_id AS product_id, (user_id + 1) % 50 AS user_id, slot, color_family AS f FROM items WHERE slot IN ('top', 'bottom', 'shoes')),
      x AS (SELECT p.product_id, p.user_id, i.slot, count(*) AS n, count(*) FILTER (NOT ((least(p.f, i.color_family), greatest(p.f, i.color_family)) IN (('blue', 'yellow'), ('purple', 'yellow')))) AS k
        FROM p JOIN items i ON i.user_id = p.user_id AND i.slot <> p.slot AND i.slot IN ('top', 'bottom', 'shoes') AND i.status = 'active' GROUP BY 1, 2, 3)
      SELECT product_id, user_id, CAST(min(k) * max(k) AS BIGINT) AS completes_outfits, round(min(k) * max(k) / (min(n) * max(n)), 4) AS compatibility FROM x GROUP BY 1, 2 HAVING count(*) = 2""",
    lowest_prices: """WITH l AS (SELECT item_id AS product_id, min(price) OVER (PARTITION BY item_id ORDER BY purchased_on, price ROWS UNBOUNDED PRECEDING) AS low FROM purchases) SELECT product_id, min(low) AS least, round(avg(low), 3) AS mean_low FROM l GROUP BY 1""",
    price_alerts: """WITH l AS (SELECT item_id, arg_max(price, (purchased_on, -price)) AS price FROM purchases GROUP BY 1) SELECT i.user_id, i.item_id AS product_id, l.price FROM items i JOIN l ON l.item_id = i.item_id WHERE i.item_id % 3 <> 0 AND i.status = 'active' AND l.price <= i.price * 20""",
    spend: """SELECT currency, user_id, CAST(CAST(date_trunc('month', purchased_on) AS DATE) AS VARCHAR) AS month, category, brand, store, round(CAST(sum(CAST(price AS DECIMAL(18, 4))) AS DOUBLE), 2) AS total, count(*) AS n FROM purchases
      GROUP BY GROUPING SETS ((currency), (currency, user_id), (currency, user_id, CAST(date_trunc('month', purchased_on) AS DATE)), (currency, category), (currency, brand), (currency, store))""",
}
