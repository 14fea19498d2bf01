"""Derived views: the wardrobe tables, as SQL over the given tables, for Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: In an order in which each uses earlier ones only.
VIEWS = {
    "v_category": """SELECT *
  FROM (VALUES (0,'t-shirt','top'),(1,'shirt','top'),(2,'blouse','top'),(3,'tank-top','top'),(4,'sweater','top'),(5,'hoodie','top'),(6,'jacket','outer'),(7,'coat','outer'),(8,'blazer','outer'),(9,'vest','outer'),(10,'dress','dress'),(11,'skirt','bottom'),(12,'jeans','bottom'),(13,'pants','bottom'),(14,'shorts','bottom'),(15,'sneakers','shoes'),(16,'boots','shoes'),(17,'heels','shoes'),(18,'hat','hat'),(19,'bag','bag'),(20,'scarf','other'),(21,'other','other')) AS v(idx, label, grp)""",
    "v_material": """SELECT *
  FROM (VALUES (0,'cotton'),(1,'denim'),(2,'wool'),(3,'leather'),(4,'linen'),(5,'silk'),(6,'polyester'),(7,'nylon'),(8,'knit'),(9,'suede'),(10,'lace'),(11,'other')) AS v(idx, label)""",
    "v_pattern": """SELECT *
  FROM (VALUES (0,'solid'),(1,'striped'),(2,'checked'),(3,'plaid'),(4,'floral'),(5,'geometric'),(6,'graphic'),(7,'camouflage'),(8,'polka-dot'),(9,'abstract'),(10,'paisley'),(11,'other')) AS v(idx, label)""",
    "v_style": """SELECT *
  FROM (VALUES (0,'casual'),(1,'formal'),(2,'business-casual'),(3,'sporty'),(4,'streetwear'),(5,'vintage'),(6,'minimalist'),(7,'elegant'),(8,'outdoor'),(9,'smart-casual')) AS v(idx, label)""",
    "v_color": """SELECT *
  FROM (VALUES (0,'black','black'),(1,'white','white'),(2,'gray','gray'),(3,'beige','beige'),(4,'brown','brown'),(5,'red','red'),(6,'pink','pink'),(7,'orange','orange'),(8,'yellow','yellow'),(9,'green','green'),(10,'blue','blue'),(11,'navy blue','blue'),(12,'purple','purple')) AS v(idx, label, family)""",
    "v_group": """SELECT *
  FROM (VALUES (0,'top'),(1,'outer'),(2,'bottom'),(3,'dress'),(4,'shoes'),(5,'hat'),(6,'bag'),(7,'other')) AS v(idx, grp)""",
    "items": """SELECT p.p_partkey AS item_id, p.p_partkey % 50 AS user_id, p.p_name AS name, p.p_brand AS brand, c.label AS category, c.grp AS slot, co.label AS color, co.family AS color_family, m.label AS material, pa.label AS pattern, s.label AS style, p.p_retailprice AS price, p.p_size AS warmth, CASE WHEN p.p_size % 10 = 0 THEN 'archived' ELSE 'active' END AS status
  FROM part p
  JOIN v_category c ON c.idx = (p.p_partkey + p.p_size) % 22
  JOIN v_color co ON co.idx = (p.p_partkey * 3 + p.p_size) % 13
  JOIN v_material m ON m.idx = (p.p_partkey + p.p_size * 5) % 12
  JOIN v_pattern pa ON pa.idx = (p.p_partkey * 7 + p.p_size) % 12
  JOIN v_style s ON s.idx = (p.p_partkey + p.p_size * 3) % 10""",
    "wear_events": """SELECT e.event_id, e.user_id % 50 AS user_id, i.item_id, e.ts AS worn_at, CASE WHEN e.event_type = 'view' THEN 'Daily' ELSE 'Work' END AS occasion
  FROM events e
  JOIN items i ON i.item_id = e.user_id % 50 + 50 * (CAST(regexp_extract(e.props, '([0-9]+)', 1) AS BIGINT) % 40)
  WHERE e.event_type IN ('view', 'click')""",
    "garments": """SELECT g.garment_id, g.image_id, dg.grp AS coarse_label, c.label AS category, c.grp AS category_group, CASE WHEN g.k % 9 = 0 THEN NULL ELSE m.label END AS material, CASE WHEN g.k % 8 = 0 THEN NULL ELSE pa.label END AS pattern, CASE WHEN g.k % 7 = 0 THEN NULL ELSE s.label END AS style, co.label AS color, zc.label AS zero_shot_color, CAST((g.k * 13) % 96 AS DOUBLE) / CAST(100 AS DOUBLE) AS category_conf, CAST((g.k * 17) % 73 AS DOUBLE) / CAST(100 AS DOUBLE) AS material_conf, CAST((g.k * 19) % 89 AS DOUBLE) / CAST(100 AS DOUBLE) AS pattern_conf, CAST((g.k * 23) % 81 AS DOUBLE) / CAST(100 AS DOUBLE) AS style_conf, CAST((g.k * 29) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS color_share, CAST((g.k * 31) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS detector_conf, CAST((g.k * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS seg_quality, g.k % 11 = 0 AS seg_filled, g.k % 29 = 0 AS seg_missing
  FROM (SELECT o_orderkey AS garment_id, CAST(floor(o_orderkey / 2) AS BIGINT) AS image_id, o_orderkey * 7 + o_custkey AS k, o_custkey AS c
  FROM orders) g
  JOIN v_category c ON c.idx = g.k % 22
  JOIN v_material m ON m.idx = g.c % 12
  JOIN v_pattern pa ON pa.idx = (g.c + g.k) % 12
  JOIN v_style s ON s.idx = (g.c * 3 + g.k) % 10
  JOIN v_color co ON co.idx = (g.c + g.k * 2) % 13
  JOIN v_color zc ON zc.idx = (CASE WHEN g.k % 3 = 0 THEN g.c ELSE g.c + g.k * 2 END) % 13
  JOIN v_group dg ON dg.idx = (CASE WHEN g.k % 4 = 0 THEN g.k ELSE CASE c.grp WHEN 'top' THEN 0 WHEN 'outer' THEN 1 WHEN 'bottom' THEN 2 WHEN 'dress' THEN 3 WHEN 'shoes' THEN 4 WHEN 'hat' THEN 5 WHEN 'bag' THEN 6 ELSE 7 END END) % 8""",
    "eval_rows": """SELECT g.garment_id AS id, CASE WHEN g.garment_id % 10 < 7 THEN 'train' WHEN g.garment_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, g.garment_id % 13 = 0 AS no_clothing, CASE WHEN g.garment_id % 11 = 0 THEN 0 WHEN g.garment_id % 17 = 0 THEN 2 ELSE 1 END AS n_items, CASE WHEN g.garment_id % 5 = 0 THEN NULL WHEN g.garment_id % 7 = 0 THEN 'other' ELSE g.category END AS truth_category, CASE WHEN g.garment_id % 3 = 0 THEN NULL ELSE g.zero_shot_color END AS truth_color, g.pattern AS truth_pattern, CASE WHEN g.garment_id % 2 = 0 THEN g.style ELSE 'casual' END AS truth_style, CAST(NULL AS VARCHAR(20)) AS truth_material, g.category AS pred_category, g.color AS pred_color, CASE WHEN g.pattern_conf < 0.2 THEN NULL ELSE g.pattern END AS pred_pattern, g.style AS pred_style, g.material AS pred_material, g.detector_conf AS confidence, CAST(g.garment_id % 997 AS DOUBLE) / CAST(4 AS DOUBLE) AS latency_ms, CASE WHEN g.garment_id % 6 = 0 THEN 2 ELSE 1 END AS attempts
  FROM garments g""",
    "detections": """SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS det_no, CAST((l_partkey * 3) % 400 AS DOUBLE) AS x1, CAST((l_suppkey * 5) % 400 AS DOUBLE) AS y1, CAST((l_partkey * 3) % 400 AS DOUBLE) + 80 + l_quantity * 8 AS x2, CAST((l_suppkey * 5) % 400 AS DOUBLE) + 80 + l_quantity * 6 AS y2, CAST((l_partkey * 37 + l_suppkey * 11 + l_linenumber) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS score, l_linenumber % 8 AS label_idx, CAST(900 AS DOUBLE) AS img_w, CAST(720 AS DOUBLE) AS img_h
  FROM lineitem""",
    "outfits": """SELECT o_orderkey AS outfit_id, o_custkey % 50 AS user_id, o_orderpriority AS occasion, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'active' END AS status, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 5 + 1 AS INT) END AS rating
  FROM orders""",
    "outfit_items": """SELECT l.l_orderkey AS outfit_id, i.slot, min(i.item_id) AS item_id, count(*) AS n_rows
  FROM lineitem l
  JOIN items i ON i.item_id = l.l_partkey
  GROUP BY l.l_orderkey, i.slot""",
    "purchases": """SELECT o.o_custkey % 50 AS user_id, l.l_partkey AS item_id, l.l_extendedprice AS price, i.brand, i.category, l.l_shipdate AS purchased_on, s.s_name AS store, CASE WHEN s.s_nationkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN items i ON i.item_id = l.l_partkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "weather_snapshots": """SELECT event_id AS snapshot_id, user_id % 50 AS user_id, ts AS captured_at, value AS temperature_c
  FROM events
  WHERE event_type = 'view'""",
    "calendar_events": """SELECT event_id, user_id % 50 AS user_id, ts AS starts_at, event_id % 3 = 0 AS remind_enabled, event_id % 5 = 0 AS reminder_sent, CAST(event_id % 4 * 30 AS INT) AS reminder_minutes_before
  FROM events
  WHERE event_type = 'signup'""",
    "user_calendar": """SELECT event_id, user_id, ts AS starts_at
  FROM events
  WHERE event_type = 'signup'""",
    "trips": """SELECT user_id, CAST(EXTRACT(YEAR FROM ts) * 12 + EXTRACT(MONTH FROM ts) AS BIGINT) AS trip_no, min(ts) AS starts_at, min(CAST(ts AS DATE)) AS starts_on, max(CAST(ts AS DATE)) AS ends_on, count(*) AS n
  FROM events
  WHERE event_type = 'error'
  GROUP BY user_id, CAST(EXTRACT(YEAR FROM ts) * 12 + EXTRACT(MONTH FROM ts) AS BIGINT)""",
    "ai_usage": """SELECT event_id, user_id, event_type AS endpoint, CASE WHEN event_id % 3 = 0 THEN 'rule-engine' ELSE 'http' END AS provider, ts AS created_at, CAST(floor(value * 10) AS INT) AS latency_ms, CAST(event_id % 500 AS INT) AS tokens, CAST(event_id % 500 AS DOUBLE) / CAST(100000 AS DOUBLE) AS cost_usd, event_type <> 'error' AS success
  FROM events""",
    "interactions": """SELECT conv_id, turn, role, text, length(text) AS n_chars
  FROM conversations""",
    "item_vectors": """SELECT vec_id AS item_id, vec_id % 50 AS user_id, label, embedding
  FROM embeddings""",
    "label_vectors": """SELECT s.idx, s.label, e.embedding
  FROM v_style s
  JOIN (SELECT label, min(vec_id) AS vec_id
  FROM embeddings
  GROUP BY label) f ON f.label = s.idx
  JOIN embeddings e ON e.vec_id = f.vec_id""",
    "attempts": """SELECT l_orderkey AS garment_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS attempt, CAST((l_partkey * 41 + l_suppkey) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence, (l_partkey + l_linenumber) % 3 <> 0 AS wants_retry
  FROM lineitem""",
}


def needs(sql: str) -> list[str]:
    """The views that a query needs, directly or through others, in order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                found.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def with_views(sql: str) -> str:
    """`sql` with the views it needs in front; it may begin with its own WITH."""
    sql = sql.strip()
    parts = [f"{name} AS (\n{VIEWS[name]}\n)" for name in needs(sql)]
    if not parts:
        return sql
    own = re.match(r"WITH(\s+RECURSIVE)?\s+", sql, re.IGNORECASE)
    if own:
        return f"WITH{own[1] or ''} " + ",\n".join(parts) + ",\n" + sql[own.end() :]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a given table, over the tables of `sf_dir`."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = with_views(f"SELECT * FROM {name}")
    for table in BASE:
        if re.search(rf"\b(?:FROM|JOIN)\s+{table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(sql)


#: Suppliers up to which their few columns are broadcast.
SUPPLIERS = 500_000


def purchases(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, last: str = "items") -> DataFrame:
    """The rows of the view `purchases`, for large tables: suppliers are joined first, where the lines lie, and no shuffle carries their keys.

    lines: lineitem, or what a query has made of its columns.  last: `items` or `orders`; rows come dealt out by this one's key, and the
    other's key stays behind.
    """
    supplier = view(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("store"), F.when(F.col("s_nationkey") % 3 == 0, "EUR").otherwise("USD").alias("currency"))
    supplier = F.broadcast(supplier) if supplier.count() <= SUPPLIERS else supplier
    sides = {
        "orders": (view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).alias("user_id")), "l_orderkey"),
        "items": (view(spark, sf_dir, "items").select(F.col("item_id").alias("l_partkey"), "brand", "category"), "l_partkey"),
    }
    rows = (view(spark, sf_dir, "lineitem") if lines is None else lines).join(supplier, "l_suppkey")
    for name in sorted(sides, key=lambda x: x == last):
        rows = rows.join(*sides[name])
    return rows.select("user_id", F.col("l_partkey").alias("item_id"), F.col("l_extendedprice").alias("price"), "brand", "category", F.col("l_shipdate").alias("purchased_on"), "store", "currency")
