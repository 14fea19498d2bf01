"""Queries over detections, zero-shot scores and item vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import geometry, vectors
from weft.operators import detect, embed, zeroshot
from weft.plans.fixtures import view


def box_overlaps(spark, d):
    pairs = detect.pairwise_iou(view(spark, d, "detections"))
    return pairs.groupBy("image_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max("iou"), 6).alias("most"))


def sheet_overlaps(spark, d):
    """Overlaps on contact sheets: a hundred photos in a square of ten by ten, with some hundreds of boxes a sheet."""
    photo = F.col("image_id") % 100
    across, down = (photo % 10) * 500.0, F.floor(photo / 10) * 500.0
    moved = {"x1": F.col("x1") + across, "x2": F.col("x2") + across, "y1": F.col("y1") + down, "y2": F.col("y2") + down}
    sheets = view(spark, d, "detections").withColumns({**moved, "det_no": F.col("image_id") * 10 + F.col("det_no"), "image_id": F.floor(F.col("image_id") / 100)})
    pairs = detect.pairwise_iou(sheets)
    return pairs.groupBy("image_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.max("iou"), 6).alias("most"))


def suppressed_boxes(spark, d):
    return detect.suppress(view(spark, d, "detections"), 0.6).select("image_id", F.col("det_no").cast("long").alias("det_no"), "score")


def filtered_detections(spark, d):
    out = detect.filter_detections(view(spark, d, "detections"), 0.3, 0.02, 0.5, 5)
    return out.select("image_id", "garment_id", F.col("det_no").cast("long").alias("det_no"), F.round("area", 4).alias("area"))


def padded_boxes(spark, d):
    cols = [F.col(c) for c in ["x1", "y1", "x2", "y2", "img_w", "img_h"]]
    padded = geometry.pad_box(*cols, 0.03)
    return view(spark, d, "detections").groupBy("label_idx").agg(*[F.round(F.sum(p), 2).alias(n) for p, n in zip(padded, ("x1", "y1", "x2", "y2"))])


def crop_boxes(spark, d):
    crop = geometry.crop_box(*[F.col(c) for c in ["x1", "y1", "x2", "y2", "img_w", "img_h"]])
    rows = view(spark, d, "detections").select("label_idx", *[c.alias(n) for c, n in zip(crop, ("l", "t", "r", "b"))])
    return rows.groupBy("label_idx").agg(F.sum((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).cast("long").alias("pixels"), F.min("l").alias("l"), F.max("b").alias("b"))


def fallback_union(spark, d):
    boxes = view(spark, d, "detections")
    out = detect.with_fallback(boxes.where("score >= 0.7"), boxes.where("score < 0.7"))
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("boxes"), F.count_distinct("image_id").alias("photos"))


def coarse_labels(spark, d):
    label = F.concat(F.lit(" "), F.col("label_idx").cast("string"))
    grp = detect.coarse_label(label, {"0": "top", "1": "outer", "2": "bottom", "3": "dress", "4": "shoes"})
    return view(spark, d, "detections").groupBy(grp.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


def profile_detections(spark, d):
    """Of each speed profile: the garments that its limits leave."""
    boxes, out = view(spark, d, "detections"), None
    for profile in detect.PROFILES:
        rows = detect.filter_by_profile(boxes, profile, 0.3, 0.05, 0.9, 6).select(F.lit(profile).alias("profile"), "image_id", F.col("det_no").cast("long").alias("det_no"), F.col("position").cast("long").alias("position"))
        out = rows if out is None else out.union(rows)
    return out


def active_heads(spark, d):
    """Heads of active attributes: those that are reported, and the colour that corroborates."""
    g, heads = view(spark, d, "garments"), ["category", "color", "pattern", "style", "material", "subcategory"]
    told = {"color": F.col("zero_shot_color"), "subcategory": F.col("category")}
    parts = F.array(*[F.struct(F.lit(a).alias("attribute"), told.get(a, F.col(a)).alias("label")) for a in heads])
    reported, colour = zeroshot.active_heads(g.select("garment_id", F.explode(parts).alias("h")).select("garment_id", "h.*"), ["category", "color", "style", "subcategory"])
    return reported.withColumn("role", F.lit("reported")).union(colour.withColumn("role", F.lit("corroborates"))).groupBy("role", "attribute", "label").agg(F.count(F.lit(1)).alias("n"))


def mask_evidence(spark, d):
    g = view(spark, d, "garments").select("garment_id", F.col("detector_conf").alias("iou"), F.col("seg_quality").alias("coverage"), F.col("color_share").alias("solidity"))
    bad = geometry.mask_degenerate(F.col("coverage"))
    return g.select("garment_id", bad.alias("filled"), F.round(F.when(bad, geometry.FILLED_QUALITY).otherwise(geometry.mask_quality(F.col("iou"), F.col("coverage"), F.col("solidity"))), 6).alias("quality"))


def best_mask_candidates(spark, d):
    rows = view(spark, d, "detections").select(F.col("image_id").alias("garment_id"), F.col("det_no").cast("long").alias("candidate"), (F.col("x2") - F.col("x1")).alias("area_px"), F.lit(300.0).alias("box_px"), F.least(F.col("x2") - F.col("x1"), F.lit(250.0)).alias("both_px"), F.col("score").alias("head"))
    return detect.best_masks(rows, 100).select("garment_id", "candidate", F.round("combined", 6).alias("combined"))


def retry_views(spark, d):
    rows = view(spark, d, "detections").withColumn("t", geometry.tightened_box(*[F.col(c) for c in ["x1", "y1", "x2", "y2", "img_w", "img_h"]]))
    gamma = geometry.brighten_gamma(F.col("x1") / 3)
    return rows.groupBy("label_idx").agg(F.count("t").alias("tightened"), F.round(F.sum("t.x1"), 3).alias("x1"), F.round(F.sum("t.y2"), 3).alias("y2"), F.count(gamma).alias("brightened"), F.round(F.sum(gamma), 5).alias("gamma"))


def zero_shot_scores(spark, d):
    s = zeroshot.softmax_scores(view(spark, d, "item_vectors").select("item_id", "embedding"), view(spark, d, "label_vectors"))
    return s.select("item_id", "label", F.round("score", 5).alias("score"))


def zero_shot_allowed(spark, d):
    """Each garment with the labels that its own group allows; every tenth has a group without labels, and so all."""
    own = F.expr("transform(filter(sequence(0, 9), i -> i % 3 = item_id % 3), i -> element_at(array('casual', 'formal', 'business-casual', 'sporty', 'streetwear', 'vintage', 'minimalist', 'elegant', 'outdoor', 'smart-casual'), i + 1))")
    items = view(spark, d, "item_vectors").select("item_id", "embedding", F.when(F.col("item_id") % 10 == 0, F.array(F.lit("no such label"))).otherwise(own).alias("allowed"))
    s = zeroshot.softmax_scores(items, view(spark, d, "label_vectors"), allowed_col="allowed")
    return s.select("item_id", "label", F.round("score", 5).alias("score"))


def zero_shot_top(spark, d):
    s = zeroshot.softmax_scores(view(spark, d, "item_vectors").select("item_id", "embedding"), view(spark, d, "label_vectors"), ["casual", "formal", "sporty", "vintage"])
    return zeroshot.top_labels(s, 2).select("item_id", "label", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def zero_shot_heads(spark, d):
    s = zeroshot.softmax_scores(view(spark, d, "item_vectors").select("item_id", "embedding"), view(spark, d, "label_vectors"))
    h = zeroshot.head_diagnostics(s, 0.9)
    return h.select("item_id", "label", F.round("confidence", 4).alias("confidence"), F.round("entropy", 4).alias("entropy"), F.round("margin", 4).alias("margin"))


def normalised_vectors(spark, d):
    v = view(spark, d, "item_vectors").select("item_id", vectors.normalise(F.col("embedding"), 6).alias("v"))
    return v.select("item_id", F.round(vectors.norm(F.col("v")), 4).alias("norm"), F.element_at("v", 1).alias("first"))


def similar_items(spark, d):
    v = view(spark, d, "item_vectors").select("item_id", "embedding")
    out = embed.similar_items(v.where("item_id % 20 = 0"), v, 5)
    return out.select("query_id", "item_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def duplicate_items(spark, d):
    return embed.duplicate_items(view(spark, d, "item_vectors"), 0.3).select("user_id", "a", "b", F.round("similarity", 5).alias("similarity"))


def item_clusters(spark, d):
    return embed.cluster_items(view(spark, d, "item_vectors"), 8).select("item_id", "cluster", F.round("apart", 5).alias("apart"))


_PAIRS = """pairs AS (SELECT a.image_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t FROM detections a JOIN detections b ON a.image_id = b.image_id AND a.det_no < b.det_no)"""
_SOFT = """unit AS (SELECT item_id, embedding FROM item_vectors),
e AS (SELECT u.item_id, l.idx, l.label, exp(100 * list_cosine_similarity(CAST(u.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])) - 100) AS x FROM unit u CROSS JOIN label_vectors l {where}),
soft AS (SELECT item_id, idx, label, x / sum(x) OVER (PARTITION BY item_id) AS score FROM e)"""
_EARTH = """ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, x1, y1, det_no) AS r FROM detections)"""



def _clusters_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """k-means from the k least ids on, a table a round."""
    steps = [
        "unit AS (SELECT item_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM item_vectors)",
        f"centre0 AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS c, v FROM unit ORDER BY item_id LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"near{r} AS (SELECT item_id, c, d FROM (SELECT item_id, c, d, row_number() OVER (PARTITION BY item_id ORDER BY round(d, 12), c) AS place FROM (SELECT item_id, c, list_distance(u.v, k.v) AS d FROM unit u, centre{r} k)) WHERE place = 1)")
        if r < rounds:
            means = ", ".join(f"avg(v[{j + 1}])" for j in range(size))
            steps.append(f"mean{r} AS (SELECT c, [{means}] AS v FROM unit JOIN near{r} USING (item_id) GROUP BY c)")
            steps.append(f"centre{r + 1} AS (SELECT k.c, coalesce(m.v, k.v) AS v FROM centre{r} k LEFT JOIN mean{r} m ON m.c = k.c)")
    return "WITH " + ",\n".join(steps) + f"\nSELECT item_id, CAST(c AS INT) AS cluster, round(d, 5) AS apart FROM near{rounds}"


QUERIES = {
    box_overlaps: f"WITH {_PAIRS} SELECT image_id, count(*) AS pairs, round(max(i / (s + t - i)), 6) AS most FROM pairs WHERE i > 0 GROUP BY image_id",
    sheet_overlaps: """WITH sheet AS (SELECT image_id // 100 AS s, image_id * 10 + det_no AS det_no, x1 + image_id % 10 * 500 AS x1, x2 + image_id % 10 * 500 AS x2, y1 + image_id % 100 // 10 * 500 AS y1, y2 + image_id % 100 // 10 * 500 AS y2 FROM detections),
      p AS (SELECT a.s AS image_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS m, (b.x2 - b.x1) * (b.y2 - b.y1) AS n FROM sheet a JOIN sheet b ON a.s = b.s AND a.det_no < b.det_no)
      SELECT image_id, count(*) AS pairs, round(max(i / (m + n - i)), 6) AS most FROM p WHERE i > 0 GROUP BY image_id""",
    suppressed_boxes: f"""WITH RECURSIVE {_EARTH},
      hits AS (SELECT b.image_id, b.r AS hit, a.r AS lead FROM ranked a JOIN ranked b ON a.image_id = b.image_id AND a.r < b.r
        WHERE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))
          > 0.6 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))),
      lists AS (SELECT image_id, hit, list(lead) AS l FROM hits GROUP BY 1, 2),
      walk AS (SELECT image_id, 0 AS r, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image_id FROM ranked)
        UNION ALL SELECT w.image_id, w.r + 1, CASE WHEN list_has_any(w.kept, coalesce(h.l, CAST([] AS BIGINT[]))) THEN w.kept ELSE list_append(w.kept, CAST(w.r + 1 AS BIGINT)) END
        FROM walk w JOIN ranked k ON k.image_id = w.image_id AND k.r = w.r + 1 LEFT JOIN lists h ON h.image_id = w.image_id AND h.hit = w.r + 1),
      done AS (SELECT image_id, arg_max(kept, r) AS kept FROM walk GROUP BY image_id)
      SELECT k.image_id, CAST(k.det_no AS BIGINT) AS det_no, k.score FROM ranked k JOIN done o ON o.image_id = k.image_id WHERE list_contains(o.kept, k.r)""",
    filtered_detections: """WITH f AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM detections),
      n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, score DESC, x1, y1, det_no) AS p FROM f WHERE score >= 0.3 AND area / (img_w * img_h) BETWEEN 0.02 AND 0.5)
      SELECT image_id, format('garment_{:03d}', p) AS garment_id, CAST(det_no AS BIGINT) AS det_no, round(area, 4) AS area FROM n WHERE p <= 5""",
    padded_boxes: "SELECT label_idx, round(sum(greatest(0, least(img_w, x1 - 27))), 2) AS x1, round(sum(greatest(0, least(img_h, y1 - 21.6))), 2) AS y1, round(sum(greatest(0, least(img_w, x2 + 27))), 2) AS x2, round(sum(greatest(0, least(img_h, y2 + 21.6))), 2) AS y2 FROM detections GROUP BY label_idx",
    crop_boxes: """WITH c AS (SELECT label_idx, greatest(0, least(CAST(floor(x1) AS INT), 899)) AS l, greatest(0, least(CAST(floor(y1) AS INT), 719)) AS t, x2, y2 FROM detections),
      k AS (SELECT label_idx, l, t, greatest(l + 1, least(CAST(floor(x2) AS INT), 900)) AS r, greatest(t + 1, least(CAST(floor(y2) AS INT), 720)) AS b FROM c)
      SELECT label_idx, CAST(sum((r - l) * (b - t)) AS BIGINT) AS pixels, min(l) AS l, max(b) AS b FROM k GROUP BY label_idx""",
    fallback_union: """WITH p AS (SELECT * FROM detections WHERE score >= 0.7), s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_no) AS r FROM detections
        WHERE score < 0.7 AND (x2 - x1) * (y2 - y1) / (img_w * img_h) >= 0.08 AND image_id NOT IN (SELECT image_id FROM p))
      SELECT 'primary' AS source, count(*) AS boxes, count(DISTINCT image_id) AS photos FROM p UNION ALL SELECT 'fallback', count(*), count(DISTINCT image_id) FROM s WHERE r = 1""",
    profile_detections: """WITH d AS (SELECT *, (x2 - x1) * (y2 - y1) AS a FROM detections), p AS (SELECT * FROM (VALUES ('standard', 0.3, 6), ('fast', 0.3, 4), ('thorough', 0.15, 8)) AS v(profile, least, most)),
      r AS (SELECT p.profile, p.most, d.image_id, d.det_no, row_number() OVER (PARTITION BY p.profile, d.image_id ORDER BY a DESC, score DESC, x1, y1, det_no) AS position FROM d JOIN p ON d.score >= CAST(p.least AS DOUBLE) WHERE a / (img_w * img_h) BETWEEN 0.05 AND 0.9)
      SELECT profile, image_id, det_no, position FROM r WHERE position <= most""",
    active_heads: """SELECT 'reported' AS role, 'category' AS attribute, category AS label, count(*) AS n FROM garments GROUP BY 3 UNION ALL SELECT 'reported', 'style', style, count(*) FROM garments GROUP BY 3
      UNION ALL SELECT 'corroborates', 'color', zero_shot_color, count(*) FROM garments GROUP BY 3""",
    coarse_labels: "SELECT CASE label_idx WHEN 0 THEN 'top' WHEN 1 THEN 'outer' WHEN 2 THEN 'bottom' WHEN 3 THEN 'dress' WHEN 4 THEN 'shoes' ELSE 'other' END AS grp, count(*) AS n FROM detections GROUP BY 1",
    mask_evidence: """SELECT garment_id, seg_quality < 0.08 OR seg_quality > 0.99 AS filled, round(CASE WHEN seg_quality < 0.08 OR seg_quality > 0.99 THEN 0.25
      ELSE greatest(0, least(1, 0.55 * least(1, detector_conf) + 0.30 * (1 - least(1, abs(seg_quality - 0.75) / 0.75)) + 0.15 * color_share)) END, 6) AS quality FROM garments""",
    best_mask_candidates: """WITH c AS (SELECT image_id AS garment_id, CAST(det_no AS BIGINT) AS candidate, x2 - x1 AS a, least(x2 - x1, 250) AS b, score FROM detections WHERE x2 - x1 >= 100),
      s AS (SELECT garment_id, candidate, 0.7 * (b / (a + 300 - b)) + 0.3 * score AS combined FROM c),
      r AS (SELECT *, row_number() OVER (PARTITION BY garment_id ORDER BY combined DESC, candidate) AS k FROM s) SELECT garment_id, candidate, round(combined, 6) AS combined FROM r WHERE k = 1""",
    retry_views: """WITH t AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, least(greatest(0, x1 + (x2 - x1) * 0.12), img_w - 1) AS a, least(greatest(0, y1 + (y2 - y1) * 0.12), img_h - 1) AS b,
        greatest(least(img_w, x2 - (x2 - x1) * 0.12), 1) AS c, greatest(least(img_h, y2 - (y2 - y1) * 0.12), 1) AS e FROM detections),
      k AS (SELECT *, w * h / (img_w * img_h) < 0.45 AND w >= 48 AND h >= 48 AND c - a >= 48 AND e - b >= 48 AS ok, x1 / 3 < 72 AS dark, greatest(0.4, least(1, pow(greatest(0.35, least(1, x1 / 3 / 118)), 0.45))) AS g FROM t)
      SELECT label_idx, count(*) FILTER (ok) AS tightened, round(sum(a) FILTER (ok), 3) AS x1, round(sum(e) FILTER (ok), 3) AS y2, count(*) FILTER (dark) AS brightened, round(sum(g) FILTER (dark), 5) AS gamma FROM k GROUP BY label_idx""",
    zero_shot_scores: f"WITH {_SOFT.format(where='')} SELECT item_id, label, round(score, 5) AS score FROM soft",
    zero_shot_allowed: f"WITH {_SOFT.format(where='WHERE u.item_id % 10 = 0 OR l.idx % 3 = u.item_id % 3')} SELECT item_id, label, round(score, 5) AS score FROM soft",
    zero_shot_top: f"""WITH {_SOFT.format(where="WHERE l.label IN ('casual', 'formal', 'sporty', 'vintage')")}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, idx) AS rank FROM soft)
      SELECT item_id, label, round(score, 5) AS score, rank FROM r WHERE rank <= 2""",
    zero_shot_heads: f"""WITH {_SOFT.format(where='')}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, idx) AS k FROM soft)
      SELECT item_id, max(label) FILTER (k = 1) AS label, round(least(round(max(score), 5), 0.9), 4) AS confidence, round(greatest(0, least(1, sum(-score * ln(score + 1e-12)) / ln(count(*)))), 4) AS entropy,
        round(max(score) FILTER (k = 1) - max(score) FILTER (k = 2), 4) AS margin FROM r GROUP BY item_id""",
    normalised_vectors: "SELECT item_id, CAST(1 AS DOUBLE) AS norm, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS first FROM item_vectors",
    similar_items: """WITH p AS (SELECT q.item_id AS query_id, i.item_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS s FROM item_vectors q JOIN item_vectors i ON q.item_id <> i.item_id WHERE q.item_id % 20 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, item_id) AS rank FROM p) SELECT query_id, item_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5""",
    duplicate_items: """SELECT a.user_id, a.item_id AS a, b.item_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS similarity
      FROM item_vectors a JOIN item_vectors b ON a.user_id = b.user_id AND a.item_id < b.item_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3""",
    item_clusters: _clusters_sql(),
}
