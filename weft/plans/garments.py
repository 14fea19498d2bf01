"""Queries over analysed garments: rules, confidence, status, review, retries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import color, quality, scoring
from weft.operators import garments as G
from weft.plans.fixtures import view
from weft.sources.io import flatten_results, predictions_long

ATTRS = ["category", "material", "pattern", "style"]

#: What the rules, the colour score and the fused confidence are, in SQL: shared by the oracles below.
JUDGED = """
ctx AS (
  SELECT g.*, g.zero_shot_color IS NOT NULL AND g.color IS NOT NULL AND g.zero_shot_color <> g.color AS two,
    CASE WHEN g.zero_shot_color <> g.color THEN abs(2 * g.color_share - 1) / 2 ELSE 0.0 END AS spread,
    fa.family AS fam, fb.family AS zfam,
    coalesce(g.detector_conf >= 0.45 AND g.coarse_label <> 'other' AND g.coarse_label = g.category_group, false) AS gated
  FROM garments g LEFT JOIN v_color fa ON fa.label = g.color LEFT JOIN v_color fb ON fb.label = g.zero_shot_color),
fired AS (
  SELECT *,
    coalesce(material = 'silk' AND category IN ('jeans', 'jacket', 'coat', 'boots', 'blazer'), false) AS r1,
    coalesce(material = 'denim' AND category NOT IN ('jeans', 'pants', 'shorts', 'skirt', 'jacket', 'coat'), false) AS r2,
    coalesce(material IN ('leather', 'suede') AND category NOT IN ('jacket', 'coat', 'blazer', 'boots', 'heels', 'vest', 'sneakers'), false) AS r3,
    coalesce(material = 'knit' AND category NOT IN ('sweater', 'hoodie', 'shirt', 'blazer', 'vest', 't-shirt'), false) AS r4,
    coalesce(material IN ('polyester', 'nylon') AND category IN ('blazer', 'coat'), false) AS r5,
    coalesce(fam <> zfam, false) AS r6,
    two AND (least(fam, zfam), greatest(fam, zfam)) IN (('black', 'white'), ('blue', 'yellow'), ('purple', 'yellow')) AS r7,
    coalesce(pattern NOT IN ('solid', 'other') AND spread < 0.045, false) AS r8,
    NOT gated AND coarse_label <> 'other' AND category_group <> 'other' AND coarse_label <> category_group AS r9,
    seg_filled AS r10
  FROM ctx),
scored AS (
  SELECT *,
    CASE WHEN r1 THEN 0.22 ELSE 0 END + CASE WHEN r2 THEN 0.18 ELSE 0 END + CASE WHEN r3 THEN 0.20 ELSE 0 END + CASE WHEN r4 THEN 0.18 ELSE 0 END
      + CASE WHEN r6 THEN 0.12 ELSE 0 END + CASE WHEN r7 THEN 0.15 ELSE 0 END + CASE WHEN r9 THEN 0.20 ELSE 0 END + CASE WHEN r10 THEN 0.25 ELSE 0 END AS penalty,
    NOT (r1 OR r2 OR r3 OR r4 OR r6 OR r7 OR r9 OR r10) AS consistent,
    greatest(0, least(1, least(0.95, 0.60 + 0.40 * color_share) * CASE WHEN seg_missing THEN 0.75 WHEN seg_filled THEN 0.55
      WHEN seg_quality < 0.45 THEN 1 - 0.45 * (0.45 - seg_quality) / 0.45 ELSE 1 END)) AS color_conf
  FROM fired),
fused AS (
  SELECT *, greatest(0, least(1, (0.12 * detector_conf + 0.88 * (
      0.38 * category_conf + 0.26 * color_conf + CASE WHEN pattern IS NULL THEN 0 ELSE 0.16 * pattern_conf END
      + CASE WHEN style IS NULL THEN 0 ELSE 0.10 * style_conf END + CASE WHEN material IS NULL THEN 0 ELSE 0.10 * material_conf END)
    / (0.64 + CASE WHEN pattern IS NULL THEN 0 ELSE 0.16 END + CASE WHEN style IS NULL THEN 0 ELSE 0.10 END + CASE WHEN material IS NULL THEN 0 ELSE 0.10 END))
    * CASE WHEN seg_filled AND NOT seg_missing THEN 0.9 ELSE 1 END * (1 - least(0.6, penalty)))) AS confidence
  FROM scored),
judged AS (
  SELECT *, CASE WHEN round(confidence, 9) >= 0.70 THEN 'accepted' WHEN round(confidence, 9) >= 0.45 THEN 'accepted_with_uncertainty' ELSE 'uncertain' END AS status FROM fused)
"""


def _judged(spark, d):
    return G.judge_garments(view(spark, d, "garments"))


def garment_status_report(spark, d):
    return G.status_report(_judged(spark, d))


def garment_confidence(spark, d):
    j = _judged(spark, d)
    return j.select("garment_id", F.round("color_conf", 6).alias("color_conf"), F.round("penalty", 6).alias("penalty"), "consistent", F.round("confidence", 6).alias("confidence"), "status", "needs_review", F.array_join("flags", ",").alias("flags"))


def garment_review_reasons(spark, d):
    return _judged(spark, d).where("needs_review").select("garment_id", F.array_join("review_reason", ",").alias("reasons"))


def rule_hit_counts(spark, d):
    return G.rule_counts(_judged(spark, d))


def rule_messages(spark, d):
    """Every message of every rule that fires."""
    return _judged(spark, d).select("garment_id", F.explode("fired").alias("f")).select("garment_id", "f.code", "f.detail")


def color_source_agreement(spark, d):
    return G.color_agreement(view(spark, d, "garments")).groupBy("color", "agree").agg(F.count(F.lit(1)).alias("n"))


def report_floor(spark, d):
    g = G.apply_report_floor(view(spark, d, "garments"), ATTRS)
    return g.agg(*[F.count(a).alias(a) for a in ATTRS])


def category_gate(spark, d):
    g = view(spark, d, "garments").withColumn("detector_group", F.col("coarse_label"))
    other = F.when(F.col("garment_id") % 2 == 0, "jeans").otherwise("dress")
    one = F.create_map(F.col("category"), F.lit(0.5))
    g = g.withColumn("scores", F.when(F.col("category") == other, one).otherwise(F.map_concat(one, F.create_map(F.when(F.col("category") == other, "").otherwise(other), F.lit(0.2)))))
    out = G.gate_category(g, view(spark, d, "v_category"), F.col("scores"))
    return out.groupBy("gate_applied", (F.col("gated_category") != F.col("category")).alias("corrected"), "gated_group").agg(F.count(F.lit(1)).alias("n"))


def retry_resolution(spark, d):
    return G.resolve_retries(view(spark, d, "attempts")).withColumn("attempt", F.col("attempt").cast("long")).withColumn("attempts", F.col("attempts").cast("long"))


def retry_boxes(spark, d):
    """The kept pass of each garment with the box of its original detection, though every pass has a box of its own."""
    boxes = view(spark, d, "detections").select(F.col("image_id").alias("garment_id"), F.col("det_no").alias("attempt"), "x1", "y1", "x2", "y2")
    kept = G.resolve_retries(view(spark, d, "attempts").join(boxes, ["garment_id", "attempt"]))
    return kept.select("garment_id", F.col("attempt").cast("long").alias("attempt"), "x1", "y1", "x2", "y2", F.col("attempts").cast("long").alias("attempts"))


def retry_decisions(spark, d):
    j = _judged(spark, d).withColumns({"entropy": 1 - F.col("detector_conf"), "margin": F.col("style_conf"), "attempt": (F.col("garment_id") % 3 + 1)})
    return j.groupBy("status", scoring.should_retry(F.col("status"), F.col("entropy"), F.col("margin"), F.col("attempt"), F.col("consistent"), 2).alias("retry")).agg(F.count(F.lit(1)).alias("n"))


def image_quality_verdicts(spark, d):
    g = view(spark, d, "garments")
    m = g.select("garment_id", (F.col("garment_id") % 400).cast("int").alias("w"), (F.col("garment_id") % 300 + 40).cast("int").alias("h"), (F.col("garment_id") % 256).cast("double").alias("brightness"), (F.col("garment_id") % 40).cast("double").alias("contrast"), (F.col("garment_id") % 200).cast("double").alias("sharpness"), (F.col("color_share") / 10).alias("foreground"))
    m = m.withColumn("issues", quality.quality_issues(F.col("w"), F.col("h"), F.col("brightness"), F.col("contrast"), F.col("sharpness"), F.col("foreground")))
    return m.select("garment_id", F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["code"], x["severity"])), ",").alias("issues"), F.round(quality.quality_score(F.col("issues")), 4).alias("score"), quality.usable(F.col("issues")).alias("usable"))


def color_naming(spark, d):
    g = view(spark, d, "garments").select((F.col("garment_id") % 256).cast("int").alias("r"), (F.col("garment_id") * 7 % 256).cast("int").alias("g"), (F.col("garment_id") * 13 % 256).cast("int").alias("b")).distinct()
    named = g.withColumn("lab", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).withColumn("name", color.nearest_color(F.col("lab")))
    return named.groupBy(F.col("name.name").alias("name"), color.color_family(F.col("name.name")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("name.distance"), 3).alias("farthest"))


def hex_round_trip(spark, d):
    g = view(spark, d, "items").select("item_id", F.format_string("#%06x", (F.col("item_id") * 7919 % 16777216).cast("int")).alias("hex"))
    rgb = g.withColumn("c", color.hex_to_rgb(F.col("hex")))
    return rgb.select("item_id", "hex", "c.r", "c.g", "c.b", color.rgb_to_hex(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("again"))


def _results(spark, d):
    """Analysis results a photo, nested as the analysis gives them; photos of a number divisible by 50 have no item."""
    g = view(spark, d, "garments")
    head = lambda a: F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("value"), F.col(f"{a}_conf").alias("confidence"), F.create_map(F.col(a), F.col(f"{a}_conf"), F.lit("rest"), 1 - F.col(f"{a}_conf")).alias("scores"))).alias(a)
    item = F.struct(F.format_string("garment_%03d", "garment_id").alias("id"), F.struct(*[head(a) for a in ATTRS]).alias("attributes"))
    nested = g.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("garment_id", item.alias("item"))), lambda a, b: F.signum(a["garment_id"] - b["garment_id"]).cast("int")).alias("i"))
    items = F.when(F.col("image_id") % 50 == 0, F.filter("i", lambda x: F.lit(False))).otherwise(F.col("i"))
    return nested.select(F.col("image_id").cast("string").alias("request_id"), (F.col("image_id") % 50 != 0).alias("success"), F.lit(None).cast("string").alias("reason"), F.transform(items, lambda x: x["item"]).alias("items"))


def flattened_results(spark, d):
    flat = flatten_results(_results(spark, d))
    return flat.select("request_id", "success", F.col("position").cast("long").alias("position"), "id", F.col("attributes.category.value").alias("category"))


def prediction_rows(spark, d):
    long = predictions_long(flatten_results(_results(spark, d)))
    return long.groupBy("attribute", "value", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


def color_spreads(spark, d):
    g = view(spark, d, "garments")
    m = F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("other")), F.array("color_share", "seg_quality", F.lit(0.5)))
    return g.select("garment_id", F.round(color.color_spread(m), 6).alias("spread"))


def color_distances(spark, d):
    lab = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, "lab")])
    g = view(spark, d, "garments")
    return g.select("garment_id", F.round(color.delta_e(lab("category_conf", "material_conf", "pattern_conf"), lab("style_conf", "color_share", "detector_conf")), 6).alias("distance"))


_ISSUES = """
m AS (SELECT garment_id, CAST(garment_id % 400 AS INT) AS w, CAST(garment_id % 300 + 40 AS INT) AS h, CAST(garment_id % 256 AS DOUBLE) AS b,
  CAST(garment_id % 40 AS DOUBLE) AS c, CAST(garment_id % 200 AS DOUBLE) AS s, color_share / 10 AS f FROM garments),
i AS (SELECT garment_id, list_filter([
  CASE WHEN least(w, h) < 160 THEN CASE WHEN least(w, h) < 80 THEN 'low_resolution:error' ELSE 'low_resolution:warning' END END,
  CASE WHEN b < 28 THEN CASE WHEN b < 14 THEN 'too_dark:error' ELSE 'too_dark:warning' END WHEN b > 236 THEN 'too_bright:warning' END,
  CASE WHEN s < 60 THEN 'blurry:warning' END, CASE WHEN c < 18 THEN 'low_contrast:warning' END, CASE WHEN f < 0.02 THEN 'no_foreground:error' END], lambda x: x IS NOT NULL) AS l FROM m)
"""
_FLAGS = "concat_ws(',', " + ", ".join(f"CASE WHEN r{k} THEN '{c}' END" for k, c in enumerate(["silk_must_be_lightweight", "denim_implies_bottom_or_outer", "leather_requires_outerwear_or_shoes", "knit_requires_soft_category", "no_sportswear_material_on_formal_category", "color_source_disagreement", "color_contrast_impossible", "pattern_on_flat_colour", "category_outside_detected_group", "occluded_garment"], 1)) + ")"
_HITS = " UNION ALL ".join(f"SELECT '{c}' AS code, '{s}' AS severity, count(*) AS n FROM fired WHERE r{k} HAVING count(*) > 0" for k, (c, s) in enumerate([("silk_must_be_lightweight", "error"), ("denim_implies_bottom_or_outer", "error"), ("leather_requires_outerwear_or_shoes", "error"), ("knit_requires_soft_category", "error"), ("no_sportswear_material_on_formal_category", "advisory"), ("color_source_disagreement", "error"), ("color_contrast_impossible", "error"), ("pattern_on_flat_colour", "advisory"), ("category_outside_detected_group", "error"), ("occluded_garment", "error")], 1))

#: Code and message of each rule, in order, as SQL.
MESSAGES = [
    ("silk_must_be_lightweight", "'material `silk` is implausible for category `' || category || '`'"),
    ("denim_implies_bottom_or_outer", "'material `denim` does not match category `' || category || '`'"),
    ("leather_requires_outerwear_or_shoes", "'material `' || material || '` does not match category `' || category || '`'"),
    ("knit_requires_soft_category", "'material `knit` does not match category `' || category || '`'"),
    ("no_sportswear_material_on_formal_category", "'performance material `' || material || '` on category `' || category || '`'"),
    ("color_source_disagreement", "'zero-shot colour `' || zero_shot_color || '` disagrees with measured colour `' || color || '`'"),
    ("color_contrast_impossible", "'colours `{primary}` and `{secondary}` are implausible together'"),
    ("pattern_on_flat_colour", "'pattern `' || pattern || '` on an almost single-colour measurement'"),
    ("category_outside_detected_group", "'category `' || category || '` contradicts the detected `' || coarse_label || '`'"),
    ("occluded_garment", "'segmentation fell back to the bounding box; colour may include background'"),
]


def _lab_sql(r, g, b):
    """l, a, b of sRGB columns as SQL expressions, from the fixed values of the library."""
    lin = [f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END" for c in (r, g, b)]
    xyz = ["((" + " + ".join(f"({v}) * {w}::DOUBLE" for v, w in zip(lin, row)) + f") / {row[3]}::DOUBLE)" for row in color._XYZ]
    f = [f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1::DOUBLE / 3) ELSE 7.787 * {t} + 16::DOUBLE / 116 END" for t in xyz]
    light = f"CASE WHEN {xyz[1]} > 0.008856 THEN 116 * ({f[1]}) - 16 ELSE 903.3 * {xyz[1]} END"
    return f"round_even(({light}) * 255 / 100, 0)", f"round_even(500 * (({f[0]}) - ({f[1]})), 0)", f"round_even(200 * (({f[1]}) - ({f[2]})), 0)"


_ANCHORS = ", ".join(f"({i}, '{n}', '{fam}', '{band}', {', '.join(map(str, color._lab_of(h)))})" for i, (n, h, fam, band) in enumerate(color.PALETTE))
_L, _A, _B = _lab_sql("r", "g", "b")
NAMING = f"""WITH px AS (SELECT DISTINCT CAST(garment_id % 256 AS INT) AS r, CAST(garment_id * 7 % 256 AS INT) AS g, CAST(garment_id * 13 % 256 AS INT) AS b FROM garments),
  lab AS (SELECT r, g, b, {_L} AS l, {_A} AS a, {_B} AS bb FROM px),
  anchor AS (SELECT * FROM (VALUES {_ANCHORS}) AS v(i, name, family, band, l, a, b)),
  near AS (SELECT p.r, p.g, p.b, n.i, n.name, n.family, sqrt(pow(n.a - p.a, 2) + pow(n.b - p.bb, 2) + pow(n.l - p.l, 2)) AS d FROM lab p JOIN anchor n
    ON n.band = 'any' OR n.band = CASE WHEN p.l > {color.LIGHT_ABOVE} THEN 'light' WHEN p.l < {color.DARK_BELOW} THEN 'dark' ELSE 'any' END),
  best AS (SELECT *, row_number() OVER (PARTITION BY r, g, b ORDER BY d, i) AS k FROM near)
  SELECT name, family, count(*) AS n, round(max(d), 3) AS farthest FROM best WHERE k = 1 GROUP BY 1, 2"""

QUERIES = {
    garment_status_report: f"WITH {JUDGED} SELECT status, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, round(avg(CASE WHEN status = 'uncertain' OR NOT consistent THEN 1 ELSE 0 END), 4) AS review_share FROM judged GROUP BY status",
    garment_confidence: f"WITH {JUDGED} SELECT garment_id, round(color_conf, 6) AS color_conf, round(CAST(penalty AS DOUBLE), 6) AS penalty, consistent, round(confidence, 6) AS confidence, status, status = 'uncertain' OR NOT consistent AS needs_review, {_FLAGS} AS flags FROM judged",
    garment_review_reasons: f"WITH {JUDGED} SELECT garment_id, array_to_string(list_sort(list_filter(string_split({_FLAGS} || CASE WHEN seg_missing OR seg_filled THEN ',color_measured_without_mask' ELSE '' END, ','), lambda x: x <> '')), ',') AS reasons FROM judged WHERE status = 'uncertain' OR NOT consistent",
    rule_hit_counts: f"WITH {JUDGED} {_HITS}",
    rule_messages: f"WITH {JUDGED} " + " UNION ALL ".join(f"SELECT garment_id, '{code}' AS code, {detail} AS detail FROM fired WHERE r{k + 1}" for k, (code, detail) in enumerate(MESSAGES)),
    color_source_agreement: "SELECT g.color, a.family = b.family AS agree, count(*) AS n FROM garments g JOIN v_color a ON a.label = g.color JOIN v_color b ON b.label = g.zero_shot_color GROUP BY 1, 2",
    report_floor: "SELECT " + ", ".join(f"count(CASE WHEN {a}_conf >= 0.2 THEN {a} END) AS {a}" for a in ATTRS) + " FROM garments",
    category_gate: """WITH g AS (SELECT *, detector_conf >= 0.45 AND coarse_label <> 'other' AS gate_applied, CASE WHEN garment_id % 2 = 0 THEN 'jeans' ELSE 'dress' END AS alt FROM garments),
      n AS (SELECT g.*, a.grp AS alt_grp FROM g JOIN v_category a ON a.label = g.alt),
      c AS (SELECT *, CASE WHEN gate_applied AND category_group <> coarse_label AND alt_grp = coarse_label THEN alt ELSE category END AS gated FROM n)
      SELECT gate_applied, gated <> category AS corrected, v.grp AS gated_group, count(*) AS n FROM c JOIN v_category v ON v.label = c.gated GROUP BY 1, 2, 3""",
    retry_resolution: """WITH a AS (SELECT *, lag(wants_retry) OVER w AS asked, lag(confidence) OVER w AS prev FROM attempts WHERE attempt <= 4 WINDOW w AS (PARTITION BY garment_id ORDER BY attempt)),
      b AS (SELECT *, sum(CASE WHEN coalesce(asked, true) AND coalesce(confidence > prev, true) THEN 0 ELSE 1 END) OVER (PARTITION BY garment_id ORDER BY attempt) AS broken FROM a),
      k AS (SELECT *, row_number() OVER (PARTITION BY garment_id ORDER BY attempt DESC) AS r FROM b WHERE broken = 0)
      SELECT garment_id, CAST(attempt AS BIGINT) AS attempt, confidence, CAST(attempt + CASE WHEN wants_retry AND attempt <= 3 THEN 1 ELSE 0 END AS BIGINT) AS attempts FROM k WHERE r = 1""",
    retry_boxes: """WITH a AS (SELECT *, lag(wants_retry) OVER w AS asked, lag(confidence) OVER w AS prev FROM attempts WHERE attempt <= 4 WINDOW w AS (PARTITION BY garment_id ORDER BY attempt)),
      b AS (SELECT *, sum(CASE WHEN coalesce(asked, true) AND coalesce(confidence > prev, true) THEN 0 ELSE 1 END) OVER (PARTITION BY garment_id ORDER BY attempt) AS broken FROM a),
      k AS (SELECT *, row_number() OVER (PARTITION BY garment_id ORDER BY attempt DESC) AS r FROM b WHERE broken = 0)
      SELECT garment_id, CAST(attempt AS BIGINT) AS attempt, d.x1, d.y1, d.x2, d.y2, CAST(attempt + CASE WHEN wants_retry AND attempt <= 3 THEN 1 ELSE 0 END AS BIGINT) AS attempts FROM k JOIN detections d ON d.image_id = k.garment_id AND d.det_no = 1 WHERE r = 1""",
    retry_decisions: f"WITH {JUDGED} SELECT status, garment_id % 3 < 2 AND (status = 'uncertain' OR 1 - detector_conf >= 0.62 OR style_conf < 0.12 OR NOT consistent) AS retry, count(*) AS n FROM judged GROUP BY 1, 2",
    image_quality_verdicts: f"""WITH {_ISSUES} SELECT garment_id, array_to_string(l, ',') AS issues, round(CAST(greatest(0, 1 - coalesce(list_sum(list_transform(l, lambda x:
      CASE split_part(x, ':', 1) WHEN 'low_resolution' THEN 0.35 WHEN 'blurry' THEN 0.30 WHEN 'low_contrast' THEN 0.20 WHEN 'no_foreground' THEN 1.0 ELSE 0.25 END
      * CASE split_part(x, ':', 2) WHEN 'error' THEN 1.5 ELSE 1 END)), 0)) AS DOUBLE), 4) AS score, len(list_filter(l, lambda x: contains(x, ':error'))) = 0 AS usable FROM i""",
    color_naming: NAMING,
    flattened_results: """SELECT CAST(image_id AS VARCHAR) AS request_id, true AS success, row_number() OVER (PARTITION BY image_id ORDER BY garment_id) - 1 AS position, format('garment_{:03d}', garment_id) AS id, category FROM garments WHERE image_id % 50 <> 0
      UNION ALL SELECT DISTINCT CAST(image_id AS VARCHAR), false, CAST(NULL AS BIGINT), NULL, NULL FROM garments WHERE image_id % 50 = 0""",
    prediction_rows: "WITH " + ", ".join(f"q_{a} AS (SELECT '{a}' AS attribute, {a} AS value, {a}_conf AS c FROM garments WHERE {a} IS NOT NULL AND image_id % 50 <> 0)" for a in ATTRS)
    + ", q AS (" + " UNION ALL ".join(f"SELECT * FROM q_{a}" for a in ATTRS) + ") SELECT attribute, value, value AS label, count(*) AS n, round(sum(c), 4) AS score FROM q GROUP BY 1, 2 UNION ALL SELECT attribute, value, 'rest', count(*), round(sum(1 - c), 4) FROM q GROUP BY 1, 2",
    color_spreads: "SELECT garment_id, round(abs(color_share - seg_quality) / 2, 6) AS spread FROM garments",
    color_distances: "SELECT garment_id, round(sqrt(pow(category_conf - style_conf, 2) + pow(material_conf - color_share, 2) + pow(pattern_conf - detector_conf, 2)), 6) AS distance FROM garments",
    hex_round_trip: """WITH h AS (SELECT item_id, CAST(item_id * 7919 % 16777216 AS INT) AS v FROM items)
      SELECT item_id, format('#{:06x}', v) AS hex, v // 65536 AS r, v // 256 % 256 AS g, v % 256 AS b, format('#{:06x}', v) AS again FROM h""",
}
