"""Detections of a photo: overlaps, suppression, filters, fallback, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.geometry import area, iou

BOX = ["x1", "y1", "x2", "y2"]
#: What each speed profile makes of the least score and the most garments.
PROFILES = {"standard": (0.0, 0.0, None, None), "fast": (0.0, 0.0, 4, None), "thorough": (-0.15, 0.15, None, 8)}


def profile_limits(profile: str, min_score: float, max_items: int) -> tuple[float, int]:
    shift, floor, most, least = PROFILES[profile]
    items = min(max_items, most) if most else max_items
    return (max(floor, min_score + shift) if shift else min_score), (max(items, least) if least else items)


def filter_by_profile(kept: DataFrame, profile: str, min_score: float, min_ratio: float, max_ratio: float, max_items: int) -> DataFrame:
    """filter_detections() with the score and the number of garments that a speed profile makes of the given ones."""
    least, most = profile_limits(profile, min_score, max_items)
    return filter_detections(kept, least, min_ratio, max_ratio, most)


def coarse_label(label: Column, groups: dict[str, str]) -> Column:
    """The coarse group of a detector's label, trimmed and lower-cased; `other` for one that `groups` lacks."""
    known = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair]) if groups else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(label))), F.lit("other"))


#: Boxes from which a photo is crowded, and the most cells along a side of its grid.
CROWD, GRID = 64, 32


def _pairs(boxes: DataFrame, on: list[str]) -> DataFrame:
    """Overlapping pairs of boxes that are equal in `on`, a before b."""
    a = boxes.select(*on, F.col("det_no").alias("det_a"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = boxes.select(*on, F.col("det_no").alias("det_b"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    overlap = iou(tuple(F.col(f"a_{c}") for c in BOX), tuple(F.col(f"b_{c}") for c in BOX))
    return a.join(b, on).where("det_a < det_b").withColumn("iou", overlap).where("iou > 0")


def box_cells(crowded: DataFrame) -> DataFrame:
    """The boxes of crowded photos (with left, above and side of the photo's grid) once for each cell (cx, cy) that they reach into."""
    place = lambda c, begin: F.floor((F.col(c) - F.col(begin)) / F.col("side")).cast("int")
    wide = crowded.withColumn("cx", F.explode(F.sequence(place("x1", "left"), place("x2", "left"))))
    return wide.withColumn("cy", F.explode(F.sequence(place("y1", "above"), place("y2", "above"))))


def pairwise_iou(detections: DataFrame) -> DataFrame:
    """image_id, det_a, det_b, iou for the overlapping pairs of a photo's boxes (a before b).

    A photo of more than CROWD boxes is cut into cells about as large as its boxes are in the mean, at most GRID along a side, and its pairs
    are met in cells, each a group of its own.  A pair that shares several cells counts in the one that holds the
    upper left corner of its overlap, so it comes once.  Boxes without an area overlap nothing.
    """
    boxes = detections.select("image_id", "det_no", *BOX).where("x2 > x1 and y2 > y1")
    extent = F.greatest(F.max("x2") - F.min("x1"), F.max("y2") - F.min("y1"))
    mean = F.greatest(F.avg(F.col("x2") - F.col("x1")), F.avg(F.col("y2") - F.col("y1")))
    photos = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.min("x1").alias("left"), F.min("y1").alias("above"), F.greatest(mean, extent / GRID).alias("side"))
    crowded = photos.where(F.col("n") > CROWD).select("image_id", "left", "above", "side")
    few = _pairs(boxes.join(crowded, "image_id", "left_anti"), ["image_id"])
    many = _pairs(box_cells(boxes.join(crowded, "image_id")), ["image_id", "left", "above", "side", "cx", "cy"])
    corner = lambda c, begin: F.floor((F.greatest(f"a_{c}", f"b_{c}") - F.col(begin)) / F.col("side"))
    many = many.where((F.col("cx") == corner("x1", "left")) & (F.col("cy") == corner("y1", "above")))
    columns = ["image_id", "det_a", "det_b", "iou"]
    return few.select(columns).union(many.select(columns))


def suppress(detections: DataFrame, threshold: float = 0.6, min_score: float = 0.0) -> DataFrame:
    """The detections that greedy class-agnostic suppression keeps, for each photo, best score first.

    A box is kept if no box kept before it overlaps it by more than the threshold: a fold
    over a photo's few boxes inside one row.  The score filter goes first, as a box only
    ever suppresses lower ones.  Equal scores go by box, then number.
    """
    order = F.struct((-F.col("score")).alias("s"), "x1", "y1", "det_no")
    boxes = detections.where(F.col("score") >= min_score).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), F.struct(*detections.columns).alias("row")))).alias("b"))
    rows = F.transform("b", lambda x: x["row"])
    kind = detections.select(F.array(F.struct(*detections.columns)).alias("a")).schema["a"].dataType
    box = lambda x: tuple(x[c] for c in BOX)
    kept = F.aggregate(rows, F.array().cast(kind), lambda seen, x: F.when(F.exists(seen, lambda y: iou(box(x), box(y)) > threshold), seen).otherwise(F.concat(seen, F.array(x))))
    return boxes.select(F.explode(kept).alias("k")).select("k.*")


def filter_detections(kept: DataFrame, min_score: float, min_ratio: float, max_ratio: float, max_items: int) -> DataFrame:
    """Score and area filters, largest first, capped and named garment_001, ..., for each photo."""
    sized = kept.withColumn("area", area(*[F.col(c) for c in BOX]))
    ratio = F.col("area") / (F.col("img_w") * F.col("img_h"))
    order = Window.partitionBy("image_id").orderBy(F.desc("area"), F.desc("score"), "x1", "y1", "det_no")
    named = sized.where((F.col("score") >= min_score) & (ratio >= min_ratio) & (ratio <= max_ratio)).withColumn("position", F.row_number().over(order))
    return named.where(F.col("position") <= max_items).withColumn("garment_id", F.format_string("garment_%03d", "position"))


def with_fallback(primary: DataFrame, fallback: DataFrame, min_area: float = 0.08, enabled: bool = True) -> DataFrame:
    """Primary boxes, and for photos without any the best fallback box that is large enough."""
    if not enabled:
        return primary.withColumn("source", F.lit("primary"))
    ratio = area(*[F.col(c) for c in BOX]) / (F.col("img_w") * F.col("img_h"))
    best = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_no")
    spare = fallback.where(ratio >= min_area).join(primary.select("image_id").distinct(), "image_id", "left_anti")
    spare = spare.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    return primary.withColumn("source", F.lit("primary")).unionByName(spare.withColumn("source", F.lit("fallback")))


def best_masks(candidates: DataFrame, min_pixels: int = 64) -> DataFrame:
    """One mask candidate for each garment: 0.7 of its overlap with the box and 0.3 of its own score; the first on a tie.

    candidates: garment_id, candidate, area_px, box_px, both_px, head.
    """
    union = F.col("area_px") + F.col("box_px") - F.col("both_px")
    combined = 0.7 * F.when(union > 0, F.col("both_px") / union).otherwise(0.0) + 0.3 * F.col("head")
    ranked = candidates.where((F.col("area_px") >= min_pixels) & (F.col("box_px") > 0)).withColumn("combined", combined)
    return ranked.groupBy("garment_id").agg(F.max_by(F.struct("candidate", "combined", "head"), F.struct("combined", -F.col("candidate"))).alias("m")).select("garment_id", "m.*")
