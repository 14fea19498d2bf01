"""Confidence of a garment: colour score, fused score, status, review and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of each attribute, and the constants of the discounts.
WEIGHTS = {"category": 0.38, "color": 0.26, "pattern": 0.16, "style": 0.10, "material": 0.10}
DETECTOR_WEIGHT, FILLED_MALUS, NO_CATEGORY, PENALTY_CAP = 0.12, 0.10, 0.45, 0.6
USABLE_MASK, MASK_SENSITIVITY, ENTROPY_GUARD, MARGIN_GUARD = 0.45, 0.45, 0.62, 0.12
ACCEPT, UNCERTAIN, REPORT_FLOOR = 0.70, 0.45, 0.20


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def color_score(primary: Column, share: Column, mask_missing: Column, filled: Column, quality: Column) -> Column:
    """Score of a measured colour; null if no colour was measured."""
    base = F.when(primary == "unknown", 0.25).when(primary == "multicolor", 0.45).otherwise(F.least(F.lit(0.95), 0.60 + 0.40 * F.coalesce(share, F.lit(0.0))))
    scale = 1.0 - MASK_SENSITIVITY * (USABLE_MASK - quality) / USABLE_MASK
    factor = F.when(mask_missing, 0.75).when(filled, 0.55).when(quality < USABLE_MASK, scale).otherwise(1.0)
    return F.when(primary.isNotNull(), clip(base * factor))


def fused_confidence(scores: dict[str, Column], detector: Column, filled: Column, penalty: Column, penalty_scale: float = 1.0) -> Column:
    """Weighted mean of the attributes that are present, eroded by mask, missing category and penalties; 0 if none is present."""
    weight = sum((F.when(c.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, c in scores.items()), F.lit(0.0))
    total = sum((F.coalesce(c, F.lit(0.0)) * WEIGHTS[k] for k, c in scores.items()), F.lit(0.0))
    mixed = DETECTOR_WEIGHT * detector + (1.0 - DETECTOR_WEIGHT) * total / F.nullif(weight, F.lit(0.0))
    mixed = mixed * F.when(F.coalesce(filled, F.lit(False)), 1.0 - FILLED_MALUS).otherwise(1.0)
    mixed = mixed * F.when(scores["category"].isNull(), 1.0 - NO_CATEGORY).otherwise(1.0)
    mixed = mixed * (1.0 - F.least(F.lit(PENALTY_CAP), penalty * penalty_scale))
    return F.when(weight > 0, clip(mixed)).otherwise(0.0)


def status(confidence: Column, accept: float = ACCEPT, uncertain: float = UNCERTAIN) -> Column:
    return F.when(confidence >= accept, "accepted").when(confidence >= uncertain, "accepted_with_uncertainty").otherwise("uncertain")


def needs_review(status_: Column, consistent: Column, category: Column) -> Column:
    return (status_ == "uncertain") | ~consistent | category.isNull()


def review_reasons(flags: Column, color_flags: Column, category: Column) -> Column:
    missing = F.when(category.isNull(), F.array(F.lit("category_missing"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(flags, color_flags, missing)))


def should_retry(status_: Column, entropy: Column, margin: Column, attempt: Column, consistent: Column, max_retries: int = 1) -> Column:
    wanted = (status_ == "uncertain") | (entropy >= ENTROPY_GUARD) | (margin < MARGIN_GUARD) | ~consistent
    return (attempt - 1 < max_retries) & wanted


def reportable(value: Column, confidence: Column, floor: float = REPORT_FLOOR) -> Column:
    """The value, or null if it is absent or its confidence below the floor (a NaN is below)."""
    return F.when((confidence >= floor) & ~F.isnan(confidence), value)


def storable(confidence: Column, floor: float = REPORT_FLOOR) -> Column:
    """Finite and at the floor or above; NaN is the greatest number to Spark, hence the test."""
    finite = ~F.isnan(confidence) & (confidence < float("inf")) & (confidence > float("-inf"))
    return F.coalesce(finite & (confidence >= floor), F.lit(False))


def normalised_entropy(probabilities: Column) -> Column:
    """Entropy of an array of probabilities over that of as many equal ones; 0 for fewer than two."""
    n = F.size(probabilities)
    raw = F.aggregate(probabilities, F.lit(0.0), lambda s, p: s - p * F.log(p + 1e-12))
    return F.when(n < 2, 0.0).otherwise(clip(raw / F.log(n.cast("double"))))


def margin(probabilities: Column) -> Column:
    """First minus second of an array of probabilities; 1.0 for fewer than two."""
    ordered = F.sort_array(probabilities, asc=False)
    return F.when(F.size(probabilities) < 2, 1.0).otherwise(F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1)))
