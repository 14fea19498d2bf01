"""Boxes, masks and retry views as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degenerate masks, weights of the mask quality, and the limits of retry views.
MIN_COVERAGE, MAX_COVERAGE, FILLED_QUALITY = 0.08, 0.99, 0.25
INSET, TIGHTEN_BELOW, MIN_SIDE = 0.12, 0.45, 48
DARK_BELOW, LIGHT_TARGET = 72.0, 118.0


def side(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b - a)


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return side(x1, x2) * side(y1, y2)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of two boxes (x1, y1, x2, y2); 0 if both are empty."""
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - inter
    return F.when(union > 0, inter / F.greatest(union, F.lit(1e-6))).otherwise(0.0)


def pad_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, ratio: float) -> list[Column]:
    """The box grown by a share of the frame on each side, within the frame."""
    keep = lambda v, most: F.greatest(F.lit(0.0), F.least(most, v))
    return [keep(x1 - width * ratio, width), keep(y1 - height * ratio, height), keep(x2 + width * ratio, width), keep(y2 + height * ratio, height)]


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> list[Column]:
    """Whole pixels within the frame, one at least."""
    left = F.greatest(F.lit(0), F.least(x1.cast("int"), (width - 1).cast("int")))
    top = F.greatest(F.lit(0), F.least(y1.cast("int"), (height - 1).cast("int")))
    return [left, top, F.greatest(left + 1, F.least(x2.cast("int"), width.cast("int"))), F.greatest(top + 1, F.least(y2.cast("int"), height.cast("int")))]


def mask_row_in_crop(y: Column, box: list[Column], mask_height: Column, height: Column) -> Column:
    """Row of a mask (of any height) that a crop's row y shows, by nearest pixel; `box` of crop_box().  Columns go alike, with box[0] and the widths."""
    return F.least(F.floor((y + box[1]) * mask_height / height), mask_height - 1).cast("int")


def mask_quality(predicted_iou: Column, coverage: Column, solidity: Column) -> Column:
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    head = F.coalesce(clip(predicted_iou), F.lit(0.5))
    fit = 1.0 - F.least(F.lit(1.0), F.abs(coverage - 0.75) / 0.75)
    return clip(0.55 * head + 0.30 * fit + 0.15 * solidity)


def mask_degenerate(coverage: Column) -> Column:
    return coverage.isNull() | (coverage < MIN_COVERAGE) | (coverage > MAX_COVERAGE)


def tightened_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """struct<x1, y1, x2, y2> drawn in on each side; null for a box too large or too small for it."""
    w, h = x2 - x1, y2 - y1
    new = [
        F.least(F.greatest(F.lit(0.0), x1 + w * INSET), width - 1.0),
        F.least(F.greatest(F.lit(0.0), y1 + h * INSET), height - 1.0),
        F.greatest(F.least(width, x2 - w * INSET), F.lit(1.0)),
        F.greatest(F.least(height, y2 - h * INSET), F.lit(1.0)),
    ]
    small = area(x1, y1, x2, y2) / F.greatest(F.lit(1.0), width * height) < TIGHTEN_BELOW
    sides = (w >= MIN_SIDE) & (h >= MIN_SIDE) & (side(new[0], new[2]) >= MIN_SIDE) & (side(new[1], new[3]) >= MIN_SIDE)
    return F.when(small & sides, F.struct(*[c.alias(n) for c, n in zip(new, ("x1", "y1", "x2", "y2"))]))


def brighten_gamma(mean_luminance: Column) -> Column:
    """Gamma of the brightened view; null for a photo that is not dark (an absent luminance is not)."""
    luma = F.coalesce(mean_luminance, F.lit(255.0))
    level = F.greatest(F.lit(0.35), F.least(F.lit(1.0), luma / LIGHT_TARGET))
    return F.when(luma < DARK_BELOW, F.greatest(F.lit(0.4), F.least(F.lit(1.0), F.pow(level, F.lit(0.45)))))
