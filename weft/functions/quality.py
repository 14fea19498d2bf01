"""Verdict on a photo from its measured metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the quality gate, and the weight of each issue (errors weigh 1.5 times).
MIN_SHORT_EDGE, BLUR_FLOOR, DARK_MEAN, BRIGHT_MEAN, LOW_CONTRAST, MIN_FOREGROUND = 160, 60.0, 28.0, 236.0, 18.0, 0.02
WEIGHTS = {"low_resolution": 0.35, "blurry": 0.30, "too_dark": 0.25, "too_bright": 0.25, "low_contrast": 0.20, "no_foreground": 1.00}
ERROR_FACTOR = 1.5


def quality_issues(width: Column, height: Column, brightness: Column, contrast: Column, sharpness: Column, foreground: Column) -> Column:
    """array of struct<code, severity, measured, threshold>, in the order of the checks."""
    edge = F.least(width, height).cast("double")

    def issue(code: str, bad: Column, severe: Column, measured: Column, threshold: float) -> Column:
        kind = F.when(severe, "error").otherwise("warning")
        return F.when(bad, F.struct(F.lit(code).alias("code"), kind.alias("severity"), measured.alias("measured"), F.lit(float(threshold)).alias("threshold")))

    never = F.lit(False)
    found = F.array(
        issue("low_resolution", edge < MIN_SHORT_EDGE, edge < MIN_SHORT_EDGE / 2, edge, MIN_SHORT_EDGE),
        issue("too_dark", brightness < DARK_MEAN, brightness < DARK_MEAN / 2, F.bround(brightness, 2), DARK_MEAN),
        issue("too_bright", brightness > BRIGHT_MEAN, never, F.bround(brightness, 2), BRIGHT_MEAN),
        issue("blurry", sharpness < BLUR_FLOOR, never, F.bround(sharpness, 2), BLUR_FLOOR),
        issue("low_contrast", contrast < LOW_CONTRAST, never, F.bround(contrast, 2), LOW_CONTRAST),
        issue("no_foreground", foreground < MIN_FOREGROUND, F.lit(True), F.bround(foreground, 4), MIN_FOREGROUND),
    )
    return F.filter(found, lambda x: x.isNotNull())


def quality_score(issues: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for item in WEIGHTS.items() for x in item])
    total = F.aggregate(issues, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(weights, x["code"]), F.lit(0.1)) * F.when(x["severity"] == "error", ERROR_FACTOR).otherwise(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - total))


def usable(issues: Column) -> Column:
    return ~F.exists(issues, lambda x: x["severity"] == "error")
