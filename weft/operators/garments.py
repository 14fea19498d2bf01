"""Fusion, rules and confidence of analysed garments: wide rows in, wide rows out, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import rules as R
from weft.functions import scoring as S
from weft.functions.color import colors_agree
from weft.operators.detect import BOX

#: The detector score from which its group gates the category.
GATE_SCORE = 0.45
#: The most labels of a vocabulary.
MAX_LABELS = 1_000


def gate_category(df: DataFrame, groups: DataFrame, scores: Column | None = None, allow_correction: bool = True) -> DataFrame:
    """Adds gated_category, gated_group and gate_applied.

    df: category, detector_group, detector_conf; groups: label, grp (a vocabulary, at most MAX_LABELS), which becomes a literal of the plan.
    scores: a map label -> score; with it a category outside the detected group becomes
    the best label inside it.  The confidence stays that of the old label.
    """
    known = [(r["label"], r["grp"]) for r in groups.limit(MAX_LABELS + 1).collect()]
    if len(known) > MAX_LABELS:
        raise ValueError(f"a vocabulary has at most {MAX_LABELS} labels")
    group_of = F.create_map(*[F.lit(x) for pair in known for x in pair])
    group = lambda c: F.coalesce(F.try_element_at(group_of, c), F.lit("other"))
    gate = F.col("category").isNotNull() & (F.col("detector_conf") >= GATE_SCORE) & F.lit(allow_correction) & (F.col("detector_group") != "other")
    gate = F.coalesce(gate, F.lit(False))
    new = F.col("category")
    if scores is not None:
        labels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("label"), F.lit(g).alias("grp")) for i, (name, g) in enumerate(known)])
        inside = F.filter(labels, lambda x: (x["grp"] == F.col("detector_group")) & F.map_contains_key(scores, x["label"]))
        best = F.array_min(F.transform(inside, lambda x: F.struct((-F.try_element_at(scores, x["label"])).alias("s"), x["i"].alias("i"), x["label"].alias("label"))))["label"]
        new = F.when(gate & (group(F.col("category")) != F.col("detector_group")), F.coalesce(best, F.col("category"))).otherwise(F.col("category"))
    out = df.withColumn("gated_category", new).withColumn("gate_applied", gate)
    return out.withColumn("gated_group", group(F.col("gated_category")))


def garment_context(df: DataFrame) -> dict[str, Column]:
    """Rule context of rows of the garment view: the zero-shot colour stands in as secondary colour where it differs."""
    c = F.col
    same = F.coalesce(c("zero_shot_color") == c("color"), F.lit(True))
    return {
        "category": c("category"), "material": c("material"), "pattern": c("pattern"), "measured_color": c("color"), "zeroshot_color": c("zero_shot_color"),
        "secondary_colors": F.when(same, F.array().cast("array<string>")).otherwise(F.array("zero_shot_color")),
        "color_spread": F.when(same, 0.0).otherwise(F.abs(2 * c("color_share") - 1) / 2),
        "coarse_label": c("coarse_label"), "detector_group": c("coarse_label"), "category_group": c("category_group"),
        "gate_applied": F.coalesce((c("detector_conf") >= GATE_SCORE) & (c("coarse_label") != "other") & (c("coarse_label") == c("category_group")), F.lit(False)),
        "segmentation_filled": c("seg_filled"),
    }


def judge_garments(df: DataFrame, rules: list[R.Rule] = R.RULES) -> DataFrame:
    """Adds fired, flags, penalty, consistent, color_conf, confidence, status, needs_review, review_reason."""
    out = df.withColumn("fired", R.fired_rules(garment_context(df), rules))
    out = out.withColumns({"flags": R.flags(F.col("fired")), "penalty": R.total_penalty(F.col("fired")), "consistent": R.consistent(F.col("fired"))})
    out = out.withColumn("color_conf", S.color_score(F.col("color"), F.col("color_share"), F.col("seg_missing"), F.col("seg_filled"), F.col("seg_quality")))
    scores = {a: F.when(F.col(a).isNotNull(), F.col(f"{a}_conf")) for a in ("category", "pattern", "style", "material")} | {"color": F.col("color_conf")}
    filled = F.col("seg_filled") & ~F.col("seg_missing")
    out = out.withColumn("confidence", S.fused_confidence(scores, F.col("detector_conf"), filled, F.col("penalty")))
    out = out.withColumn("status", S.status(F.col("confidence")))
    unmasked = F.when(F.col("color").isNotNull() & (F.col("seg_missing") | F.col("seg_filled")), F.array(F.lit("color_measured_without_mask"))).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"needs_review": S.needs_review(F.col("status"), F.col("consistent"), F.col("category")), "review_reason": S.review_reasons(F.col("flags"), unmasked, F.col("category"))})


def color_agreement(df: DataFrame) -> DataFrame:
    return df.withColumn("agree", colors_agree(F.col("color"), F.col("zero_shot_color")))


def apply_report_floor(df: DataFrame, attributes: list[str], floor: float = S.REPORT_FLOOR) -> DataFrame:
    """Weak attributes become null; colour is exempt."""
    return df.withColumns({a: S.reportable(F.col(a), F.col(f"{a}_conf"), floor) for a in attributes})


def resolve_retries(attempts: DataFrame, max_retries: int = 3, carry: list[str] | None = None) -> DataFrame:
    """garment_id, attempt, confidence, attempts of the kept pass, from (garment_id, attempt, confidence, wants_retry), and the columns `carry` of the first pass.

    Pass n + 1 counts only if every pass up to n asked for a retry and improved on the one before; attempts also counts the retry that was not better.
    A retry looks at another view of the same garment, so what says where the garment is (`carry`: by default the box, where there is one) is that of the original detection.
    """
    carry = [c for c in BOX if c in attempts.columns] if carry is None else carry
    w = Window.partitionBy("garment_id").orderBy("attempt")
    before = attempts.where(F.col("attempt") <= max_retries + 1)
    steps = before.withColumns({"asked": F.coalesce(F.lag("wants_retry").over(w), F.lit(True)), "better": F.coalesce(F.col("confidence") > F.lag("confidence").over(w), F.lit(True)), "gap": F.coalesce(F.col("attempt") - F.lag("attempt").over(w) != 1, F.col("attempt") != 1)})
    steps = steps.withColumn("broken", F.sum(F.when(F.col("asked") & F.col("better") & ~F.col("gap"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = [F.min_by(F.struct(*carry), "attempt").alias("first")] if carry else []
    kept = steps.where("broken = 0").groupBy("garment_id").agg(F.max_by(F.struct("attempt", "confidence", "wants_retry"), "attempt").alias("k"), *first)
    more = F.when(F.col("k.wants_retry") & (F.col("k.attempt") <= max_retries), 1).otherwise(0)
    return kept.select("garment_id", "k.attempt", "k.confidence", (F.col("k.attempt") + more).alias("attempts"), *[f"first.{c}" for c in carry])


def rule_counts(judged: DataFrame) -> DataFrame:
    return judged.select(F.explode("fired").alias("f")).groupBy("f.code", "f.severity").agg(F.count(F.lit(1)).alias("n"))


def status_report(judged: DataFrame) -> DataFrame:
    return judged.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.round(F.avg(F.col("needs_review").cast("int")), 4).alias("review_share")
    )
