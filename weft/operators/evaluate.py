"""Evaluation of results against annotations: outcomes, accuracy, detection, calibration, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.ranks import nearest_rank

ATTRIBUTES = ["category", "color", "pattern", "style", "material"]
BUCKETS = ["detector_missed_garment", "detector_found_something_in_a_non_garment", "wrong_category", "wrong_colour", "wrong_pattern", "wrong_style", "wrong_material", "abstained_on_a_garment", "over_confident", "under_confident", "crashed"]
#: Buckets that call for advice, in the order in which it is given.
ADVICE = ["detector_found_something_in_a_non_garment", "crashed", "detector_missed_garment", "wrong_category", "wrong_colour", "over_confident", "under_confident", "abstained_on_a_garment"]


def join_results(annotations: DataFrame, results: DataFrame, files: DataFrame) -> DataFrame:
    """A row for each annotation with its result, and `skipped`: why it takes no part (null for those that do).

    annotations: id, file, split, no_clothing, truth_*; results: file, n_items, pred_*, confidence, latency_ms, attempts, error;
    files: file, of the photos that are there.  An annotation of an absent photo is skipped, and so is one without a
    result; one whose analysis ended in an error stays, as crashed.
    """
    there = files.select("file").distinct().withColumn("there", F.lit(True))
    joined = annotations.join(there, "file", "left").join(results.withColumn("analysed", F.lit(True)), "file", "left")
    reason = F.when(F.col("there").isNull(), "image not found").when(F.col("analysed").isNull(), "no result")
    return joined.withColumn("skipped", reason).drop("there", "analysed")


def outcomes(rows: DataFrame) -> DataFrame:
    """Adds outcome (negative_hit, negative_rejected, miss, crashed, scored), status, needs_review, and labelled / correct by attribute.

    rows: id, no_clothing, n_items, truth_*, pred_*, confidence, latency_ms, attempts; error (optional, a crash).
    """
    crashed = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    outcome = F.when(crashed, "crashed").when(F.col("no_clothing") & (F.col("n_items") > 0), "negative_hit").when(F.col("no_clothing"), "negative_rejected").when(F.col("n_items") == 0, "miss").otherwise("scored")
    status = F.when(F.col("confidence") >= 0.70, "accepted").when(F.col("confidence") >= 0.45, "accepted_with_uncertainty").otherwise("uncertain")
    return rows.withColumns({"outcome": outcome, "status": status, "needs_review": status == "uncertain"})


def attribute_rows(out: DataFrame) -> DataFrame:
    """Long rows of scored photos: id, split, attribute, truth, pred, labelled, correct, confidence."""
    parts = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"truth_{a}").alias("truth"), F.col(f"pred_{a}").alias("pred")) for a in ATTRIBUTES])
    keep = [c for c in ("id", "split", "confidence", "needs_review") if c in out.columns]
    rows = out.where("outcome = 'scored'").select(*keep, F.explode(parts).alias("a")).select(*keep, "a.*")
    return rows.withColumns({"labelled": F.col("truth").isNotNull(), "correct": F.coalesce(F.col("truth") == F.col("pred"), F.lit(False))})


def accuracy(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """attribute, correct, total, unlabelled, withheld, accuracy (0 without labels)."""
    total = F.count_if("labelled")
    return long.groupBy(*(by or []), "attribute").agg(
        F.count_if(F.col("labelled") & F.col("correct")).alias("correct"), total.alias("total"), F.count_if(~F.col("labelled")).alias("unlabelled"),
        F.count_if(F.col("labelled") & F.col("pred").isNull()).alias("withheld"),
        F.when(total > 0, F.round(F.count_if(F.col("labelled") & F.col("correct")) / total, 4)).otherwise(0.0).alias("accuracy"),
    )


def most_confused(long: DataFrame, k: int = 10) -> DataFrame:
    """attribute, truth, pred, n, rank: the k pairs most often confused; withheld is `<none>`."""
    pairs = long.where("labelled and not correct").groupBy("attribute", "truth", F.coalesce("pred", F.lit("<none>")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("n"), "truth", "pred"))).where(F.col("rank") <= k)


def confusion(long: DataFrame, attribute: str) -> DataFrame:
    """truth, pred, n; withheld is `<withheld>`."""
    return long.where((F.col("attribute") == attribute) & F.col("labelled")).groupBy("truth", F.coalesce("pred", F.lit("<withheld>")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, F.round(a / b, 4)).otherwise(empty)


def detection_counts(out: DataFrame, by: list[str] | None = None) -> DataFrame:
    """images, tp, fp, fn, precision, recall, f1, false_positive_rate; by groups if asked for."""
    rows = out.groupBy(*by) if by else out.groupBy()
    counted = rows.agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("outcome") == "scored").alias("tp"), F.count_if(F.col("outcome").isin("miss", "crashed")).alias("fn"),
        F.sum(F.when(F.col("outcome") == "negative_hit", F.col("n_items")).when(F.col("outcome") == "scored", F.col("n_items") - 1).otherwise(0)).cast("long").alias("fp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "false_positive_rate": _ratio(fp, tp + fp)})


def honesty_rates(out: DataFrame) -> DataFrame:
    """evaluated, negatives, rejection_rate (1.0 without negatives), auto_accept_rate, review_rate, without_labels, retries, passes."""
    scored = F.col("outcome") == "scored"
    negatives, evaluated = F.count_if("no_clothing"), F.count_if(scored)
    empty = F.lit(True)
    for a in ATTRIBUTES:
        empty = empty & F.col(f"truth_{a}").isNull()
    return out.agg(
        evaluated.alias("evaluated"), negatives.alias("negatives"), _ratio(F.count_if(F.col("outcome") == "negative_rejected"), negatives, 1.0).alias("rejection_rate"),
        _ratio(F.count_if(scored & (F.col("status") != "uncertain")), evaluated).alias("auto_accept_rate"), _ratio(F.count_if(scored & F.col("needs_review")), evaluated).alias("review_rate"),
        F.count_if(scored & empty).alias("without_labels"), F.count_if(scored & (F.col("attempts") > 1)).alias("retries"), F.sum(F.when(scored, F.col("attempts"))).cast("long").alias("passes"),
    )


def latency(out: DataFrame) -> DataFrame:
    """mean_ms and nearest-rank p95_ms of scored photos."""
    return nearest_rank(out.where("outcome = 'scored'"), "latency_ms", 0.95, [], "p95_ms", mean_ms=F.round(F.avg("latency_ms"), 4))


def calibration(long: DataFrame, bins: int = 5) -> DataFrame:
    """bin, n, confidence, accuracy, gap over labelled attribute rows, with the item's confidence; the last bin is closed."""
    own = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    by = long.where("labelled").groupBy(own.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return by.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def calibration_error(long: DataFrame, bins: int = 5) -> DataFrame:
    return calibration(long, bins).agg(F.round(F.sum(F.col("gap") * F.col("n")) / F.sum("n"), 4).alias("calibration_error"))


def error_buckets(out: DataFrame) -> DataFrame:
    """Adds buckets: the names of the error buckets of each photo; the first wrong attribute counts alone."""
    wrong = [F.coalesce(F.col(f"truth_{a}").isNotNull() & ~F.coalesce(F.col(f"truth_{a}") == F.col(f"pred_{a}"), F.lit(False)), F.lit(False)) for a in ATTRIBUTES]
    right = [F.coalesce(F.col(f"truth_{a}") == F.col(f"pred_{a}"), F.lit(False)) for a in ATTRIBUTES]
    first = F.lit(None).cast("string")
    for a, w in reversed(list(zip(ATTRIBUTES, wrong))):
        first = F.when(w, f"wrong_{'colour' if a == 'color' else a}").otherwise(first)
    any_wrong, any_right = wrong[0], right[0]
    for w, r in zip(wrong[1:], right[1:]):
        any_wrong, any_right = any_wrong | w, any_right | r
    second = F.when(any_wrong & ~F.col("needs_review") & (F.col("confidence") > 0.7), "over_confident").when(any_right & F.col("needs_review"), "under_confident")
    scored = F.array(F.coalesce(first, F.when(~any_right, F.lit("abstained_on_a_garment"))), second)
    one = F.when(F.col("outcome") == "crashed", "crashed").when(F.col("outcome") == "miss", BUCKETS[0]).when(F.col("outcome") == "negative_hit", BUCKETS[1])
    hits = F.array_repeat(one, F.when(F.col("outcome") == "negative_hit", F.col("n_items")).otherwise(1).cast("int"))
    return out.withColumn("buckets", F.filter(F.when(F.col("outcome") == "scored", scored).otherwise(hits), lambda x: x.isNotNull()))


def bucket_counts(bucketed: DataFrame) -> DataFrame:
    return bucketed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def bucket_examples(bucketed: DataFrame, k: int = 25) -> DataFrame:
    """bucket, id, rank: the first k photos of each bucket by id."""
    rows = bucketed.select("id", F.explode("buckets").alias("bucket"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("id"))).where(F.col("rank") <= k)


def advice(counts: DataFrame) -> list[str]:
    """Codes of the buckets that call for advice, in order, from the bucket counts (at most one row a bucket); wording is the caller's."""
    some = {r["bucket"] for r in counts.where("n > 0").collect()}
    return [name for name in ADVICE if name in some]


def accuracy_rollup(long: DataFrame) -> DataFrame:
    """split, attribute, total, correct for every split and attribute, every split, and overall."""
    return long.where("labelled").rollup("split", "attribute").agg(F.count(F.lit(1)).alias("total"), F.count_if("correct").alias("correct"))
