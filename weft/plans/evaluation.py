"""Queries over annotations and results: checks, outcomes, accuracy, calibration, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import checks, evaluate
from weft.plans.fixtures import view

A = evaluate.ATTRIBUTES


def _out(spark, d):
    return evaluate.outcomes(view(spark, d, "eval_rows"))


def _long(spark, d):
    return evaluate.attribute_rows(_out(spark, d))


def duplicate_annotations(spark, d):
    return checks.duplicate_ids(view(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")))


def unknown_splits(spark, d):
    rows = view(spark, d, "eval_rows").withColumn("split", F.when(F.col("id") % 100 == 0, "holdout").otherwise(F.col("split")))
    return checks.unknown_splits(rows).select("id", "split")


def validation_negatives(spark, d):
    return checks.negatives(checks.by_split(view(spark, d, "eval_rows"), "val")).select("id", "n_items")


def missing_files(spark, d):
    rows = view(spark, d, "eval_rows").select("id", F.format_string("img-%d.png", "id").alias("file"))
    return checks.missing_files(rows, rows.where("id % 37 <> 0").select("file")).select("id")


def label_coverage(spark, d):
    return checks.label_coverage(view(spark, d, "eval_rows"), A)


def incomplete_accounts(spark, d):
    users = view(spark, d, "items").select("user_id").distinct()
    parts = {"profile": users.where("user_id % 7 <> 0"), "style_profile": users.where("user_id % 5 <> 0"), "wardrobe": view(spark, d, "wear_events").where("user_id % 11 <> 0")}
    return checks.incomplete_accounts(users, parts)


def outcome_counts(spark, d):
    return _out(spark, d).groupBy("split", "outcome", "status").agg(F.count(F.lit(1)).alias("n"))


def attribute_accuracy(spark, d):
    return evaluate.accuracy(_long(spark, d))


def most_confused(spark, d):
    return evaluate.most_confused(_long(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def detection_metrics(spark, d):
    return evaluate.detection_counts(_out(spark, d))


def detection_metrics_by_split(spark, d):
    return evaluate.detection_counts(_out(spark, d), ["split"])


def honesty_rates(spark, d):
    return evaluate.honesty_rates(_out(spark, d))


def latency_stats(spark, d):
    return evaluate.latency(_out(spark, d))


def calibration_bins(spark, d):
    return evaluate.calibration(_long(spark, d)).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def calibration_error(spark, d):
    return evaluate.calibration_error(_long(spark, d))


def color_confusion(spark, d):
    return evaluate.confusion(_long(spark, d), "color")


def _joined(spark, d):
    """Annotations joined with results; made up: every 37th photo is gone, every 53rd has no result, every 41st analysis crashed."""
    rows = view(spark, d, "eval_rows").withColumn("file", F.format_string("img-%d.png", "id"))
    told = rows.select("id", "file", "split", "no_clothing", *[f"truth_{a}" for a in A])
    crash = F.col("id") % 41 == 0
    results = rows.where("id % 53 <> 0").select("file", "n_items", *[f"pred_{a}" for a in A], "confidence", "latency_ms", "attempts", F.when(crash, "RuntimeError: decode").alias("error"))
    return evaluate.join_results(told, results, rows.where("id % 37 <> 0").select("file"))


def joined_outcomes(spark, d):
    out = evaluate.outcomes(_joined(spark, d).where("skipped is null"))
    return out.groupBy("split", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("n_items").alias("items"))


def joined_metrics(spark, d):
    return evaluate.detection_counts(evaluate.outcomes(_joined(spark, d).where("skipped is null")), ["split"])


def skipped_annotations(spark, d):
    return _joined(spark, d).where("skipped is not null").select("id", "skipped")


def detection_metrics_by_label(spark, d):
    labels = view(spark, d, "garments").select(F.col("garment_id").alias("id"), "coarse_label")
    return evaluate.detection_counts(evaluate.outcomes(view(spark, d, "eval_rows").join(labels, "id")), ["coarse_label"])


def accuracy_by_version(spark, d):
    """Made up: three model versions, by photo."""
    out = _out(spark, d).withColumn("split", F.format_string("v%d", F.col("id") % 3))
    return evaluate.accuracy(evaluate.attribute_rows(out).withColumnRenamed("split", "version"), ["version"])


def error_buckets(spark, d):
    return evaluate.bucket_counts(evaluate.error_buckets(_out(spark, d)))


def error_examples(spark, d):
    return evaluate.bucket_examples(evaluate.error_buckets(_out(spark, d)), 25).withColumn("rank", F.col("rank").cast("long"))


def accuracy_rollup(spark, d):
    return evaluate.accuracy_rollup(_long(spark, d))


_OUT = """out AS (SELECT *, CASE WHEN no_clothing AND n_items > 0 THEN 'negative_hit' WHEN no_clothing THEN 'negative_rejected' WHEN n_items = 0 THEN 'miss' ELSE 'scored' END AS outcome,
  CASE WHEN confidence >= 0.70 THEN 'accepted' WHEN confidence >= 0.45 THEN 'accepted_with_uncertainty' ELSE 'uncertain' END AS status FROM eval_rows)"""
_JOINED = _OUT.replace("CASE WHEN no_clothing AND", "CASE WHEN id % 41 = 0 THEN 'crashed' WHEN no_clothing AND").replace("FROM eval_rows)", "FROM eval_rows WHERE id % 37 <> 0 AND id % 53 <> 0)")
_LONG = _OUT + ",\nlng AS (" + " UNION ALL ".join(f"SELECT id, split, confidence, '{a}' AS attribute, truth_{a} AS truth, pred_{a} AS pred FROM out WHERE outcome = 'scored'" for a in A) + "),\nw AS (SELECT *, truth IS NOT NULL AS labelled, coalesce(truth = pred, false) AS correct FROM lng)"
_DET = """count(*) AS images, count(*) FILTER (outcome = 'scored') AS tp, count(*) FILTER (outcome = 'miss') AS fn,
  CAST(sum(CASE outcome WHEN 'negative_hit' THEN n_items WHEN 'scored' THEN n_items - 1 ELSE 0 END) AS BIGINT) AS fp"""
_DET2 = "images, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) ELSE 0 END AS f1, CASE WHEN tp + fp > 0 THEN round(fp / (tp + fp), 4) ELSE 0 END AS false_positive_rate"
_WRONG = {a: f"(truth_{a} IS NOT NULL AND NOT coalesce(truth_{a} = pred_{a}, false))" for a in A}
_RIGHT = {a: f"coalesce(truth_{a} = pred_{a}, false)" for a in A}
_BUCKETS = _OUT + f""",
flags AS (SELECT *, {' OR '.join(_WRONG.values())} AS any_wrong, {' OR '.join(_RIGHT.values())} AS any_right FROM out),
bk AS (SELECT id, 'detector_missed_garment' AS bucket FROM flags WHERE outcome = 'miss'
  UNION ALL SELECT id, 'detector_found_something_in_a_non_garment' FROM flags, range(2) r(k) WHERE outcome = 'negative_hit' AND k < n_items
  UNION ALL SELECT id, CASE {' '.join(f"WHEN {w} THEN 'wrong_{'colour' if a == 'color' else a}'" for a, w in _WRONG.items())} ELSE 'abstained_on_a_garment' END FROM flags WHERE outcome = 'scored' AND (any_wrong OR NOT any_right)
  UNION ALL SELECT id, 'over_confident' FROM flags WHERE outcome = 'scored' AND any_wrong AND status <> 'uncertain' AND confidence > 0.7
  UNION ALL SELECT id, 'under_confident' FROM flags WHERE outcome = 'scored' AND NOT (any_wrong AND status <> 'uncertain' AND confidence > 0.7) AND any_right AND status = 'uncertain')"""
_CAL = _LONG + ",\ncal AS (SELECT CAST(least(floor(confidence * 5), 4) AS INT) AS bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS a FROM w WHERE labelled GROUP BY 1)"

QUERIES = {
    duplicate_annotations: "SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    unknown_splits: "SELECT id, 'holdout' AS split FROM eval_rows WHERE id % 100 = 0",
    validation_negatives: "SELECT id, n_items FROM eval_rows WHERE split = 'val' AND no_clothing",
    missing_files: "SELECT id FROM eval_rows WHERE id % 37 = 0",
    label_coverage: "SELECT split, count(*) AS images, count(*) FILTER (no_clothing) AS negatives, " + ", ".join(f"count(truth_{a}) AS labelled_{a}" for a in A) + " FROM eval_rows GROUP BY ROLLUP (split)",
    incomplete_accounts: """WITH u AS (SELECT DISTINCT user_id FROM items) SELECT user_id, 'profile' AS missing FROM u WHERE user_id % 7 = 0 UNION ALL SELECT user_id, 'style_profile' FROM u WHERE user_id % 5 = 0
      UNION ALL SELECT user_id, 'wardrobe' FROM u WHERE user_id NOT IN (SELECT user_id FROM wear_events WHERE user_id % 11 <> 0)""",
    outcome_counts: f"WITH {_OUT} SELECT split, outcome, status, count(*) AS n FROM out GROUP BY 1, 2, 3",
    attribute_accuracy: f"""WITH {_LONG} SELECT attribute, count(*) FILTER (labelled AND correct) AS correct, count(*) FILTER (labelled) AS total, count(*) FILTER (NOT labelled) AS unlabelled, count(*) FILTER (labelled AND pred IS NULL) AS withheld,
      CASE WHEN count(*) FILTER (labelled) > 0 THEN round(count(*) FILTER (labelled AND correct) / count(*) FILTER (labelled), 4) ELSE 0 END AS accuracy FROM w GROUP BY attribute""",
    most_confused: f"""WITH {_LONG}, p AS (SELECT attribute, truth, coalesce(pred, '<none>') AS pred, count(*) AS n FROM w WHERE labelled AND NOT correct GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, truth, pred) AS rank FROM p) SELECT * FROM r WHERE rank <= 10""",
    detection_metrics: f"WITH {_OUT}, c AS (SELECT {_DET} FROM out) SELECT {_DET2} FROM c",
    detection_metrics_by_split: f"WITH {_OUT}, c AS (SELECT split, {_DET} FROM out GROUP BY split) SELECT split, {_DET2} FROM c",
    honesty_rates: f"""WITH {_OUT} SELECT count(*) FILTER (outcome = 'scored') AS evaluated, count(*) FILTER (no_clothing) AS negatives,
      CASE WHEN count(*) FILTER (no_clothing) > 0 THEN round(count(*) FILTER (outcome = 'negative_rejected') / count(*) FILTER (no_clothing), 4) ELSE 1 END AS rejection_rate,
      round(count(*) FILTER (outcome = 'scored' AND status <> 'uncertain') / count(*) FILTER (outcome = 'scored'), 4) AS auto_accept_rate,
      round(count(*) FILTER (outcome = 'scored' AND status = 'uncertain') / count(*) FILTER (outcome = 'scored'), 4) AS review_rate,
      count(*) FILTER (outcome = 'scored' AND {' AND '.join(f'truth_{a} IS NULL' for a in A)}) AS without_labels,
      count(*) FILTER (outcome = 'scored' AND attempts > 1) AS retries, CAST(sum(attempts) FILTER (outcome = 'scored') AS BIGINT) AS passes FROM out""",
    latency_stats: f"""WITH {_OUT}, s AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS k, count(*) OVER () AS n, avg(latency_ms) OVER () AS m FROM out WHERE outcome = 'scored')
      SELECT round(m, 4) AS mean_ms, latency_ms AS p95_ms FROM s WHERE k = round_even(0.95 * (n - 1), 0)""",
    calibration_bins: f"WITH {_CAL} SELECT bin, n, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM cal",
    calibration_error: f"WITH {_CAL} SELECT round(sum(abs(c - a) * n) / sum(n), 4) AS calibration_error FROM cal",
    color_confusion: f"WITH {_LONG} SELECT truth, coalesce(pred, '<withheld>') AS pred, count(*) AS n FROM w WHERE attribute = 'color' AND labelled GROUP BY 1, 2",
    joined_outcomes: f"WITH {_JOINED} SELECT split, outcome, count(*) AS n, CAST(sum(n_items) AS BIGINT) AS items FROM out GROUP BY 1, 2",
    joined_metrics: f"WITH {_JOINED}, c AS (SELECT split, {_DET.replace("outcome = 'miss'", "outcome IN ('miss', 'crashed')")} FROM out GROUP BY split) SELECT split, {_DET2} FROM c",
    skipped_annotations: "SELECT id, CASE WHEN id % 37 = 0 THEN 'image not found' ELSE 'no result' END AS skipped FROM eval_rows WHERE id % 37 = 0 OR id % 53 = 0",
    detection_metrics_by_label: f"WITH {_OUT}, c AS (SELECT coarse_label, {_DET} FROM out JOIN garments g ON g.garment_id = out.id GROUP BY coarse_label) SELECT coarse_label, {_DET2} FROM c",
    accuracy_by_version: f"""WITH {_LONG} SELECT 'v' || (id % 3) AS version, attribute, count(*) FILTER (labelled AND correct) AS correct, count(*) FILTER (labelled) AS total, count(*) FILTER (NOT labelled) AS unlabelled, count(*) FILTER (labelled AND pred IS NULL) AS withheld,
      CASE WHEN count(*) FILTER (labelled) > 0 THEN round(count(*) FILTER (labelled AND correct) / count(*) FILTER (labelled), 4) ELSE 0 END AS accuracy FROM w GROUP BY 1, attribute""",
    error_buckets: f"WITH {_BUCKETS} SELECT bucket, count(*) AS n FROM bk GROUP BY 1",
    error_examples: f"WITH {_BUCKETS}, r AS (SELECT bucket, id, row_number() OVER (PARTITION BY bucket ORDER BY id) AS rank FROM bk) SELECT id, bucket, rank FROM r WHERE rank <= 25",
    accuracy_rollup: f"WITH {_LONG} SELECT split, attribute, count(*) AS total, count(*) FILTER (correct) AS correct FROM w WHERE labelled GROUP BY ROLLUP (split, attribute)",
}
