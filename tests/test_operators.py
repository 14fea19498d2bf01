"""Operators on a few literal rows."""

import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import geometry
from weft.operators import assistant, bestoutfits, checks, detect, embed, evaluate, garments, images, itemtable, outfits, pages, planner, ranks, shopping, stages, wardrobe, zeroshot
from weft.plans import fixtures
from weft.sources import io
from weft.streaming import counters, streams


def eval_row(id_, n_items=1, no_clothing=False, truth=None, pred=None, confidence=0.8, attempts=1):
    truth, pred = truth or {}, pred or {}
    return (id_, "val", no_clothing, n_items, *[truth.get(a) for a in evaluate.ATTRIBUTES], *[pred.get(a) for a in evaluate.ATTRIBUTES], confidence, 40.0, attempts)


SCHEMA = "id string, split string, no_clothing boolean, n_items int, " + ", ".join(f"{k}_{a} string" for k in ("truth", "pred") for a in evaluate.ATTRIBUTES) + ", confidence double, latency_ms double, attempts int"


def outcomes(spark, rows):
    return evaluate.outcomes(spark.createDataFrame(rows, SCHEMA))


def test_detection_accounting(spark):
    out = outcomes(spark, [eval_row("a", 2, truth={"category": "dress"}, pred={"category": "dress"}), eval_row("b", 0), eval_row("c", 1, True), eval_row("d", 0, True)])
    r = evaluate.detection_counts(out).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 1)
    h = evaluate.honesty_rates(out).first()
    assert (h["evaluated"], h["negatives"], h["rejection_rate"]) == (1, 2, 0.5)


def test_error_buckets(spark):
    rows = [
        eval_row("wrong", truth={"category": "dress"}, pred={"category": "t-shirt"}, confidence=0.92),
        eval_row("under", truth={"category": "dress"}, pred={"category": "dress"}, confidence=0.2),
        eval_row("none", truth={"category": "dress"}, confidence=0.5),
        eval_row("missed", 0), eval_row("ghost", 2, True),
    ]
    got = {r["id"]: r["buckets"] for r in evaluate.error_buckets(outcomes(spark, rows)).collect()}
    assert got["wrong"] == ["wrong_category", "over_confident"]
    assert got["under"] == ["under_confident"]
    assert got["none"] == ["wrong_category"]
    assert got["missed"] == ["detector_missed_garment"]
    assert got["ghost"] == ["detector_found_something_in_a_non_garment"] * 2
    assert evaluate.advice(evaluate.bucket_counts(evaluate.error_buckets(outcomes(spark, rows)))) == ["detector_found_something_in_a_non_garment", "detector_missed_garment", "wrong_category", "over_confident", "under_confident"]


def test_confusion_and_latency(spark):
    rows = [eval_row(str(i), truth={"category": t}, pred={"category": p}) for i, (t, p) in enumerate([("t-shirt", "t-shirt"), ("dress", "t-shirt"), ("dress", "dress")])]
    long = evaluate.attribute_rows(outcomes(spark, rows))
    assert {(r["truth"], r["pred"]): r["n"] for r in evaluate.confusion(long, "category").collect()} == {("t-shirt", "t-shirt"): 1, ("dress", "t-shirt"): 1, ("dress", "dress"): 1}
    assert evaluate.latency(outcomes(spark, rows)).first()["p95_ms"] == 40.0


def test_suppression_is_greedy(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 5), int(i), *map(float, (x, y, x + w, y + h)), float(s)) for i, (x, y, w, h, s) in enumerate(zip(*rng.uniform(1, 60, (4, 60)), rng.uniform(0, 1, 60)))]
    df = spark.createDataFrame(rows, "image_id int, det_no int, x1 double, y1 double, x2 double, y2 double, score double")
    want = set()
    for image in range(5):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: -r[6]):
            def iou(a, b):
                i = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
                return i / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - i)
            if all(iou(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want |= {(image, r[1]) for r in kept}
    assert {(r["image_id"], r["det_no"]) for r in detect.suppress(df, 0.3).collect()} == want


def test_checks(spark):
    df = spark.createDataFrame([("same", "val", "a.png"), ("same", "test", "b.png"), ("c", "holdout", "c.png")], "id string, split string, file string")
    assert checks.duplicate_ids(df).first()["id"] == "same"
    assert checks.unknown_splits(df).count() == 1
    assert checks.missing_files(df, df.where("id = 'c'").select("file")).count() == 2
    with pytest.raises(ValueError):
        checks.by_split(df, "holdout")


def test_retry_resolution(spark):
    rows = [(1, 1, 0.4, True), (1, 2, 0.6, True), (1, 3, 0.5, True), (2, 1, 0.4, False), (2, 2, 0.9, False), (3, 1, 0.4, True), (3, 3, 0.9, True)]
    got = {r["garment_id"]: (r["attempt"], r["attempts"]) for r in garments.resolve_retries(spark.createDataFrame(rows, "garment_id int, attempt int, confidence double, wants_retry boolean")).collect()}
    assert got == {1: (2, 3), 2: (1, 1), 3: (1, 2)}


def test_match_score(spark):
    rows = [(1, "color_harmony", 1.0), (1, "trend_compatibility", 0.0), (2, "color_harmony", None), (2, "user_feedback", 0.5)]
    got = {r["outfit_id"]: r["score"] for r in outfits.match_score(spark.createDataFrame(rows, "outfit_id int, factor string, value double")).collect()}
    assert got == {1: 84, 2: 50}
    assert sum(outfits.FACTORS.values()) == pytest.approx(1.0)


def test_weather_as_of_carries_over_spans(spark):
    s = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", 5.0), (1, 2, "2024-01-01 12:00:00", 7.0), (2, 3, "2024-06-01 00:00:00", 9.0)], "user_id int, snapshot_id long, captured_at string, temperature_c double").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    e = spark.createDataFrame([(1, 10, "2024-01-01 12:00:00"), (1, 11, "2024-09-01 00:00:00"), (2, 12, "2024-01-01 00:00:00")], "user_id int, event_id long, starts_at string").withColumn("starts_at", F.col("starts_at").cast("timestamp"))
    assert {r["event_id"]: r["temperature_c"] for r in planner.weather_as_of(e, s).collect()} == {10: 7.0, 11: 7.0, 12: None}


def test_reminder_runs_are_those_of_each_time(spark):
    e = spark.createDataFrame(
        [(1, "2024-01-01 12:00:00", True, False, 30), (2, "2024-01-01 12:00:01", True, False, 30), (3, "2024-01-01 12:20:00", True, False, 4), (4, "2024-01-01 12:20:00", True, False, 0),
         (5, "2024-01-01 12:20:00", True, True, 60), (6, "2024-01-01 12:20:00", False, False, 60), (7, None, True, False, 60), (8, "2024-01-01 12:20:00", True, False, None)],
        "event_id long, starts_at string, remind_enabled boolean, reminder_sent boolean, reminder_minutes_before int").withColumn("starts_at", F.col("starts_at").cast("timestamp"))
    got = {(r["event_id"], f"{r['run_at']:%H:%M}") for r in planner.reminder_runs(e).collect()}
    times = [f"{h:02}:{m:02}" for h in (11, 12) for m in (0, 15, 30, 45)]
    assert got == {(r["event_id"], t) for t in times for r in planner.due_reminders(e, f"2024-01-01 {t}:00").collect()}
    assert got == {(1, "11:30"), (1, "11:45"), (2, "11:45"), (2, "12:00")}


def test_search_and_pages(spark):
    df = spark.createDataFrame([(1, "White tee", "white", "casual", "top"), (2, "Boots", "brown", None, "shoes"), (3, "Sneaker", "white", "sporty", "shoes")], "item_id int, name string, color string, style string, category string")
    assert [r["item_id"] for r in wardrobe.search_items(df, " WHITE ").orderBy("item_id").collect()] == [1, 3]
    assert [r["item_id"] for r in wardrobe.search_items(df, "brown", "shoes").collect()] == [2]
    rows, info = pages.page_of(df, ["item_id"], 2, 2)
    assert (rows.count(), info["total_pages"], info["has_next"]) == (1, 2, False)


def test_crowded_photos_are_met_in_cells(spark, monkeypatch):
    monkeypatch.setattr(detect, "CROWD", 20)
    monkeypatch.setattr(detect, "GRID", 8)
    rng = random.Random(4)
    rows = []
    for image, n in ((1, 300), (2, 20), (None, 5), (3, 25), (4, 1)):
        for k in range(n):
            x, y, w, h = rng.randrange(0, 2000, 10), rng.randrange(0, 1200, 10), rng.choice([0, 10, 60, 120, 900]), rng.choice([10, 50, 100])
            rows.append((image, k, float(x), float(y), float(x + w), float(y + h)))
    rows += [(3, 100 + k, 50.0, 50.0, 90.0, 90.0) for k in range(4)]  # equal boxes
    df = spark.createDataFrame(rows, "image_id int, det_no int, x1 double, y1 double, x2 double, y2 double").withColumn("side", F.lit(1)).repartition(3)
    want = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] == b[0] and a[0] is not None:
                w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
                if w > 0 and h > 0:
                    areas = [(r[4] - r[2]) * (r[5] - r[3]) for r in (a, b)]
                    want[a[0], min(a[1], b[1]), max(a[1], b[1])] = round(w * h / (sum(areas) - w * h), 9)
    found = detect.pairwise_iou(df).collect()
    assert len(found) == len(want) and {(r["image_id"], r["det_a"], r["det_b"]): round(r["iou"], 9) for r in found} == want
    crowd = df.where("image_id = 1 and x2 > x1 and y2 > y1").withColumns({"left": F.lit(0.0), "above": F.lit(0.0), "side": F.lit(250.0)})
    assert detect.box_cells(crowd).groupBy("cx", "cy").count().agg(F.max("count")).first()[0] < 60  # no task has all boxes


def test_lowest_price_equals_one_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), f"2024-{rng.randrange(1, 13):02}-{rng.randrange(1, 28):02}" if rng.random() < 0.95 else None, float(rng.randrange(20, 99))) for _ in range(400)]
    df = spark.createDataFrame(rows, "product_id int, seen_at string, price double").withColumn("seen_at", F.to_date("seen_at")).withColumn("span", F.lit("mine"))
    got = sorted((r["product_id"] or 0, str(r["seen_at"] or ""), r["price"], r["lowest_so_far"]) for r in shopping.lowest_price(df, 20).collect())
    want, least = [], {}
    for product, at, price in sorted((r[0] or 0, r[1] or "", r[2]) for r in rows):
        least[product] = min(price, least.get(product, price))
        want.append((product, at, price, least[product]))
    assert got == want and "span" in shopping.lowest_price(df).columns


@pytest.mark.parametrize("hot", [0, 60, 10_000])
def test_lowest_prices_with_and_without_products_that_are_cut(spark, monkeypatch, hot):
    monkeypatch.setattr(shopping, "HOT", hot)
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None, None]), f"2024-{rng.randrange(1, 13):02}-{rng.randrange(1, 28):02}" if rng.random() < 0.95 else None, float(rng.randrange(20, 999)) if rng.random() < 0.95 else None) for _ in range(400)]
    df = spark.createDataFrame(rows, "product_id int, seen_at string, price double").withColumn("seen_at", F.to_date("seen_at"))
    low = shopping.lowest_price(df, 20, parts=7)
    plan = low._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(product_id#" in plan and ", 7)" in plan and "SortMergeJoin" not in plan  # many small sorts, no second shuffle of all prices
    got = sorted((r["product_id"] or 0, str(r["seen_at"] or ""), r["price"] or 0, r["lowest_so_far"] or 0) for r in low.collect())
    want, least = [], {}
    for product, at, price in sorted((r[0] or 0, r[1] or "", r[2] or 0) for r in rows):
        least[product] = min((x for x in (price, least.get(product)) if x), default=0)
        want.append((product, at, price, least[product]))
    assert got == want


def item_rows(spark, ids, **more):
    rows = [(i, *(f"{a}{i % 3}" for a in wardrobe.MERGED), ["color"] if i % 5 == 0 else []) for i in ids]
    return spark.createDataFrame(rows, "item_id long, " + ", ".join(f"{a} string" for a in wardrobe.MERGED) + ", corrected array<string>")


def test_a_merge_rewrites_only_what_it_touches(spark, tmp_path):
    path, items = str(tmp_path / "items"), item_rows(spark, range(2000))
    itemtable.write_items(items, path, 64)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "items").rglob("*.parquet")}
    before = files()
    values = [f"concat('new', item_id) AS {a}" for a in wardrobe.MERGED] + [f"0.9D AS {a}_conf" for a in wardrobe.MERGED if a != "color"]
    patches = spark.createDataFrame([(7,), (1005,), (9001,)], "item_id long").selectExpr("item_id", *values)
    touched = itemtable.merge_into(spark, path, patches, buckets=64)
    after = files()
    assert len(touched) <= 3 and len({k for k, v in before.items() if after.get(k) == v}) == len(before) - len(touched)
    got = itemtable.read_items(spark, path).drop("bucket")
    want = wardrobe.merge_patches(items, patches)
    assert got.count() == 2001 and got.select(want.columns).exceptAll(want).count() == 0 and want.exceptAll(got.select(want.columns)).count() == 0
    assert itemtable.merge_into(spark, path, patches.where("false"), buckets=64) == [] and files() == after
    with pytest.raises(ValueError, match="not written with"):
        itemtable.merge_into(spark, path, patches, buckets=63)


def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    words = ["linen", "Shirt", "blue", "Été", "street", "wear", "a", "", "navy-blue", "ninety"]
    rows = [(i, " ".join(rng.choices(words, k=3)), rng.choice([None, "blue", "red"]), rng.choice([None, "Street", "formal"]), rng.choice(["top", "shoes"])) for i in range(400)] + [(900, "a rare kimono", "red", None, "top"), (None, None, None, None, None)]
    items = spark.createDataFrame(rows, "item_id int, name string, color string, style string, category string")
    itemtable.write_search_index(items, str(tmp_path / "grams"), files=8)
    index = spark.read.parquet(str(tmp_path / "grams"))
    for named in (1_000, 5):
        monkeypatch.setattr(itemtable, "NAMED", named)
        for query, category in (("", "All"), (" STREET ", "All"), ("blu", "top"), ("ü", "All"), ("été", "All"), ("n s", "All"), ("kimono", "All"), ("zzz", "All"), ("ee", "shoes"), ("nin", "All")):
            got = {r["item_id"] for r in itemtable.search_indexed(items, index, query, category).collect()}
            assert got == {r["item_id"] for r in wardrobe.search_items(items, query, category).collect()}, query
    read = index.where(F.col("gram").isin("kim", "imo")).select(F.input_file_name()).distinct().count()
    assert read <= 2  # most files hold none of a rare query's trigrams
    plan = index.where(F.col("gram").isin("kim", "imo"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_index_is_written_without_a_table_of_all_pairs(spark, tmp_path, monkeypatch):
    rows = [(1, "abcabc", "blue", "casual"), (1, "bcd", None, "formal"), (1, "bcd", None, "formal"), (2, "xabcdx", "red", None), (3, "ab", "bcd", ""), (None, "abcd", "", "")]
    items = spark.createDataFrame(rows, "item_id int, name string, color string, style string")
    kind = type(items)
    plans, by_range = [], kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or by_range(df, *a))
    itemtable.write_search_index(items, str(tmp_path / "grams"))
    assert len(plans) == 1 and "Generate" in plans[0] and "Aggregate" not in plans[0]
    index = spark.read.parquet(str(tmp_path / "grams"))
    assert {tuple(r) for r in index.where("item_id > 1").collect()} == {*((g, 2) for g in ("xab", "abc", "bcd", "cdx", "red")), ("bcd", 3)}
    assert [r["item_id"] for r in itemtable.search_indexed(items, index, "abcd").collect()] == [2]  # item 1 has both trigrams, in two rows of it
    for query in ("bcd", "abc", "formal", "cabc"):
        got = sorted(tuple(r)[:2] for r in itemtable.search_indexed(items.where("item_id is not null"), index, query).collect())
        assert got == sorted(tuple(r)[:2] for r in wardrobe.search_items(items.where("item_id is not null"), query).collect()), query


def test_months_of_style_come_from_one_pass(spark, tmp_path):
    rows = [(1, "2024-03-31", 4.0), (1, "2024-03-01", 6.0), (1, "2024-01-15", 3.0), (1, "2023-09-30", 9.0), (1, None, 9.0), (2, "2023-12-31", None), (3, None, 1.0), (None, "2024-02-01", 5.0)]
    spark.createDataFrame(rows, "user_id int, at string, score double").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "scored"))
    out = wardrobe.style_evolution(spark.read.parquet(str(tmp_path / "scored")), 4)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r["user_id"], str(r["month"])[:7]): r["score"] for r in out.collect()}
    none = {(u, m): None for u, ms in ((1, ("2023-12", "2024-02")), (2, ("2023-09", "2023-10", "2023-11", "2023-12")), (None, ("2023-11", "2023-12", "2024-01", "2024-02"))) for m in ms}
    assert got == {(1, "2024-01"): 3.0, (1, "2024-03"): 5.0} | none


@pytest.mark.parametrize("bound", [500_000, 3])
def test_purchases_are_those_of_the_view(spark, monkeypatch, bound):
    monkeypatch.setattr(fixtures, "SUPPLIERS", bound)
    d = "/root/testdata/sf0.001"
    want = fixtures.view(spark, d, "purchases")
    for last in ("items", "orders"):
        got = fixtures.purchases(spark, d, last=last)
        assert got.columns == want.columns and got.dtypes == want.dtypes and got.count() == want.count() and not got.exceptAll(want).count()


def test_retries_keep_the_original_box(spark):
    rows = [(1, 1, 0.3, True, 10.0), (1, 2, 0.5, True, 99.0), (1, 3, 0.4, True, 98.0), (2, 1, 0.9, False, 20.0), (2, 2, 0.95, False, 97.0)]
    df = spark.createDataFrame(rows, "garment_id int, attempt int, confidence double, wants_retry boolean, x1 double")
    got = {r["garment_id"]: tuple(r)[1:] for r in garments.resolve_retries(df).collect()}
    assert got == {1: (2, 0.5, 3, 10.0), 2: (1, 0.9, 1, 20.0)}
    assert garments.resolve_retries(df.drop("x1")).columns == ["garment_id", "attempt", "confidence", "attempts"]
    assert garments.resolve_retries(df.withColumn("view", F.lit("v")), carry=["view"]).columns[-1] == "view"


def test_labels_allowed_by_garment(spark):
    labels = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (2, "c", [1.0, 1.0])], "idx int, label string, embedding array<double>")
    items = spark.createDataFrame([(1, [1.0, 0.0], ["b", "c"]), (2, [1.0, 0.0], ["zzz"]), (3, [1.0, 0.0], None), (4, [1.0, 0.0], []), (5, [0.0, 1.0], ["a"])], "item_id int, embedding array<double>, own array<string>")
    got = {}
    for r in zeroshot.softmax_scores(items, labels, allowed_col="own").collect():
        got.setdefault(r["item_id"], {})[r["label"]] = r["score"]
    assert got[1].keys() == {"b", "c"} and got[1]["c"] > 0.99 and sum(got[1].values()) == pytest.approx(1)
    assert got[2].keys() == got[3].keys() == got[4].keys() == {"a", "b", "c"} and got[5] == {"a": 1.0}
    full = {r["label"]: r["score"] for r in zeroshot.softmax_scores(items.where("item_id = 3"), labels).collect()}
    assert got[3] == pytest.approx(full)


VOCABULARY = """
version: 1
attributes:
  category:
    gated_by_detector: true
    confidence_cap: 0.9
    labels:
      - { value: kilt, group: bottom, prompt: "a kilt" }
      - { value: clog, group: shoes, prompt: "a clog" }
  material: { labels: [{ value: hemp, prompt: hemp }] }
  pattern: { labels: [{ value: dotted, prompt: dots }] }
  style: { labels: [{ value: loud, prompt: loud }] }
  subcategory: { enabled: false, labels: [{ value: x, prompt: x }] }
detector_group_map: { " Skirt": bottom, shoe: shoes }
"""
RULE_FILE = """
rules:
  - code: no_hemp_clogs
    severity: advisory
    penalty: 0.1
    when: { material_in: [hemp] }
    require: { category_not_in: [clog] }
    message: "{material} clogs"
  - code: plain
    when: { pattern_in: [dotted] }
material_groups: { plant: [hemp, flax] }
"""


def test_yaml_files_are_read(spark, tmp_path):
    (tmp_path / "labels.yaml").write_text("\ufeff" + VOCABULARY)
    (tmp_path / "rules.yaml").write_text(RULE_FILE)
    words = {(r["attribute"], r["label"]): r for r in io.read_vocabulary(spark, str(tmp_path / "labels.yaml")).collect()}
    assert set(words) == {("category", "kilt"), ("category", "clog"), ("material", "hemp"), ("pattern", "dotted"), ("style", "loud")}
    assert (words["category", "kilt"]["grp"], words["category", "kilt"]["cap"], words["style", "loud"]["grp"], words["style", "loud"]["cap"]) == ("bottom", 0.9, "other", 1.0)
    assert io.read_detector_groups(spark, str(tmp_path / "labels.yaml")) == {"skirt": "bottom", "shoe": "shoes"}
    rules = io.read_rules(spark, str(tmp_path / "rules.yaml"))
    assert [(r.code, r.severity, r.penalty, r.require) for r in rules] == [("no_hemp_clogs", "advisory", 0.1, {"category_not_in": ["clog"]}), ("plain", "error", 0.1, {})]
    assert io.read_material_groups(spark, str(tmp_path / "rules.yaml")) == {"plant": ["hemp", "flax"]}
    (tmp_path / "short.yaml").write_text("attributes:\n  category: { labels: [] }\n")
    with pytest.raises(ValueError):
        io.read_vocabulary(spark, str(tmp_path / "short.yaml"))


def test_pages_are_slices_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(pages, "SORTED_ROWS", 40)
    monkeypatch.setattr(pages, "CUTS", 5)
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "c", "d"]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int").withColumn("range", F.lit(1)).repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for page in (1, 7, 20, 45, 46):
        got, info = pages.page_of(df, ["k", "i"], page, 20)
        assert [(r["k"], r["i"]) for r in got.collect()] == ordered[20 * (page - 1) : 20 * page] and info["total_pages"] == 45
    for at in (None, 0, 300, 880, 899):
        last = None if at is None else ordered[at]
        begin = 0 if at is None else at + 1
        assert [(r["k"], r["i"]) for r in pages.page_after(df, ["k", "i"], last, 30).collect()] == ordered[begin : begin + 30]
    found, before = pages.range_of_page(df, ["k", "i"], 500, 520, 900)
    assert found.count() < 250 and before <= 500  # what lies before the page is not put in order
    assert pages.page_of(df.where("false"), ["k", "i"])[0].count() == 0


def test_a_page_far_into_a_table_reads_one_range(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "id * 3 AS v").repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = pages.page_after(df, ["id"], (150_000,), 10)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThanOrEqual(id,150000)]" in plan and "TakeOrderedAndProject" in plan
    assert [r["id"] for r in pages.page_of(df, ["id"], 100_000 // 50 + 1, 50)[0].collect()] == list(range(100_000, 100_050))


def test_capsule_is_the_best_choice(spark):
    rng = random.Random(5)
    trips = [[rng.randrange(6) for _ in range(4)] for _ in range(40)] + [[9, 9, 9, 0], [0, 9, 9, 3], [0, 0, 9, 9], [0, 0, 0, 2], [1, 9, 2, 0]]
    rows, n = [], 0
    for trip, sizes in enumerate(trips):
        for slot, size in zip(("top", "bottom", "shoes", "hat"), sizes):
            for _ in range(size):
                rows.append((trip if trip else None, n, slot, -n % 7))
                n += 1
    df = spark.createDataFrame(rows, "trip int, item_id int, slot string, price int")
    for limit in (3, 7, 8, 9, 100):
        got = {r["trip"]: r for r in planner.capsule(df, limit, ["price"]).collect()}
        for trip, (t, b, s, h) in enumerate(trips):
            fits = [(x, y, z) for x in range(t + 1) for y in range(b + 1) for z in range(s + 1) if x + y + z <= limit]
            worth = lambda c, own=(t, b, s): (math.prod(x for x, n in zip(c, own) if n), c)
            best = max(fits, key=worth)
            r = got.get(trip or None)
            if sum((t, b, s, h)):
                assert (r["tops"], r["bottoms"], r["shoes"]) == best and r["outfits"] == math.prod(best), (trip, limit)
                assert r["items"] == min(limit, sum(best) + h)
    packed = planner.pack_capsule(df, 8, ["price"]).where("slot = 'top'").collect()
    for trip, (t, *_) in enumerate(trips):
        own = sorted((r[3], r[1]) for r in rows if r[0] == (trip or None) and r[2] == "top")
        taken = sorted(r["item_id"] for r in packed if r["trip"] == (trip or None))
        assert taken == sorted(i for _, i in own[: len(taken)])
    assert planner.capsule(df).where("trip = 40").first()["outfits"] == 729


def test_best_outfits_equal_the_full_product(spark):
    rng = random.Random(8)
    families, styles = ["blue", "yellow", "black", "red", "purple", None], ["casual", "formal", None]
    rows = []
    for user in range(4):
        for i in range(75 if user == 0 else rng.randrange(25)):
            rows.append((user, 1000 * user + i, rng.choice(["top", "bottom", "shoes", "hat"]), rng.choice(["active"] * 9 + ["archived"]), rng.choice(families), rng.choice(styles), rng.choice([0, 50, 50, 80, 100, None])))
    df = spark.createDataFrame(rows, "user_id int, item_id int, slot string, status string, color_family string, style string, value int")
    harmony = lambda a, b: 10 if a == b else 8 if "black" in (a, b) else 0 if {a, b} in ({"blue", "yellow"}, {"purple", "yellow"}) else 5
    for k in (1, 12):
        got = {}
        for r in bestoutfits.best_outfits(df, k).orderBy("user_id", "rank").collect():
            got.setdefault(r["user_id"], []).append((r["points"], r["top"], r["bottom"], r["shoes"], r["score"]))
        want = {}
        for user in range(4):
            t, b, s = ([(r[1], r[4] or "", r[5] or "", r[6] or 0) for r in rows if r[0] == user and r[2] == slot and r[3] == "active"] for slot in ("top", "bottom", "shoes"))
            made = []
            for x in t:
                for y in b:
                    for z in s:
                        alike = 4 - len({x[2], y[2], z[2]})
                        points = 160 * (harmony(x[1], y[1]) + harmony(x[1], z[1]) + harmony(y[1], z[1])) + 1300 * alike + 25 * (x[3] + y[3] + z[3])
                        made.append((-points, x[0], y[0], z[0]))
            if made:
                want[user] = [(-p, x, y, z, math.floor(-p * 100 / 16200 + 0.5)) for p, x, y, z in sorted(made)[:k]]
        assert got == want


def test_pairs_bound_their_outfits_and_ties_keep_their_order(spark):
    families, styles = ["blue", "yellow", "black", "red", ""], ["casual", "formal", "sporty"]
    one = spark.createDataFrame([(f, s) for f in families for s in styles], "f string, s string")
    a, b, c = (one.toDF(f"f{x}", f"s{x}") for x in "abc")
    all_ = a.crossJoin(b).crossJoin(c).select(bestoutfits.pair_points(F.col("fa"), F.col("fb"), F.col("sa"), F.col("sb")).alias("pair"), bestoutfits.kind_points([F.col(f"f{x}") for x in "abc"], [F.col(f"s{x}") for x in "abc"]).alias("whole"))
    assert all_.where("pair < whole").count() == 0 and all_.where("pair = whole").count() > 0
    rows = [(1, 3 * i + j, slot, "active", ("red", "blue")[i % 2], "casual", 100 if i < 20 else 99) for j, slot in enumerate(("top", "bottom", "shoes")) for i in range(24)]
    df = spark.createDataFrame(rows, "user_id int, item_id int, slot string, status string, color_family string, style string, value int")
    got = [(r["points"], r["top"], r["bottom"], r["shoes"]) for r in bestoutfits.best_outfits(df).orderBy("rank").collect()]
    points = 160 * 30 + 1300 * 3 + 25 * 300
    tied = sorted((3 * x, 3 * y + 1, 3 * z + 2) for p in (0, 1) for x in range(p, 20, 2) for y in range(p, 20, 2) for z in range(p, 20, 2))
    assert got == [(points, *t) for t in tied[:12]]


def test_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(80, 8))
    v[40:] = v[:40] + rng.normal(scale=0.05, size=(40, 8))
    rows = [(int(i % 3), int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "user_id int, item_id int, embedding array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if i % 3 == j % 3 and u[i] @ u[j] >= 0.9}
    old, embed.BLOCK = embed.BLOCK, 7
    try:
        assert {(r["a"], r["b"]) for r in embed.duplicate_items(df, 0.9).collect()} == want
    finally:
        embed.BLOCK = old


def test_percentiles_of_null_groups(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    got = {r["k"]: (r["m"], r["calls"]) for r in ranks.nearest_rank(rows, "v", 0.95, ["k"], "m", calls=F.count(F.lit(1))).collect()}
    assert got == {"a": (2, 2), None: (4, 2)}


def test_similar_items_settle_ties_by_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(30 + i, [0.0, 1.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(3)
    got = embed.similar_items(df.where("item_id in (7, 31)"), df, 4).orderBy("query_id", "rank").collect()
    assert [r["item_id"] for r in got] == [0, 1, 2, 3, 30, 32, 33, 34]


def photo(rgb, size=64):
    return np.tile(np.array(rgb, np.uint8), (size, size, 1))


def test_photo_kernels(spark):
    three = np.concatenate([photo((30, 60, 200), 96)[:32], photo((200, 40, 40), 96)[:32], photo((40, 160, 60), 96)[:32]])
    got = images.dominant_colors(three.reshape(-1, 3))
    assert got["is_multicolor"] and abs(max(got["distribution"].values()) - 1 / 3) < 0.05
    assert images.dominant_colors(np.empty((0, 3), np.uint8))["primary"] == "unknown"
    spot = photo((250, 250, 250), 100)
    spot[20:80, 30:70] = (20, 20, 120)
    box = images.propose_box(spot)
    assert (abs(box["x1"] - 30) <= 2, abs(box["y2"] - 80) <= 2) == (True, True)
    assert images.propose_box(photo((9, 9, 9))) is None
    rows = [(1, 64, 64, bytearray(photo((128, 128, 128)).tobytes()), None), (2, 64, 64, None, None), (3, 100, 100, bytearray(spot.tobytes()), bytearray(bytes(5000) + b"\xff" * 5000))]
    df = spark.createDataFrame(rows, "image_id int, width int, height int, data binary, mask binary")
    m = {r["image_id"]: r for r in images.measure_photos(df).collect()}
    assert m[1]["brightness_mean"] == 128.0 and m[1]["entropy"] == 0.0 and m[2]["entropy"] is None
    odd = spark.createDataFrame([(4, 64, 64, bytearray(photo((9, 9, 9)).tobytes()), bytearray(b"\xff" * 7))], df.schema)
    assert images.garment_colors(odd).first()["primary"] == "unknown"
    c = {r["image_id"]: r for r in images.garment_colors(df).collect()}
    assert c[1]["primary"] == "gray" and c[2]["primary"] == "unknown" and 0 < c[3]["pixel_count"] <= 5000


def test_stage_failures_stay_in_their_row(spark):
    def factory():
        def stage(row):
            if row["image_id"] == 2:
                raise RuntimeError("broken")
            return [{"score": float(k)} for k in range(row["image_id"])]
        return stage

    got = stages.apply_stage(spark.createDataFrame([(1,), (2,), (3,)], "image_id int"), factory, "score double").collect()
    assert len(got) == 5 and [r["error"] for r in got if r["image_id"] == 2] == ["RuntimeError: broken"]


def test_annotations_round_trip(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_bytes("﻿".encode() + b'{"version": 1, "images": [{"id": "x", "file": "x.png", "expected": {"category": "dress", "color": null, "no_clothing": false}}]}')
    df = io.read_annotations(spark, str(path))
    assert df.first()["split"] == "val"
    io.write_annotations(df, str(tmp_path / "out"))
    assert io.read_annotation_lines(spark, str(tmp_path / "out")).first()["expected"]["color"] is None
    with pytest.raises(ValueError):
        io.vocabulary(spark, {"category": [{"label": "dress"}]})


def test_results_flatten(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"success": true, "request_id": "a", "items": [{"id": "g1", "attributes": {"category": {"value": "dress", "confidence": 0.9, "scores": {"dress": 0.9, "skirt": 0.1}}}}]}\n{"success": false, "request_id": "b", "items": []}\n')
    flat = io.flatten_results(io.read_results(spark, str(path)))
    assert flat.count() == 2
    assert {(r["label"], r["score"]) for r in io.predictions_long(flat).collect()} == {("dress", 0.9), ("skirt", 0.1)}


def timed(spark, rows, schema, column):
    return spark.createDataFrame(rows, schema).withColumn(column, F.col(column).cast("timestamp"))


def arrive(spark, folder, rows):
    timed(spark, rows, "item_id int, worn_at string", "worn_at").coalesce(1).write.mode("append").parquet(str(folder))


def run_counters(spark, folder):
    live = spark.readStream.schema("item_id int, worn_at timestamp").parquet(str(folder / "in"))
    counters.keep_counters(streams.wear_counter_stream(live), str(folder / "table"), str(folder / "cp")).awaitTermination()
    return {r["item_id"]: (r["times_worn"], f"{r['last_worn_at']:%d %H}") for r in counters.current_counters(spark, str(folder / "table")).collect()}


def test_counters_are_merged_into_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counters, "COMPACT", 3)
    src, table = tmp_path / "in", str(tmp_path / "table")
    arrive(spark, src, [(1, "2024-01-01 10:00:00"), (1, "2024-01-02 10:00:00"), (2, "2024-01-01 11:00:00")])
    assert run_counters(spark, tmp_path) == {1: (2, "02 10"), 2: (1, "01 11")}
    arrive(spark, src, [(1, "2024-01-01 12:00:00"), (3, "2024-01-02 08:00:00")])  # late, within the watermark
    assert run_counters(spark, tmp_path) == {1: (3, "02 10"), 2: (1, "01 11"), 3: (1, "02 08")}
    before = counters.versions(spark, table)
    counters.merge_batch(timed(spark, [(1, "2024-01-01 00:00:00", 99, "2024-01-09 00:00:00")], "item_id int, day string, times_worn long, last_worn_at string", "day"), 0, table)  # a replayed batch
    assert counters.versions(spark, table) == before
    want, sizes = {1: 3, 2: 1, 3: 1}, []
    for day in range(3, 28):
        arrive(spark, src, [(1, f"2024-01-{day:02} 09:00:00"), (4, f"2024-01-{day:02} 10:00:00")])
        want[1], want[4] = want[1] + 1, want.get(4, 0) + 1
        got = run_counters(spark, tmp_path) if day % 6 == 0 or day == 27 else None
        if got:
            assert {k: v[0] for k, v in got.items()} == want
            sizes.append(sum(1 for f in (tmp_path / "table").rglob("*.parquet")))
    assert max(sizes) <= 2 * (3 + 4) and len(counters.versions(spark, table)) == 2  # files stay bounded
    arrive(spark, src, [(2, "2024-01-01 11:30:00")])  # past the watermark: dropped
    assert run_counters(spark, tmp_path)[2] == (1, "01 11")
    items = spark.createDataFrame([(1, 7), (9, 7)], "item_id int, times_worn int")
    assert {r["item_id"]: r["times_worn"] for r in counters.counted_items(items, counters.current_counters(spark, table)).collect()} == {1: want[1], 9: 0}


def test_counters_close_days_and_keep_the_version_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counters, "COMPACT", 2)
    path = str(tmp_path / "t")
    batch = lambda *rows: timed(spark, rows, "item_id int, day string, times_worn long, last_worn_at string", "day").withColumn("last_worn_at", F.col("last_worn_at").cast("timestamp"))
    counters.merge_batch(batch((1, "2024-01-01", 2, "2024-01-01 10:00:00"), (1, "2024-01-05", 1, "2024-01-05 10:00:00")), 0, path)
    counters.merge_batch(batch((1, "2024-01-05", 4, "2024-01-05 12:00:00"), (2, "2024-01-06", 1, "2024-01-06 01:00:00")), 1, path)
    state = counters.manifest(spark, path, 1)
    rows = {(r["item_id"], r["day"] is None): r["times_worn"] for r in spark.read.parquet(f"{path}/{state['base']}").collect()}
    assert rows == {(1, True): 2, (1, False): 4, (2, False): 1} and state["changes"] == []
    assert {r["item_id"]: r["times_worn"] for r in counters.current_counters(spark, path, 0).collect()} == {1: 3}
    assert {r["item_id"]: r["times_worn"] for r in counters.current_counters(spark, path).collect()} == {1: 6, 2: 1}
    with pytest.raises(RuntimeError, match="another job"):
        counters._publish(spark, path, 1, state)
    with pytest.raises(ValueError, match="no wear counters"):
        counters.current_counters(spark, str(tmp_path / "none"))


def test_a_batch_of_wears_is_counted_by_many_tasks(spark, tmp_path):
    spread = spark.range(0, 40, numPartitions=4).select(F.col("id").cast("int").alias("item_id"), F.timestamp_seconds(F.lit(0)).alias("day"), F.spark_partition_id().cast("long").alias("times_worn"), F.timestamp_seconds("id").alias("last_worn_at"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "")
    try:
        counters.merge_batch(spread, 0, str(tmp_path / "t"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [tracker.getStageInfo(s).numTasks for job in tracker.getJobIdsForGroup("counted") for s in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(s)]
    assert 4 in tasks and 1 not in tasks  # the four parts of the batch are worked out apart, and no task has them all
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= counters.CHANGE_FILES
    assert {r["item_id"]: r["times_worn"] for r in counters.current_counters(spark, str(tmp_path / "t")).collect()} == {i: i // 10 for i in range(40)}


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_usage_windows_in_append_mode(spark, tmp_path, slide):
    calls = lambda rows: timed(spark, rows, "endpoint string, tokens long, created_at string", "created_at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema("endpoint string, tokens long, created_at timestamp").parquet(str(tmp_path / "in"))

    def run():
        q = streams.usage_windows(live, "1 hour", slide, "2 hours").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(f"{r['start']:%H:%M}", r["endpoint"]): (r["calls"], r["tokens"]) for r in spark.read.schema("start timestamp, endpoint string, calls long, tokens long").parquet(str(tmp_path / "out")).collect()}

    calls([("a", 1, "2024-01-01 10:10:00"), ("a", 2, "2024-01-01 10:40:00"), ("b", 5, "2024-01-01 10:20:00")])
    assert run() == {}  # no window has ended two hours ago
    calls([("a", 4, "2024-01-01 10:50:00"), ("a", 1, "2024-01-01 13:05:00")])  # late within the watermark, and what closes 10 to 11
    first = run()
    assert first[("10:00", "a")] == (3, 7) and first[("10:00", "b")] == (1, 5) and not any(k[0] >= "11:00" for k in first)
    assert (first.get(("09:30", "a")), first.get(("10:30", "a"))) == (((1, 1), None) if slide else (None, None))
    calls([("a", 100, "2024-01-01 10:30:00"), ("a", 1, "2024-01-01 18:00:00")])  # past the watermark
    last = run()
    assert last[("10:00", "a")] == (3, 7) and last[("13:00", "a")] == (1, 1) and ("18:00", "a") not in last
    if slide:  # this window was still open: it ends at 11:30, the watermark was at 11:05
        assert last[("10:30", "a")] == (3, 106) and last[("09:30", "a")] == (1, 1)


def test_intake_is_idempotent(spark, tmp_path):
    rows = [("same", "2024-01-01 10:00:00"), ("same", "2024-01-01 11:00:00"), ("other", "2024-01-01 11:00:00")]
    timed(spark, rows, "request_id string, received_at string", "received_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("request_id string, received_at timestamp").parquet(str(tmp_path / "in"))
    q = streams.unique_results(live).writeStream.outputMode("append").format("memory").queryName("intake").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["request_id"] for r in spark.table("intake").collect()) == ["other", "same"]


def test_annotations_join_results(spark):
    told = [(str(i), f"{i}.png", "val", i == 4, *["dress", None, None, None, None]) for i in range(6)]
    annotations = spark.createDataFrame(told, "id string, file string, split string, no_clothing boolean, " + ", ".join(f"truth_{a} string" for a in evaluate.ATTRIBUTES))
    found = [(f"{i}.png", 1, *["dress", None, None, None, None], 0.8, 40.0, 1, "ValueError: x" if i == 2 else None) for i in range(5)]
    results = spark.createDataFrame(found, "file string, n_items int, " + ", ".join(f"pred_{a} string" for a in evaluate.ATTRIBUTES) + ", confidence double, latency_ms double, attempts int, error string")
    files = annotations.select("file").where("id <> '1'")
    joined = evaluate.join_results(annotations, results, files.union(files))
    assert {r["id"]: r["skipped"] for r in joined.collect()} == {"0": None, "1": "image not found", "2": None, "3": None, "4": None, "5": "no result"}
    out = evaluate.outcomes(joined.where("skipped is null"))
    assert {r["id"]: r["outcome"] for r in out.collect()} == {"0": "scored", "2": "crashed", "3": "scored", "4": "negative_hit"}
    assert evaluate.detection_counts(out).first()[:4] == (4, 2, 1, 1)


@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_nearest_rank_equals_sorting(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g, n in ((1, 1), (2, 2), (3, 11), (4, 700), (5, 1200)) for v in (rng.exponential(size=n) if g != 5 else rng.integers(0, 9, n))] + [(6, None), (4, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for share in (0.0, 0.5, 0.95, 1.0):
        own = lambda values: sorted(values)[round(share * (len(values) - 1))]
        got = {r["g"]: r["p"] for r in ranks.nearest_rank(df, "v", share, ["g"], "p").collect()}
        assert got == {g: own([v for h, v in rows if h == g and v is not None]) for g in range(1, 6)}
        assert ranks.nearest_rank(df, "v", share, [], "p").first()["p"] == own([v for _, v in rows if v is not None])
    assert ranks.nearest_rank(df.where("g = 6"), "v", 0.5, ["g"], "p").count() == 0


@pytest.mark.parametrize(("one", "centres", "block"), [(50_000, 1, 4_096), (50_000, 1, 50), (0, 1, 4_096), (0, 40, 7)])
def test_similar_items_equal_all_pairs(spark, monkeypatch, one, centres, block):
    for name, value in (("TILE_QUERIES", 5), ("CELL_BLOCK", block), ("ASKING", 9), ("MOST_CENTRES", centres), ("ONE_CELL", one)):
        monkeypatch.setattr(embed, name, value)
    rng = np.random.default_rng(6)
    v = np.round(np.repeat(rng.normal(size=(12, 4)), 10, axis=0) + 0.2 * rng.normal(size=(120, 4)), 1)
    v[30:40], v[50] = v[:10], 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item_id long, embedding array<float>").repartition(3)
    odd = df.union(spark.createDataFrame([(500, None), (None, [1.0, 0.0, 0.0, 0.0])], df.schema))
    got = {}
    for r in embed.similar_items(odd, odd, 4).orderBy("query_id", "rank").collect():  # all items are queries
        got.setdefault(r["query_id"], []).append(r["item_id"])
    u = v.astype(np.float32).astype(float)
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-8)
    sim = np.round(u @ u.T, 6)
    assert got == {q: sorted((i for i in range(120) if i != q), key=lambda i: (-sim[q, i], i))[:4] for q in range(120)}
    few = embed.similar_items(df.where("item_id = 3"), df.where("item_id < 3"), 5)
    assert few.count() == 3 and embed.similar_items(df, df.where("false"), 5).count() == 0


def test_a_search_leaves_far_cells_out():
    rng = np.random.default_rng(8)
    v = embed._unit(np.repeat(np.eye(16), 50, axis=0) + 0.03 * rng.normal(size=(800, 16)))
    apart = embed._apart(v, np.eye(16))
    cell = apart.argmin(axis=1)
    own = apart[np.arange(800), cell]
    cells = embed.Cells(np.eye(16), np.bincount(cell, minlength=16), *(np.array([f(own[cell == c]) for c in range(16)]) for f in (np.min, np.max)))
    home = cells.home(apart, 5)
    assert (home.sum(axis=1) == 1).all()
    sim = v @ v.T
    assert all((sim[:, cell == c].max(axis=1) <= cells.most_alike(apart)[:, c] + 1e-9).all() for c in range(16))
    fifth = np.sort(sim, axis=1)[:, -6]
    assert (~home & (cells.most_alike(apart) >= fifth[:, None])).sum() == 0


def test_large_owner_is_searched_through_buckets(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 32)
    rng = np.random.default_rng(9)
    near = rng.normal(size=(600, 24))
    v = np.concatenate([near, near + 0.3 * rng.normal(size=(600, 24)), rng.normal(size=(1800, 24)), np.repeat(rng.normal(size=(1, 24)), 90, axis=0)])
    rows = [(1, i, [float(x) for x in r]) for i, r in enumerate(v)] + [(None, 5000, [1.0] * 24), (None, 5001, [1.0] * 24), (None, 5002, [-1.0] * 24), (2, 5000, [1.0] * 24), (2, None, [1.0] * 24), (2, 5003, None)]
    df = spark.createDataFrame(rows, "user_id int, item_id long, embedding array<float>").repartition(4)
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sim = u @ u.T
    want = {(i, j) for i, j in zip(*np.nonzero(sim >= 0.95)) if i < j}
    found = embed.duplicate_items(df, 0.95).collect()
    got = [(r["a"], r["b"]) for r in found if r["user_id"] == 1]
    assert len(got) == len(set(got)) and set(got) <= want  # no pair twice, none wrong
    border = {p for p in want if p[1] < 1200}
    assert len(set(got)) >= 0.98 * len(want) and len(border & set(got)) >= 0.9 * len(border) and len(border) > 100
    assert [(r["a"], r["b"]) for r in found if r["user_id"] is None] == [(5000, 5001)]
    exact = {(r["a"], r["b"]) for r in embed.duplicate_items(df.where("user_id = 1"), 0.95, recall=1.0).collect()}
    assert exact == want
    copies = lambda recall: embed.dealt_blocks(df, 0.95, "user_id", recall).count()
    assert copies(0.99) < 0.5 * copies(1.0)
    assert embed.dealt_blocks(df, 0.3, "user_id", 0.99).where("bucket is not null").count() == 0  # buckets would not pay


def test_buckets_grow_in_proportion(spark):
    sizes = spark.createDataFrame([(n,) for n in (1_000, 100_000, 1_000_000, 100_000_000)], "total long")
    bits, tables = embed._bucket_plan(F.col("total"), 0.95, 0.99)
    got = [(r["b"], r["t"]) for r in sizes.select(bits.alias("b"), tables.alias("t")).collect()]
    assert got[0][1] == 0 and got[2][1] < 20 and got[3][1] < 60 < 1_000_000 / embed.BLOCK


def test_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 0.01 + np.eye(3)[i % 3]]) for i in range(30)]
    got = {r["item_id"]: r["cluster"] for r in embed.cluster_items(spark.createDataFrame(rows, "item_id int, embedding array<float>"), 3).collect()}
    assert len(got) == 30 and {frozenset(i for i in got if got[i] == c) for c in set(got.values())} == {frozenset(range(k, 30, 3)) for k in range(3)}


def test_heads_profiles_labels_layers(spark):
    heads = spark.createDataFrame([(1, "category"), (1, "color"), (1, "style"), (1, "subcategory")], "id int, attribute string")
    told, colour = zeroshot.active_heads(heads, ["category", "color", "subcategory"])
    assert [r["attribute"] for r in told.collect()] == ["category"] and colour.count() == 1
    assert detect.profile_limits("fast", 0.3, 6) == (0.3, 4) and detect.profile_limits("thorough", 0.2, 6) == (0.15, 8) and detect.profile_limits("standard", 0.3, 6) == (0.3, 6)
    labels = spark.createDataFrame([(" Shirt",), ("x",), (None,)], "l string").select(detect.coarse_label(F.col("l"), {"shirt": "top"}).alias("g"))
    assert [r["g"] for r in labels.collect()] == ["top", "other", "other"]
    worn = spark.createDataFrame([(1, "outer", 2), (1, "top", None), (1, "shoes", 0)], "outfit_id int, slot string, layer_order int")
    assert outfits.layer_order(worn).first()["slots"] == ["shoes", "top", "outer"]
    box = [F.lit(2), F.lit(4), F.lit(10), F.lit(12)]
    rows = spark.range(1).select(*[geometry.mask_row_in_crop(F.lit(y), box, F.lit(50), F.lit(100)).alias(f"y{y}") for y in (0, 7, 95)]).first()
    assert tuple(rows) == (2, 5, 49)


def test_conversation_rollup_with_latency(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 3, 10.0), (1, 1, "assistant", None, 5, 30.0)], "conv_id int, turn int, role string, text string, tokens int, latency_ms double")
    r = assistant.conversation_rollup(rows).first()
    assert (r["tokens"], r["mean_ms"], r["last_role"], r["last_text"]) == (8, 20.0, "assistant", None)
    assert "tokens" not in assistant.conversation_rollup(rows.drop("tokens")).columns


def test_configuration_files_and_sinks(spark, tmp_path):
    names = ["category", "material", "pattern", "style"]
    spec = {"attributes": {n: {"labels": [{"value": f"{n}1", "prompt": "a photo", "group": "top"}], "confidence_cap": 0.6} for n in names} | {"season": {"enabled": False, "labels": []}}}
    (tmp_path / "v.json").write_text(json.dumps(spec, indent=1))
    words = io.read_vocabulary(spark, str(tmp_path / "v.json"))
    assert words.count() == 4 and words.where("attribute = 'style'").first()["cap"] == 0.6
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"code": "x", "when": {"material_in": ["silk"]}, "message": "no `{material}`"}]}))
    rule = io.read_rules(spark, str(tmp_path / "r.json"))[0]
    assert (rule.code, rule.severity, rule.penalty, rule.require) == ("x", "error", 0.1, {})
    (tmp_path / "a.json").write_text('{"version": 1, "images": [{"id": "x", "file": "x.png", "expected": {"category": "dress", "color": null}}]}')
    first = io.read_annotations(spark, str(tmp_path / "a.json"))
    io.write_annotation_document(first, str(tmp_path / "doc"))
    assert io.read_annotations(spark, str(tmp_path / "doc")).collect() == first.collect()
    io.write_report(spark.createDataFrame([("a", 1), ("é", None)], "k string, n int"), str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report"), wholetext=True).first()[0]) == [{"k": "a", "n": 1}, {"k": "é"}]


def test_read_images(spark, tmp_path):
    raw = b"\x89PNG\r\n\x1a\n"
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw += chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + bytes([255, 0, 0, 0, 0, 255]))) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(raw)
    r = io.read_images(spark, str(tmp_path)).first()
    assert (r["width"], r["height"], bytes(r["data"])) == (2, 1, bytes([0, 0, 255, 255, 0, 0]))
    stored = io.admit_uploads(io.read_images(spark, str(tmp_path), decode=False)).first()
    assert stored["admission"] == "ok" and bytes(stored["content"]) == raw
