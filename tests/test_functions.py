"""Columns against literal cases and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weft.functions import color, geometry, quality, rules, scoring, text, vectors


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, {str: "string", float: "double", int: "int", bool: "boolean", bytes: "binary", list: "array<double>", dict: "map<string,double>"}[type(v)]) for k, v in values.items()))) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("quality_,filled,missing,share,want", [(0.85, False, False, 1.0, 0.95), (0.85, True, False, 1.0, 0.5225), (0.85, False, True, 1.0, 0.7125), (0.30, False, False, 1.0, 0.8075)])
def test_color_score(spark, quality_, filled, missing, share, want):
    c = scoring.color_score(F.lit("blue"), F.lit(share), F.lit(missing), F.lit(filled), F.lit(quality_))
    assert one(spark, c) == pytest.approx(want)


def test_nothing_scored_is_zero(spark):
    none = {k: F.lit(None).cast("double") for k in scoring.WEIGHTS}
    assert one(spark, scoring.fused_confidence(none, F.lit(0.99), F.lit(False), F.lit(0.0))) == 0.0


def test_missing_category_ratio(spark):
    none = {k: F.lit(None).cast("double") for k in scoring.WEIGHTS}
    a = one(spark, scoring.fused_confidence(none | {"color": F.lit(0.8)}, F.lit(0.8), F.lit(False), F.lit(0.0)))
    b = one(spark, scoring.fused_confidence(none | {"color": F.lit(0.8), "category": F.lit(0.8)}, F.lit(0.8), F.lit(False), F.lit(0.0)))
    assert a / b == pytest.approx(0.55)


@pytest.mark.parametrize("value,want", [(0.95, "accepted"), (0.70, "accepted"), (0.69, "accepted_with_uncertainty"), (0.45, "accepted_with_uncertainty"), (0.44, "uncertain"), (0.0, "uncertain")])
def test_status(spark, value, want):
    assert one(spark, scoring.status(F.lit(value))) == want


def test_retry_budget_and_floor(spark):
    got = [one(spark, scoring.should_retry(F.lit("uncertain"), F.lit(0.0), F.lit(1.0), F.lit(n), F.lit(True), 3)) for n in (1, 2, 3, 4)]
    assert got == [True, True, True, False]
    assert [one(spark, scoring.reportable(F.lit("x"), F.lit(v))) for v in (0.19, 0.21)] == [None, "x"]
    assert [one(spark, scoring.storable(F.lit(v), 0.4)) for v in (0.5, 0.2, math.nan, math.inf)] == [True, False, False, False]


def context(**own):
    kinds = {"color_spread": "double", "secondary_colors": "array<string>", "gate_applied": "boolean", "segmentation_filled": "boolean"}
    default = {"gate_applied": False, "segmentation_filled": False, "color_spread": 1.0}
    full = {k: F.lit(own.get(k, default.get(k))).cast(kinds.get(k, "string")) for k in rules.CONTEXT if k != "secondary_colors"}
    return full | {"secondary_colors": F.array(*[F.lit(x) for x in own.get("secondary_colors", [])]).cast("array<string>")}


def fired(spark, rule_set=rules.RULES, **own):
    return [r["code"] for r in one(spark, rules.fired_rules(context(**own), rule_set))]


def test_rules(spark):
    assert fired(spark) == []
    assert fired(spark, measured_color="blue", pattern="striped", color_spread=0.0) == ["pattern_on_flat_colour"]
    assert fired(spark, category="jeans", category_group="bottom", detector_group="top", coarse_label="top") == ["category_outside_detected_group"]
    assert fired(spark, category="jeans", category_group="bottom", detector_group="top", coarse_label="top", gate_applied=True) == []
    assert fired(spark, measured_color="blue", zeroshot_color="brown") == ["color_source_disagreement"]
    assert fired(spark, measured_color="navy blue", zeroshot_color="blue") == []
    assert fired(spark, measured_color="navy blue", secondary_colors=["orange"]) == []  # families: that pair never meets the list
    assert fired(spark, measured_color="black", secondary_colors=["white"]) == ["color_contrast_impossible"]


def test_custom_rules(spark):
    plain = rules.Rule("plain", "error", 0.1, {"category_in": ["t-shirt"]})
    spared = rules.Rule("spared", "error", 0.1, {"category_in": ["t-shirt", "blouse"]}, {"category_in": ["blouse"]})
    assert fired(spark, [plain, spared], category="t-shirt") == ["plain", "spared"]
    assert fired(spark, [plain, spared], category="blouse") == []
    with pytest.raises(KeyError):
        fired(spark, [rules.Rule("bad", "error", 0.1, {"groups_disagree": True})])
    rules.register_predicate("is_hat", lambda ctx, expected: ctx["category"] == "hat")
    assert fired(spark, [rules.Rule("hat", "advisory", 0.0, {"is_hat": True})], category="hat") == ["hat"]


def test_colors(spark):
    for rgb, family in (((30, 60, 200), "blue"), ((200, 40, 40), "red"), ((40, 160, 60), "green")):
        lab = color.rgb_to_lab(*[F.lit(v) for v in rgb])
        assert one(spark, color.color_family(color.nearest_color(lab)["name"])) == family
    assert one(spark, color.color_family(F.lit("plaid"))) == "other"
    assert one(spark, color.colors_agree(F.lit(""), F.lit("blue"))) is False
    assert one(spark, color.color_spread(F.col("m")), m={"red": 0.5, "blue": 0.5}) == 0.0
    assert one(spark, color.color_spread(F.col("m")), m={"red": 0.8, "blue": 0.2}) == pytest.approx(0.3)
    assert one(spark, color.color_spread(F.lit(None).cast("map<string,double>"))) == 1.0


def test_color_names_equal_plain_search(spark):
    from weft.operators import images

    rng = random.Random(2)
    rows = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "r int, g int, b int").withColumn("lab", color.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))).withColumn("name", color.nearest_color(F.col("lab"))["name"])
    for r in df.collect():
        lab = images.lab_of(images.np.array([[r["r"], r["g"], r["b"]]]))[0]
        assert (r["lab"]["l"], r["lab"]["a"], r["lab"]["b"]) == pytest.approx(tuple(lab), abs=1.0)
        own = images.np.array([r["lab"]["l"], r["lab"]["a"], r["lab"]["b"]])
        assert r["name"] == color.PALETTE[images.name_of(own)][0]


def test_geometry(spark):
    rng = random.Random(1)
    for _ in range(5):
        a, b = ([rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(50, 99), rng.uniform(50, 99)] for _ in "ab")
        inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        union = sum((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)) - inter
        assert one(spark, geometry.iou(tuple(map(F.lit, a)), tuple(map(F.lit, b)))) == pytest.approx(inter / union)
    assert one(spark, geometry.tightened_box(*[F.lit(float(v)) for v in (0, 0, 40, 40, 900, 700)])) is None
    assert one(spark, geometry.brighten_gamma(F.lit(None).cast("double"))) is None


def test_quality_boundaries(spark):
    issues = quality.quality_issues(F.lit(79), F.lit(500), F.lit(13.0), F.lit(50.0), F.lit(100.0), F.lit(0.5))
    assert [(r["code"], r["severity"]) for r in one(spark, issues)] == [("low_resolution", "error"), ("too_dark", "error")]
    assert one(spark, quality.quality_score(issues)) == pytest.approx(1 - 1.5 * 0.60)
    assert one(spark, quality.usable(issues)) is False


def test_text(spark):
    assert one(spark, text.decode_list(F.lit(""))) == []
    assert one(spark, text.decode_list(F.lit(None).cast("string"))) is None
    assert one(spark, text.upload_verdict(F.col("b")), b=b"\xff\xd8\xff\xe0") == "ok"
    assert one(spark, text.upload_verdict(F.col("b")), b=b"GIF89a") == "unsupported"
    assert one(spark, text.upload_verdict(F.col("b"), 3), b=b"\xff\xd8\xff\xe0") == "too_large"
    assert one(spark, text.upload_verdict(F.lit(None).cast("binary"))) == "empty"
    assert one(spark, text.identity_key(F.lit(" A@B.c "), F.lit("1"), F.lit("p"), F.lit("c"))) == "a@b.c"
    assert one(spark, text.route_keyword(F.lit("What to wear on a DATE?"), ["date", "formal"])) == "date"


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("a")), a=[3.0, 4.0]) == pytest.approx(1.0)
    assert one(spark, vectors.cosine(F.col("a"), F.array(F.lit(0.0), F.lit(0.0))), a=[3.0, 4.0]) == 0.0
    assert one(spark, vectors.normalise(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]
