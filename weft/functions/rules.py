"""Consistency rules: declarative predicates compiled into columns.

A rule fires if all of `when` holds and not all of `require` (its exceptions) does.
An absent attribute satisfies no predicate, not even a negated one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.color import color_family

#: Material groups, colour families that never meet on a garment, and the flat-colour limit.
MATERIAL_GROUPS = {"heavy": ["wool", "leather", "suede", "denim", "knit"], "lightweight": ["silk", "lace", "linen", "cotton"], "performance": ["polyester", "nylon"]}
CONTRAST_CONFLICTS = [("black", "white"), ("blue", "yellow"), ("navy blue", "orange"), ("purple", "yellow")]
FLAT_SPREAD = 0.045
PERMISSIVE_GROUPS = ["other", "unknown"]


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    penalty: float
    when: dict
    require: dict = field(default_factory=dict)
    message: str = ""


#: The shipped rules, in order.
RULES = [
    Rule("silk_must_be_lightweight", "error", 0.22, {"material_in": ["silk"]}, {"category_not_in": ["jeans", "jacket", "coat", "boots", "blazer"]}, "material `silk` is implausible for category `{category}`"),
    Rule("denim_implies_bottom_or_outer", "error", 0.18, {"material_in": ["denim"]}, {"category_in": ["jeans", "pants", "shorts", "skirt", "jacket", "coat"]}, "material `denim` does not match category `{category}`"),
    Rule("leather_requires_outerwear_or_shoes", "error", 0.20, {"material_in": ["leather", "suede"]}, {"category_in": ["jacket", "coat", "blazer", "boots", "heels", "vest", "sneakers"]}, "material `{material}` does not match category `{category}`"),
    Rule("knit_requires_soft_category", "error", 0.18, {"material_in": ["knit"]}, {"category_in": ["sweater", "hoodie", "shirt", "blazer", "vest", "t-shirt"]}, "material `knit` does not match category `{category}`"),
    Rule("no_sportswear_material_on_formal_category", "advisory", 0.06, {"material_in": ["polyester", "nylon"]}, {"category_not_in": ["blazer", "coat"]}, "performance material `{material}` on category `{category}`"),
    Rule("color_source_disagreement", "error", 0.12, {"color_source_disagree": True}, {}, "zero-shot colour `{zeroshot_color}` disagrees with measured colour `{measured_color}`"),
    Rule("color_contrast_impossible", "error", 0.15, {"color_contrast_excessive": True}, {}, "colours `{primary}` and `{secondary}` are implausible together"),
    Rule("pattern_on_flat_colour", "advisory", 0.07, {"pattern_color_conflict": True}, {}, "pattern `{pattern}` on an almost single-colour measurement"),
    Rule("category_outside_detected_group", "error", 0.20, {"detector_label_mismatch": True}, {}, "category `{category}` contradicts the detected `{coarse_label}`"),
    Rule("occluded_garment", "error", 0.25, {"segmentation_filled": True}, {}, "segmentation fell back to the bounding box; colour may include background"),
]

#: What a rule sees of a garment, as column names: a message may name any of them.
CONTEXT = ["category", "material", "pattern", "measured_color", "zeroshot_color", "secondary_colors", "color_spread", "coarse_label", "detector_group", "category_group", "gate_applied", "segmentation_filled"]
Predicate = Callable[[dict[str, Column], object], Column]


def _member(name: str, inside: bool) -> Predicate:
    def test(ctx: dict[str, Column], expected: list[str]) -> Column:
        held = ctx[name].isin(expected)
        return held if inside else ~held

    return test


def _contrast(ctx: dict[str, Column], _: object) -> Column:
    pairs = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for p in CONTRAST_CONFLICTS for a, b in (p, p[::-1])])
    primary = color_family(ctx["measured_color"])
    return (ctx["measured_color"] != "") & F.exists(ctx["secondary_colors"], lambda s: F.array_contains(pairs, F.struct(primary.alias("x"), color_family(s).alias("y"))))


def _told(c: Column) -> Column:
    return c.isNotNull() & (c != "")


PREDICATES: dict[str, Predicate] = {
    **{f"{a}_in": _member(a, True) for a in ("category", "material", "pattern")},
    **{f"{a}_not_in": _member(a, False) for a in ("category", "material", "pattern")},
    "material_group_in": lambda ctx, groups: ctx["material"].isin([m for g in groups for m in MATERIAL_GROUPS.get(g, [])]),
    "color_source_disagree": lambda ctx, _: _told(ctx["zeroshot_color"]) & _told(ctx["measured_color"]) & (color_family(ctx["zeroshot_color"]) != color_family(ctx["measured_color"])),
    "color_contrast_excessive": _contrast,
    "pattern_color_conflict": lambda ctx, _: ctx["measured_color"].isNotNull() & ~ctx["pattern"].isin("solid", "other") & (ctx["color_spread"] < FLAT_SPREAD),
    "detector_label_mismatch": lambda ctx, _: ~ctx["gate_applied"] & ~ctx["detector_group"].isin(PERMISSIVE_GROUPS) & ~ctx["category_group"].isin(PERMISSIVE_GROUPS) & ctx["category"].isNotNull() & (ctx["category_group"] != ctx["detector_group"]),
    "segmentation_filled": lambda ctx, _: ctx["segmentation_filled"],
}


def register_predicate(name: str, predicate: Predicate) -> None:
    """Make a custom predicate (context columns, expected value) -> column known to rules."""
    PREDICATES[name] = predicate


def _holds(clause: dict, ctx: dict[str, Column]) -> Column:
    held = F.lit(True)
    for name, expected in clause.items():
        if name not in PREDICATES:
            raise KeyError(f"unknown predicate {name!r}; known: {sorted(PREDICATES)}")
        held = held & F.coalesce(PREDICATES[name](ctx, expected), F.lit(False))
    return held


def render_message(template: str, ctx: dict[str, Column]) -> Column:
    """The template with `{name}` filled in from the context; raw if it names anything else."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    if any(name not in ctx for name in parts[1::2]):
        return F.lit(template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else F.coalesce(ctx[p].cast("string"), F.lit("None")) for k, p in enumerate(parts)])


def fired_rules(ctx: dict[str, Column], rules: list[Rule] = RULES) -> Column:
    """array of struct<code, severity, penalty, detail> of the rules that fire, in rule order."""
    found = []
    for r in rules:
        fires = _holds(r.when, ctx)
        if r.require:
            fires = fires & ~_holds(r.require, ctx)
        found.append(F.when(fires, F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), F.lit(r.penalty).alias("penalty"), render_message(r.message, ctx).alias("detail"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def flags(fired: Column) -> Column:
    return F.transform(fired, lambda x: x["code"])


def total_penalty(fired: Column) -> Column:
    """Sum of the penalties of error rules; advisory ones add none."""
    return F.aggregate(fired, F.lit(0.0), lambda s, x: s + F.when(x["severity"] == "error", x["penalty"]).otherwise(0.0))


def consistent(fired: Column) -> Column:
    return ~F.exists(fired, lambda x: x["severity"] == "error")
