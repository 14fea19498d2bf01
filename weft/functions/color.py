"""Colour names, families and distances as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, sRGB anchor, family, lightness band of every named colour, in order.
PALETTE = [
    ("black", "#000000", "black", "dark"),
    ("charcoal", "#2b2b2b", "gray", "dark"),
    ("dark gray", "#4a4a4a", "gray", "dark"),
    ("gray", "#808080", "gray", "any"),
    ("light gray", "#bdbdbd", "gray", "light"),
    ("silver", "#c9ccd1", "gray", "light"),
    ("white", "#ffffff", "white", "any"),
    ("off white", "#f2f0ea", "white", "light"),
    ("cream", "#f5ebd0", "beige", "light"),
    ("ivory", "#fffff0", "white", "light"),
    ("navy blue", "#1b2a4a", "blue", "dark"),
    ("denim blue", "#4a6d8c", "blue", "dark"),
    ("blue", "#2e5aac", "blue", "any"),
    ("sky blue", "#87b7e0", "blue", "light"),
    ("teal", "#1f6f78", "blue", "dark"),
    ("forest green", "#22482f", "green", "dark"),
    ("olive", "#6b7a3a", "green", "dark"),
    ("green", "#3e8e41", "green", "any"),
    ("mint green", "#a8d5ba", "green", "light"),
    ("khaki", "#bdb76b", "beige", "light"),
    ("dark purple", "#3b1e54", "purple", "dark"),
    ("purple", "#7b62b3", "purple", "any"),
    ("lavender", "#c3b1e1", "purple", "light"),
    ("burgundy", "#6e1e2e", "red", "dark"),
    ("maroon", "#5c1a1a", "red", "dark"),
    ("rose", "#c0405a", "pink", "any"),
    ("pink", "#e891a8", "pink", "light"),
    ("magenta", "#b8338a", "pink", "any"),
    ("red", "#c42b1c", "red", "any"),
    ("coral", "#e2725b", "red", "light"),
    ("rust", "#9c4a21", "brown", "dark"),
    ("orange", "#e8762c", "orange", "any"),
    ("terracotta", "#c1653f", "orange", "dark"),
    ("peach", "#f0b295", "orange", "light"),
    ("yellow", "#f2c230", "yellow", "any"),
    ("mustard", "#c8a415", "yellow", "dark"),
    ("mustard yellow", "#d4a017", "yellow", "dark"),
    ("brown", "#6b4423", "brown", "dark"),
    ("chocolate", "#4a2f1b", "brown", "dark"),
    ("tan", "#b08155", "brown", "any"),
    ("camel", "#c19a6b", "beige", "any"),
    ("beige", "#d8c3a5", "beige", "light"),
    ("sand", "#d9c9a3", "beige", "light"),
    ("taupe", "#8b7d6b", "beige", "any"),
]
#: L (0 to 255) above which only light, and below which only dark anchors stand beside the `any` ones.
LIGHT_ABOVE, DARK_BELOW = 78.0, 38.0
#: Linear sRGB to XYZ, and the white point (D65), by row.
_XYZ = ((0.412453, 0.357580, 0.180423, 0.950456), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.088754))
NEUTRAL_FAMILIES = ["black", "white", "gray", "beige"]


def hex_to_rgb(value: Column) -> Column:
    """`#rrggbb` as struct<r, g, b>."""
    digits = F.regexp_replace(value, "^#", "")
    return F.struct(*[F.conv(F.substring(digits, at, 2), 16, 10).cast("int").alias(c) for c, at in (("r", 1), ("g", 3), ("b", 5))])


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int")))
    return F.format_string("#%02x%02x%02x", clip(r), clip(g), clip(b))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """sRGB 0..255 as struct<l, a, b>, 8-bit coded: L from 0 to 255, a and b rounded (D65)."""

    def linear(c: Column) -> Column:
        v = c.cast("double") / 255
        return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)

    x, y, z = (
        (linear(r) * k[0] + linear(g) * k[1] + linear(b) * k[2]) / k[3]
        for k in _XYZ
    )
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * f(y) - 16).otherwise(903.3 * y)
    return F.struct(F.rint(light * 255 / 100).alias("l"), F.rint(500 * (f(x) - f(y))).alias("a"), F.rint(200 * (f(y) - f(z))).alias("b"))


def delta_e(a: Column, b: Column) -> Column:
    """CIE76 distance of two struct<l, a, b>."""
    return F.sqrt(sum((F.pow(a[c] - b[c], F.lit(2.0)) for c in ("a", "b")), F.pow(a["l"] - b["l"], F.lit(2.0))))


def color_family(name: Column) -> Column:
    """Family of a colour name; `other` for an unknown one."""
    known = F.create_map(*[F.lit(x) for n, _, f, _ in PALETTE for x in (n, f)])
    return F.coalesce(F.try_element_at(known, name), F.lit("other"))


def colors_agree(a: Column, b: Column) -> Column:
    """Two names agree if they are the same or of one family; an empty or absent one agrees with nothing."""
    told = a.isNotNull() & b.isNotNull() & (a != "") & (b != "")
    return F.coalesce(told & ((a == b) | (color_family(a) == color_family(b))), F.lit(False))


def _lab_of(hex_value: str) -> tuple[float, float, float]:
    """rgb_to_lab() of one anchor, as plain numbers, so that the palette is a literal of the plan."""
    r, g, b = (((v / 255 + 0.055) / 1.055) ** 2.4 if v / 255 > 0.04045 else v / 255 / 12.92 for v in (int(hex_value[k : k + 2], 16) for k in (1, 3, 5)))
    x, y, z = ((r * k[0] + g * k[1] + b * k[2]) / k[3] for k in _XYZ)
    f = lambda t: t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116
    light = 116 * f(y) - 16 if y > 0.008856 else 903.3 * y
    return float(round(light * 255 / 100)), float(round(500 * (f(x) - f(y)))), float(round(200 * (f(y) - f(z))))


def nearest_color(lab: Column) -> Column:
    """struct<name, distance, hex> of the nearest anchor of the sample's lightness band; ties go to the first anchor.

    `any` samples may take `any` anchors only.
    """
    anchors = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(h).alias("hex"), F.lit(band).alias("band"), F.struct(*[F.lit(v).alias(c) for c, v in zip("lab", _lab_of(h))]).alias("lab")) for i, (n, h, _, band) in enumerate(PALETTE)])
    band = F.when(lab["l"] > LIGHT_ABOVE, "light").when(lab["l"] < DARK_BELOW, "dark").otherwise("any")
    fit = F.filter(anchors, lambda x: (x["band"] == "any") | (x["band"] == band))
    best = F.array_min(F.transform(fit, lambda x: F.struct(delta_e(x["lab"], lab).alias("distance"), x["i"].alias("i"), x["name"].alias("name"), x["hex"].alias("hex"))))
    return F.struct(best["name"].alias("name"), best["distance"].alias("distance"), best["hex"].alias("hex"))


def color_spread(distribution: Column) -> Column:
    """Population standard deviation of a map of shares, without `other`: 1.0 for no colour at all, 0.0 for fewer than two."""
    shares = F.map_values(F.map_filter(distribution, lambda k, _: k != "other"))
    n = F.size(shares)
    mean = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(shares, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    return F.when(distribution.isNull() | (F.size(distribution) == 0), 1.0).when(n < 2, 0.0).otherwise(spread)
