"""The best outfits of each user out of all combinations of top, bottom and shoes: a rank join with bounds.

What two or three items do together depends on their colour families and styles alone, their kind; what an
item does by itself is its own value.  So an outfit's points are a constant of its three kinds plus a sum of
values, and three reductions lose nothing:

1. In a slot, a kind's k items of highest value suffice: any outfit with another one has k better ones that
   differ in this item alone.  Of a combination of kinds, outfits whose items have the places x, y and z among these
   count only if x * y * z <= k: all others with no later places are better.
2. A combination of kinds has a bound, its constant plus the highest values; a pair of top and bottom has one that
   holds with any shoes.  Combinations of the k pairs of the highest bounds are made first, of them the k of the
   highest bounds; the k-th best of their outfits is what all others must reach.
3. Only pairs, and of these only combinations, whose bound reaches that are made.

There is no limit of items by slot.  Kinds are at most families x styles for each slot, whatever the wardrobe
holds, so a user with very many items costs one pass over these.  Points are integers, so that ties are ties:
they are settled by top, bottom and shoes.
"""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.outfits import FACTORS, REQUIRED, pair_harmony
from weft.storage import scratch, stored

#: Weights in hundredths: of harmony, of style, and of what an item does by itself (preference, last use, availability).
HARMONY, STYLE, OWN = (round(100 * sum(FACTORS[f] for f in names)) for names in (["color_harmony"], ["style_compatibility"], ["personal_preference", "recent_usage", "wardrobe_availability"]))
#: Points of an outfit in which all is perfect.
MOST_POINTS = 300 * (HARMONY + STYLE + OWN)


def kind_points(families: list[Column], styles: list[Column]) -> Column:
    """Points of three items for their colours and styles, in units of a 300th of a hundredth of weight."""
    a, b, c = families
    harmony = sum(F.round(10 * pair_harmony(x, y)).cast("long") for x, y in ((a, b), (a, c), (b, c)))  # tenths, of three pairs
    x, y, z = styles
    alike = F.when((x == y) & (y == z), 3).when((x == y) | (x == z) | (y == z), 2).otherwise(1)
    return (10 * HARMONY * harmony + 100 * STYLE * alike).cast("long")


def pair_points(a: Column, b: Column, x: Column, y: Column) -> Column:
    """The most `kind_points` of a top and a bottom of families a, b and styles x, y, with any shoes."""
    harmony = F.round(10 * pair_harmony(a, b)).cast("long") + 20
    return (10 * HARMONY * harmony + 100 * STYLE * F.when(x == y, 3).otherwise(2)).cast("long")


def best_outfits(items: DataFrame, k: int = 12) -> DataFrame:
    """user_id, top, bottom, shoes, points, score (0 to 100), rank: the k best outfits of each user.

    items: user_id, item_id, slot, status, color_family, style, value (integer from 0 to 100).  Active items of the required slots count;
    a missing family or style is a kind of its own, a missing value is 0.
    """
    told = items.where((F.col("status") == "active") & F.col("slot").isin(REQUIRED)).select(
        "user_id", "slot", "item_id", F.coalesce("color_family", F.lit("")).alias("family"), F.coalesce("style", F.lit("")).alias("style"), F.coalesce("value", F.lit(0)).cast("long").alias("value")
    )
    w = Window.partitionBy("user_id", "slot", "family", "style").orderBy(F.desc("value"), "item_id")
    first = told.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

    def side(rows: DataFrame, slot: str, *more: str) -> DataFrame:
        return rows.where(F.col("slot") == slot).select("user_id", *[F.col(c).alias(f"{slot}_{c}") for c in ("family", "style", *more)])

    of = lambda c: [F.col(f"{s}_{c}") for s in REQUIRED]
    names = lambda slots: [f"{s}_{c}" for s in slots for c in ("family", "style")]
    by_user = Window.partitionBy("user_id")
    with scratch(items.sparkSession) as keep:
        first = keep(first)
        kinds = keep(first.where("place = 1").select("user_id", "slot", "family", "style", F.col("value").alias("most")))
        shoes = side(kinds, "shoes", "most")
        top, bottom, _ = REQUIRED
        most_shoes = shoes.groupBy("user_id").agg(F.max("shoes_most").alias("most_shoes"))
        pairs = side(kinds, top, "most").join(side(kinds, bottom, "most"), "user_id").join(most_shoes, "user_id")
        pairs = pairs.withColumn("pair_bound", pair_points(F.col("top_family"), F.col("bottom_family"), F.col("top_style"), F.col("bottom_style")) + OWN * (F.col("top_most") + F.col("bottom_most") + F.col("most_shoes"))).drop("most_shoes")

        def triples(some: DataFrame) -> DataFrame:
            out = some.drop("pair_bound").join(shoes, "user_id").withColumn("fixed", kind_points(of("family"), of("style")))
            return out.withColumn("bound", F.col("fixed") + OWN * sum(of("most"))).drop(*[f"{s}_most" for s in REQUIRED])

        def made(some: DataFrame) -> DataFrame:
            out = some
            for i, s in enumerate(REQUIRED):
                out = out.join(side(first, s, "item_id", "value", "place"), ["user_id", f"{s}_family", f"{s}_style"])
                out = out.where(reduce(mul, [F.col(f"{x}_place") for x in REQUIRED[: i + 1]]) <= k)
            return out.select("user_id", *[F.col(f"{s}_item_id").alias(s) for s in REQUIRED], (F.col("fixed") + OWN * sum(of("value"))).alias("points"))

        def highest(rows: DataFrame, bound: str, slots: list[str]) -> DataFrame:
            return rows.withColumn("r", F.row_number().over(by_user.orderBy(F.desc(bound), *names(slots)))).where(F.col("r") <= k).drop("r")

        ranked = lambda df: df.withColumn("rank", F.row_number().over(by_user.orderBy(F.desc("points"), *REQUIRED))).where(F.col("rank") <= k)
        head = highest(triples(highest(pairs, "pair_bound", [top, bottom])), "bound", REQUIRED)
        reached = keep(ranked(made(head)).where(F.col("rank") == k).select("user_id", F.col("points").alias("least")))
        reaches = lambda rows, bound: rows.join(reached, "user_id", "left").where(F.col("least").isNull() | (F.col(bound) >= F.col("least"))).drop("least")
        open_ = reaches(triples(reaches(pairs, "pair_bound")), "bound")
        best = ranked(made(open_)).select("user_id", *REQUIRED, "points", F.floor(F.col("points") * 100 / MOST_POINTS + 0.5).cast("int").alias("score"), "rank")
        return stored(best)
