"""Shopping: products that complete outfits, price alerts, spend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.outfits import REQUIRED, pair_harmony
from weft.storage import join_same

#: Prices of a product up to which its history is one window.
HOT = 200_000


def completes_outfits(products: DataFrame, items: DataFrame) -> DataFrame:
    """product_id, user_id, completes_outfits, compatibility.

    completes_outfits: combinations of the user's active items over the other two required slots
    whose colours go with the product's (harmony above 0); compatibility: their share of all.
    products: product_id, user_id, slot, color_family.  Items are counted by slot and family first, so
    hot users cost as many rows as they have families.
    """
    owned = items.where((F.col("status") == "active") & F.col("slot").isin(REQUIRED)).groupBy("user_id", F.col("slot").alias("own_slot"), F.col("color_family").alias("own_family")).agg(F.count(F.lit(1)).alias("n"))
    pairs = products.where(F.col("slot").isin(REQUIRED)).join(owned, "user_id").where("own_slot <> slot")
    fit = F.sum(F.when(pair_harmony(F.col("color_family"), F.col("own_family")) > 0, F.col("n")).otherwise(0))
    slots = pairs.groupBy("product_id", "user_id", "own_slot").agg(fit.alias("fit"), F.sum("n").alias("n"))
    both = slots.groupBy("product_id", "user_id").agg(F.count(F.lit(1)).alias("k"), F.min("fit").alias("a"), F.max("fit").alias("b"), F.min("n").alias("c"), F.max("n").alias("d"))
    return both.where("k = 2").select("product_id", "user_id", (F.col("a") * F.col("b")).alias("completes_outfits"), F.round(F.col("a") * F.col("b") / (F.col("c") * F.col("d")), 4).alias("compatibility"))


def lowest_price(prices: DataFrame, days: int = 31, parts: int | None = None) -> DataFrame:
    """Adds lowest_so_far: the running minimum of a product's price in the order of seen_at, then price.

    A product of more than HOT prices is cut into spans of `days`, each a window of its own.  A span's minimum is one row, whose
    running minimum says what came before the span.  Those rows are few and broadcast; so are the products that are cut.
    parts: into how many tasks windows are dealt; none: as Spark decides.
    """
    hot = prices.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("product_id", F.lit(True).alias("_cut"))
    day = F.floor(F.datediff(F.to_date("seen_at"), F.to_date(F.lit("1970-01-01"))) / days)
    rows = join_same(prices, F.broadcast(hot), ["product_id"], "left").withColumn("_span", F.when(F.col("_cut"), day))
    spans = rows.where("_cut").groupBy("product_id", "_span").agg(F.min("price").alias("_least"))
    earlier = Window.partitionBy("product_id").orderBy(F.asc_nulls_first("_span")).rowsBetween(Window.unboundedPreceding, -1)
    before = spans.select("product_id", "_span", F.min("_least").over(earlier).alias("_before"))
    inside = Window.partitionBy("product_id", "_span").orderBy("seen_at", "price").rowsBetween(Window.unboundedPreceding, 0)
    dealt = rows.repartition(parts, "product_id", "_span") if parts else rows.repartition("product_id", "_span")
    joined = join_same(dealt.withColumn("_own", F.min("price").over(inside)), F.broadcast(before), ["product_id", "_span"], "left")
    return joined.select(*prices.columns, F.least("_own", "_before").alias("lowest_so_far"))


def price_alerts(wishes: DataFrame, prices: DataFrame) -> DataFrame:
    """Active wishes with alerts on whose product's latest price is at the target or below."""
    latest = prices.groupBy("product_id").agg(F.max_by("price", F.struct("seen_at", -F.col("price"))).alias("price"))
    return wishes.where("alert_enabled and status = 'active'").join(latest, "product_id").where(F.col("price") <= F.col("target_price"))


def spend(purchases: DataFrame) -> DataFrame:
    """currency, user_id, month, category, brand, store, total, n: by user, by user and month, by category, brand and store, never across currencies."""
    rows = purchases.withColumn("month", F.to_date(F.date_trunc("month", "purchased_on")))
    keys = ["currency", "user_id", "month", "category", "brand", "store"]
    sets = [["currency"], ["currency", "user_id"], ["currency", "user_id", "month"], ["currency", "category"], ["currency", "brand"], ["currency", "store"]]
    return rows.groupingSets(sets, *keys).agg(F.sum(F.col("price").cast("decimal(18,4)")).alias("total"), F.count(F.lit(1)).alias("n"))
