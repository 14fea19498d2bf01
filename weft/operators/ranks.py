"""Exact nearest-rank percentiles without one task for all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.storage import join_same

#: Rows out of which the sketch of a percentile may be off by one.
ACCURACY = 10_000


def nearest_rank(rows: DataFrame, value: str, share: float, by: list[str], name: str, **more: Column) -> DataFrame:
    """by, `name`: the value of rank round(share * (n - 1)), half-even, from 0; and the aggregates `more` of each group.

    A sketch brackets the rank; rows below the bracket are only counted, and only the few distinct values inside it are put in order.
    A group of at most ACCURACY rows is put in order as it is.  Null values do not count; rows of a null key are a group.
    """
    rows = rows.where(F.col(value).isNotNull()).withColumn("value", F.col(value))
    width = 4 / ACCURACY
    bounds = rows.groupBy(*by).agg(F.percentile_approx("value", [max(0.0, share - width), min(1.0, share + width)], ACCURACY).alias("bracket"), F.count(F.lit(1)).alias("total"), *[c.alias(k) for k, c in more.items()])
    near = join_same(rows.select(*[F.col(b) for b in by], "value"), bounds, by) if by else rows.select("value").join(F.broadcast(bounds), F.lit(True))
    few = F.col("total") <= ACCURACY
    inside = near.where(few | (F.col("value") <= F.col("bracket")[1])).withColumn("own", F.when(few | (F.col("value") >= F.col("bracket")[0]), F.col("value")))  # null: below the bracket
    counts = inside.groupBy(*by, "total", *more, "own").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "total").orderBy(F.asc_nulls_first("own")).rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("upto", upto).where(F.col("own").isNotNull() & (F.col("upto") > F.bround(share * (F.col("total") - 1), 0)))
    return reached.groupBy(*by, *more).agg(F.min("own").alias(name))
