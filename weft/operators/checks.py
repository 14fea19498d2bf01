"""Checks of annotation sets and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = ["train", "val", "test"]


def duplicate_ids(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_splits(annotations: DataFrame) -> DataFrame:
    return annotations.where(~F.coalesce(F.col("split").isin(SPLITS), F.lit(False)))


def by_split(annotations: DataFrame, split: str) -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return annotations.where(F.col("split") == split)


def negatives(annotations: DataFrame) -> DataFrame:
    return annotations.where("no_clothing")


def missing_files(annotations: DataFrame, listing: DataFrame) -> DataFrame:
    """Annotations whose file is not in the listing (file)."""
    return annotations.join(listing.select("file").distinct(), "file", "left_anti")


def label_coverage(rows: DataFrame, attributes: list[str]) -> DataFrame:
    """split (null: all), images, negatives, and labelled photos by attribute."""
    return rows.rollup("split").agg(F.count(F.lit(1)).alias("images"), F.count_if("no_clothing").alias("negatives"), *[F.count_if(F.col(f"truth_{a}").isNotNull()).alias(f"labelled_{a}") for a in attributes])


def incomplete_accounts(accounts: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """user_id, missing: each part that an account lacks."""
    found = [accounts.select("user_id").join(df.select("user_id").distinct(), "user_id", "left_anti").withColumn("missing", F.lit(name)) for name, df in parts.items()]
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out
