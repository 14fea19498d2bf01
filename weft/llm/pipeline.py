"""Stages of the corpus pipeline: filters over documents, then packing.

Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`,
whatever else these hold.  Rows with null ids, null or empty texts, repeated rows and empty tables are
handled as the operator of each stage says; no stage fails on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import decontam, neardup, packing, quality, rules
from weft.llm.common import scratch, stored, table
from weft.llm.queries import TOKENIZER


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are near a language reference.

    Null, empty and short texts go, as they fail the base rules; repeated rows all stay or go.
    """
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rule ensemble, learned from the labelled ones among them, predicts good.

    Without labelled rows, or with one label alone, all rows stay.  Null and empty texts are scored as texts of zeros; rows with a null id are scored and never learned from.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates.

    Of equal rows one stays; rows that share an id but not a text are different documents; texts without words all stay.
    """
    return neardup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item.

    Null and empty texts hold none; without items all rows stay; repeated rows all stay or go.
    """
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining row's pieces, with their sequence and place.

    Null and empty texts are one piece of the closing id; repeated rows are packed each; an empty table has no pieces.
    """
    return packing.pack(docs, TOKENIZER, 2048)


STAGES = [(f.__name__, f) for f in (quality_rules, quality_classifier, near_dedup, benchmark_decontamination, best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each stored and read back; only the result stays."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        for _, stage in STAGES[:-1]:
            docs = keep(stage(spark, docs, sf_dir))
        return stored(STAGES[-1][1](spark, docs, sf_dir))
