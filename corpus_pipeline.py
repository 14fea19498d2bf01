"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm.pipeline import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "oracle_sql", "queries", "run"]

#: Learned weights, tokens and alignments are beyond SQL; the stages are tested against plain Python versions.
ORACLE_SQL = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
