"""Registered queries of the wardrobe jobs: each plan module has QUERIES, function -> oracle SQL (None where SQL cannot express it)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from weft.plans.fixtures import with_views

MODULES = ["garments", "detection", "evaluation", "wardrobe", "outfits", "planner", "streams"]


def _all() -> dict:
    return {f: sql for m in MODULES for f, sql in import_module(f"weft.plans.{m}").QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _all()}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: with_views(sql) for f, sql in _all().items() if sql}
