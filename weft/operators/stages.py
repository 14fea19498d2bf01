"""Plug-in stages: a model or kernel over a table of photos, loaded once a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructType

Stage = Callable[[dict], list[dict]]


def apply_stage(df: DataFrame, factory: Callable[[], Stage], schema: StructType | str, key: str = "image_id") -> DataFrame:
    """key, the stage's columns and error: what `factory()` makes of each row, none to many rows.

    A row that fails gives one row with its error and nulls; the job goes on.
    """
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType([df.schema[key], *out.fields]).add("error", StringType())
    names = full.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stage = factory()
        for frame in batches:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    rows += [{key: row[key], **r, "error": None} for r in stage(row)]
                except Exception as e:  # noqa: BLE001  a failing photo degrades its own row
                    rows.append({key: row[key], "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, full)
