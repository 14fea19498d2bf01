"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.storage import scratch, shared_dir, stored

__all__ = ["Memo", "any_names", "arrow_map", "byte_texts", "free_name", "hash_mod", "scratch", "shared_dir", "small_batches", "small_enough", "stored", "table"]

#: Bytes that a memo of a worker may hold, and bytes of text in one slice of a batch.
MEMO_BYTES, SLICE_BYTES = 16_000_000, 1_000_000
#: Rows of a list of numbers, and of wider rows, that is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_WIDE = 500_000, 50_000
#: Rows of a batch that Spark hands to a Python task.
ARROW_ROWS = 512


def small_enough(rows: DataFrame, wide: bool = True) -> DataFrame:
    """`rows` (stored), marked for broadcast if there are few; joins give the same either way."""
    return F.broadcast(rows) if rows.count() <= (BROADCAST_WIDE if wide else BROADCAST_ROWS) else rows


def arrow_map(rows: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """rows.mapInArrow(run, schema), with Arrow batches of at most ARROW_ROWS rows in this session from now on.

    Long texts in Spark's usual batches of 10,000 fill memory outside the heap, in the executor and its Python workers alike.
    """
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, ARROW_ROWS)
    return rows.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def any_names(rows_of: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a function of `docs` that returns the columns of `docs`: dotted names and the like, which Python maps can't take, are others meanwhile."""

    @wraps(rows_of)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        plain = [c if c.isidentifier() else free_name(docs, f"column_{i}") for i, c in enumerate(docs.columns)]
        return rows_of(docs.toDF(*plain), *args, **options).toDF(*docs.columns)

    return run


def hash_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id, so that it is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of every text, null as empty, with no detour over `str`.

    `bytes.split()` cuts at 0x20 and 0x09-0x0D alone, and `bytes.lower()` lowers A-Z alone, which is what the operators call words and case.
    """
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def small_batches(batch: pa.RecordBatch, rows: int = 512, text_col: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most `rows` rows and, where `text_col` is given, about SLICE_BYTES of its text, so that working arrays stay small."""
    start, n = 0, batch.num_rows
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if text_col else None
    while start < n:
        stop = min(n, start + rows)
        if ends is not None:
            full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, side="right"))
            stop = min(stop, max(full, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


class Memo(dict):
    """What `make` gives for each key (text or bytes), within about `most` bytes: when half of them is used, what was not asked for since the last time goes."""

    def __init__(self, make: Callable, most: int | None = None) -> None:
        super().__init__()
        self.make, self.half, self.held, self.before = make, (most or MEMO_BYTES) // 2, 0, {}

    def __missing__(self, key):
        value = self.before.get(key)
        return self.remember(key, self.make(key) if value is None else value)

    def remember(self, key, value):
        size = 150 + 4 * len(key)
        if self.held + size > self.half:
            self.before, self.held = dict(self) if size <= self.half else {}, 0
            self.clear()
        self.held += size
        self[key] = value
        return value
