"""Intermediate tables in the folder that the driver and all executors share, and joins on keys that may be null."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a list that is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Folders of the `scratch` blocks that are open, the innermost last.
_OPEN: ContextVar[tuple[str, ...]] = ContextVar("open_folders", default=())


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-weft-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where they are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local-cluster") or not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    Called in a `scratch` block, for what is to outlive it: the table belongs to the block around that one, and goes with it.
    Without one around, it is a result, and stays.
    """
    around = _OPEN.get()[:-1]
    return written(df, f"{around[-1] if around else shared_dir(df.sparkSession)}/weft-{uuid.uuid4().hex}")


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder that is deleted at the end of the block."""
    folder = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        delete(spark, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A `stored` whose tables are deleted at the end of the block, with what blocks inside it have stored for it."""
    with scratch_folder(spark) as folder:
        token = _OPEN.set((*_OPEN.get(), folder))
        try:
            yield lambda df: written(df, f"{folder}/{uuid.uuid4().hex}")
        finally:
            _OPEN.reset(token)


def join_same(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left.join(right, by, how) in which nulls of a key are equal."""
    renamed = right.withColumnsRenamed({c: f"_same_{c}" for c in by})
    return left.join(renamed, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in by]), how).drop(*[f"_same_{c}" for c in by])


def small_enough(rows: DataFrame) -> DataFrame:
    """`rows` (stored), marked for broadcast if there are few; joins give the same either way."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
