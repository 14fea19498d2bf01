"""Wear counters as a table that a stream of wears keeps: versions, small changes, compaction.

The folder holds data files and one small manifest a version:

    base/<version>     item_id, day, times_worn, last_worn_at; a null day holds the sum of all closed days
    change/<batch>     the same for the days that a batch changed, in their latest state
    manifest/<version> {"base": ..., "changes": [...], "batch": ..., "closed": ...}

A batch writes its change and then the next manifest, by a rename that either happens or not, so a reader
sees one version or the next and never half of one.  A batch that is repeated finds its own number in the
manifest and changes nothing.  After COMPACT changes base and changes become one new base, in which days that
no late wear can reach any more are summed up by item, so that the table holds a row for each item and for
its open days.  Files that neither of the last two versions uses are deleted: a reader may finish the version before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.storage import delete

#: Changes until base and changes become one; files of a change at most, and of a base for each million of its rows.
COMPACT, CHANGE_FILES, ROWS_A_FILE = 8, 8, 1_000_000

SCHEMA = "item_id {kind}, day timestamp, times_worn long, last_worn_at timestamp"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    hadoop, fs = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(hadoop(folder))] if fs.exists(hadoop(folder)) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{path}/manifest") if n.isdigit())


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    hadoop, fs = _fs(spark, path)
    stream = fs.open(hadoop(f"{path}/manifest/{version}"))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """The manifest of a version, whole or not at all; an existing one is never replaced."""
    hadoop, fs = _fs(spark, path)
    temporary = hadoop(f"{path}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(json.dumps(content).encode())
    out.close()
    if not fs.rename(temporary, hadoop(f"{path}/manifest/{version}")):
        fs.delete(temporary, False)
        raise RuntimeError(f"version {version} of {path} was written by another job")


def _files(path: str, content: dict) -> list[str]:
    return [f"{path}/{p}" for p in ([content["base"]] if content["base"] else []) + [c["path"] for c in content["changes"]]]


def _states(spark: SparkSession, path: str, content: dict) -> DataFrame:
    """item_id, day, times_worn, last_worn_at: the latest state of each open day, and the sum of the closed ones."""
    schema = SCHEMA.format(kind=content["kind"])
    rows = spark.read.schema(schema).parquet(f"{path}/{content['base']}").withColumn("at", F.lit(-1)) if content["base"] else spark.createDataFrame([], f"{schema}, at int")
    for change in content["changes"]:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/{change['path']}").withColumn("at", F.lit(change["batch"])))
    latest = F.max_by(F.struct("times_worn", "last_worn_at"), "at").alias("s")
    return rows.groupBy("item_id", "day").agg(latest).select("item_id", "day", "s.*")


def merge_batch(days: DataFrame, batch_id: int, path: str, lateness: str = "1 day") -> None:
    """Adds a batch (item_id, day, times_worn, last_worn_at in their latest state) to the table as its next version.

    `lateness` is the watermark's delay: a day that ended so long before the latest wear is closed.
    """
    spark = days.sparkSession
    known = versions(spark, path)
    now = manifest(spark, path, known[-1]) if known else {"base": None, "changes": [], "batch": -1, "kind": days.schema["item_id"].dataType.simpleString(), "closed": None}
    if batch_id <= now["batch"]:
        return
    version = known[-1] + 1 if known else 0
    change = f"change/{batch_id}-{uuid.uuid4().hex}"
    rows = days.select("item_id", F.col("day").cast("timestamp").alias("day"), F.col("times_worn").cast("long").alias("times_worn"), F.col("last_worn_at").cast("timestamp").alias("last_worn_at"))
    rows.repartition(CHANGE_FILES, "item_id").write.parquet(f"{path}/{change}")  # a coalesce would run the batch's joins and counts of all partitions in one task
    after = now | {"changes": [*now["changes"], {"path": change, "batch": batch_id}], "batch": batch_id}
    if len(after["changes"]) >= COMPACT:
        after = _compacted(spark, path, version, after, lateness)
    _publish(spark, path, version, after)
    _forget(spark, path, version, now, after)


def _compacted(spark: SparkSession, path: str, version: int, content: dict, lateness: str) -> dict:
    states = _states(spark, path, content)
    latest = states.agg(F.max("last_worn_at")).first()[0]
    limit = F.lit(latest).cast("timestamp") - F.expr(f"interval {lateness}")
    closed = F.col("day").isNull() | (F.col("day") + F.expr("interval 1 day") <= limit)
    kept = states.withColumn("day", F.when(~closed, F.col("day"))).groupBy("item_id", "day").agg(F.sum("times_worn").alias("times_worn"), F.max("last_worn_at").alias("last_worn_at"))
    base = f"base/{version}-{uuid.uuid4().hex}"
    n_files = max(1, states.count() // ROWS_A_FILE)
    kept.repartition(n_files, "item_id").write.parquet(f"{path}/{base}")
    return content | {"base": base, "changes": [], "closed": str(latest)}


def _forget(spark: SparkSession, path: str, version: int, before: dict, after: dict) -> None:
    """Deletes manifests and files that neither this version nor the one before uses."""
    used = {*_files(path, before), *_files(path, after)}
    for folder in ("base", "change"):
        for name in _names(spark, f"{path}/{folder}"):
            if f"{path}/{folder}/{name}" not in used:
                delete(spark, f"{path}/{folder}/{name}")
    for name in _names(spark, f"{path}/manifest"):
        if not name.isdigit() or int(name) < version - 1:
            delete(spark, f"{path}/manifest/{name}")


def keep_counters(stream: DataFrame, path: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Runs a `wear_counter_stream` over what is there and merges each of its batches into the table at `path`."""
    merge = lambda batch, batch_id: merge_batch(batch, batch_id, path, lateness)
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def current_counters(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """item_id, times_worn, last_worn_at as of the latest version, or of one of the last two."""
    known = versions(spark, path)
    if not known:
        raise ValueError(f"no wear counters at {path}")
    states = _states(spark, path, manifest(spark, path, known[-1] if version is None else version))
    return states.groupBy("item_id").agg(F.sum("times_worn").alias("times_worn"), F.max("last_worn_at").alias("last_worn_at"))


def counted_items(items: DataFrame, counters: DataFrame) -> DataFrame:
    """All columns of `items` with times_worn (0 if never) and last_worn_at as the table has them."""
    plain = items.drop("times_worn", "last_worn_at")
    return plain.join(counters, "item_id", "left").withColumn("times_worn", F.coalesce("times_worn", F.lit(0)))
