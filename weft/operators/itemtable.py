"""Item tables on disk: patches that rewrite only what they touch, and a trigram index for search.

`write_items` lays items out in folders by a hash of their id, each sorted by id.  `merge_into` reads and writes the
folders that patches fall into, and no other (dynamic partition overwrite); what it writes is first made whole
in the shared folder, so that a lost executor leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.text import matches_search
from weft.operators.wardrobe import merge_patches
from weft.storage import scratch

#: Folders of a table; rows of the trigram index in a file; candidates whose ids become a condition on the items' files.
BUCKETS, INDEX_ROWS, NAMED = 256, 2_000_000, 1_000


def bucket_of(item_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(item_id.cast("string")), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    writer = rows.repartition("bucket").sortWithinPartitions("bucket", "item_id").write.mode(mode).partitionBy("bucket")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def write_items(items: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A new table of `items` at `path`, in `buckets` folders."""
    _write(items.withColumn("bucket", bucket_of(F.col("item_id"), buckets)), path, "errorifexists")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_into(spark: SparkSession, path: str, patches: DataFrame, floor: float = 0.2, buckets: int = BUCKETS) -> list[int]:
    """Merges patches (see `merge_patches`) into the table at `path`; the folders that were rewritten.

    The table is as if `merge_patches` had run over all of it.  `buckets` must be what it was written with.
    """
    with scratch(spark) as keep:
        patches = keep(patches)
        touched = sorted(r[0] for r in patches.select(bucket_of(F.col("item_id"), buckets)).distinct().collect())  # at most `buckets` numbers
        if not touched:
            return []
        items = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        if items.where(F.col("bucket") != bucket_of(F.col("item_id"), buckets)).limit(1).count():
            raise ValueError(f"{path} was not written with {buckets} folders")
        merged = keep(merge_patches(items.drop("bucket"), patches, floor).withColumn("bucket", bucket_of(F.col("item_id"), buckets)))
        _write(merged, path, "overwrite")
    return touched


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of a text, lower-cased; none of a shorter or null one."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, 3))), F.array().cast("array<string>"))


def _grams(items: DataFrame) -> DataFrame:
    """item_id, grams: the trigrams of each row's name, colour and style; few large splits of `items` become as many tasks as there are."""
    told = items.where("item_id is not null").select("item_id", "name", "color", "style").repartition("item_id")
    return told.select("item_id", F.array_distinct(F.concat(*[trigrams(F.col(c)) for c in ("name", "color", "style")])).alias("grams"))


def write_search_index(items: DataFrame, path: str, files: int | None = None) -> None:
    """gram, item_id for the names, colours and styles of `items`, in order of grams over files, so that a gram's rows are in few of them.

    Each row of `items` gives its trigrams once, so no task holds pairs to compare them; a pair may repeat for an item in several rows.
    """
    own = _grams(items)
    files = files or max(1, (own.agg(F.sum(F.size("grams"))).first()[0] or 0) // INDEX_ROWS)
    rows = own.select(F.explode("grams").alias("gram"), "item_id")
    rows.repartitionByRange(files, "gram", "item_id").sortWithinPartitions("gram", "item_id").write.parquet(path)


def search_indexed(items: DataFrame, index: DataFrame, query: str = "", category: str = "All") -> DataFrame:
    """What `search_items` finds in `items`, by the index: items that have all trigrams of the query, then checked by their text.

    A query of fewer than three characters has no trigram and reads all items.  The ids of few candidates are a condition on the items' files; more are joined.
    """
    text = query.strip().lower()
    found = items
    if len(text) >= 3:
        grams = list(dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2)))
        having = index.where(F.col("gram").isin(grams)).groupBy("item_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("item_id")
        few = [r[0] for r in having.limit(NAMED + 1).collect()]
        found = items.where(F.col("item_id").isin(few)) if len(few) <= NAMED else items.join(having, "item_id", "left_semi")
    found = found.where(matches_search(query, F.col("name"), F.col("color"), F.col("style")))
    return found if category == "All" else found.where(F.col("category") == category)
