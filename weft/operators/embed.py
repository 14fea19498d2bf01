"""Search, duplicates and clusters of item vectors.

Vectors of one table have one length.  Rows without an id or a vector take no part; a vector of
zeros is as like any other as 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from weft.storage import join_same, scratch, small_enough, stored

#: Vectors that centres are learned from, most centres, and rounds of learning; they set what a search costs, never what it finds.
CENTRE_SAMPLE, MOST_CENTRES, CENTRE_ROUNDS = 10_000, 1_024, 4
#: Items of a cell in one block, queries that one block's task answers, and queries of one product of matrices.
CELL_BLOCK, ASKING, TILE_QUERIES = 4_096, 8_192, 512
DEALT = ["cell", "block", "deal", "asks", "item_id", "embedding"]
#: Items up to which all are one cell, as finding cells costs more than it spares.
ONE_CELL = 50_000
#: Vectors of one owner, or bucket, in one block of the duplicate search.
BLOCK = 1_024
#: Blocks from which an owner is searched through buckets, if these take fewer copies; the most bits of a bucket's key.
LARGE, MOST_BITS = 8, 24


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def _best(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row and their ids, ties by id; only what reaches a row's k-th value is put in order."""
    k = min(k, sim.shape[1])
    least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
    row, col = np.nonzero(sim >= least[:, None])
    own, value = ids[col], sim[row, col]
    order = np.lexsort((own, -value, row))
    begin = np.searchsorted(row, np.arange(len(sim)))
    first = order[begin[:, None] + np.arange(k)]
    return value[first], own[first]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of `a` to those of `b`."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0))


def learn_centres(rows: DataFrame, n_centres: int) -> np.ndarray:
    """Centres of unit vectors, from the CENTRE_SAMPLE rows of least hash."""
    some = rows.select("item_id", "embedding").orderBy(F.xxhash64("item_id"), "item_id").limit(CENTRE_SAMPLE).toArrow()
    v = _unit(_matrix(some.column("embedding").combine_chunks()))
    centres = np.unique(v, axis=0)[:: max(1, len(v) // n_centres)][:n_centres]
    for _ in range(CENTRE_ROUNDS):
        near = _apart(v, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


class Cells:
    """Centres with the number of items nearest to each, and the least and greatest distance of these."""

    def __init__(self, centres: np.ndarray, sizes: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> None:
        self.centres, self.sizes, self.inner, self.outer = centres, sizes, inner, outer

    def home(self, apart: np.ndarray, k: int) -> np.ndarray:
        """For each query (distances to all centres) the nearest cells that hold more than k items together."""
        order = np.argsort(apart, axis=1, kind="stable")
        sizes = self.sizes[order]
        wanted = np.cumsum(sizes, axis=1) - sizes <= k
        out = np.zeros(apart.shape, bool)
        np.put_along_axis(out, order, wanted, axis=1)
        return out & (self.sizes > 0)

    def most_alike(self, apart: np.ndarray) -> np.ndarray:
        """The greatest similarity that an item of each cell can have (triangle inequality; vectors are of length 1 or 0)."""
        least = np.maximum(np.maximum(apart - self.outer, self.inner - apart), 0)
        return 1 - least**2 / 2


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """item_id, embedding, cell, apart."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _apart(_unit(_matrix(batch.column("embedding"))), shared.value) if batch.num_rows else np.zeros((0, 1))
            cell = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("embedding"), pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(cell)), cell])], ["item_id", "embedding", "cell", "apart"])

    return rows.select("item_id", "embedding").mapInArrow(run, f"item_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, cell int, apart double")


def _visits(asks: DataFrame, cells: Cells, k: int, reached: str | None = None) -> DataFrame:
    """item_id, embedding, cell: the cells that each query visits, its home cells at first; those that may hold a better item once it has `reached` a similarity."""
    shared = asks.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            apart = _apart(_unit(_matrix(batch.column("embedding"))), known.centres) if batch.num_rows else np.zeros((0, 1))
            if not len(apart):
                continue
            wanted = known.home(apart, k)
            if reached:
                least = batch.column(reached).to_numpy(zero_copy_only=False)[:, None] - 2e-6  # similarities are compared at six digits
                wanted = ~wanted & (known.sizes > 0) & (known.most_alike(apart) >= least)
            row, cell = np.nonzero(wanted)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(at), batch.column("embedding").take(at), pa.array(cell, pa.int32())], ["item_id", "embedding", "cell"])

    return asks.mapInArrow(run, f"item_id long, embedding {asks.schema['embedding'].dataType.simpleString()}, cell int")


def _met(visits: DataFrame, placed: DataFrame, k: int, keep) -> DataFrame:
    """query_id, item_id, similarity: the k items of each block that are most like each query that visits the block's cell.

    A block is at most about CELL_BLOCK items of a cell, and ASKING visits of it are a task's work.
    """
    visits = keep(visits)
    plan = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_BLOCK).cast("int").alias("blocks"))
    plan = keep(plan.join(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("deals")), "cell"))
    plan = small_enough(plan)
    return _answers(_dealt(placed.join(plan, "cell"), visits.join(plan, "cell"), F.col("blocks"), F.col("deals")), k)


def _dealt(base: DataFrame, probe: DataFrame, blocks: Column, deals: Column) -> DataFrame:
    """Items and the queries that visit their cells, together by cell, block and deal, items first."""
    dealt = lambda n: F.pmod(F.xxhash64("item_id"), n).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = base.withColumn("block", dealt(blocks)).withColumn("deal", span(deals)).withColumn("asks", F.lit(False))
    probe = probe.withColumn("deal", dealt(deals)).withColumn("block", span(blocks)).withColumn("asks", F.lit(True))
    return base.select(DEALT).union(probe.select(DEALT)).repartition("cell", "block", "deal").sortWithinPartitions("cell", "block", "deal", "asks")


def _answers(rows: DataFrame, k: int) -> DataFrame:
    """query_id, item_id, similarity from `_dealt` rows; a block's items are held, what asks it is streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, ids, vectors = None, [], np.empty(0, np.int64), None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in DEALT[:4]], axis=1)
            if not len(keys):
                continue
            names, v = batch.column("item_id").to_numpy(), _unit(_matrix(batch.column("embedding")))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(keys)]):
                key, asks = tuple(keys[at, :3]), keys[at, 3]
                if key != last:
                    last, held, vectors = key, [], None
                if not asks:
                    held.append((names[at:to], v[at:to]))
                    continue
                if vectors is None and held:
                    ids, vectors, held = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), []
                if vectors is None:
                    continue
                for some in range(at, to, TILE_QUERIES):
                    own = slice(some, min(to, some + TILE_QUERIES))
                    sim = np.where(names[own, None] == ids[None, :], -np.inf, np.round(v[own] @ vectors.T, 6))
                    value, found = _best(sim, ids, k)
                    real = np.isfinite(value)
                    query = np.repeat(names[own], value.shape[1]).reshape(value.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(query[real]), pa.array(found[real]), pa.array(value[real])], ["query_id", "item_id", "similarity"])

    return rows.mapInArrow(run, "query_id long, item_id long, similarity double")


def similar_items(queries: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """query_id, item_id, similarity, rank: the k items most like each query, itself left out; exact.

    queries, items: item_id, embedding; all items may be queries.  Items lie in cells around centres.  A query visits the nearest
    cells that hold more than k items, and then only cells that can hold a better item than the k-th found (triangle inequality).
    Queries are rows that are dealt to the cells they visit; the driver holds centres and one row a cell.  A repeated query id counts once.
    Up to ONE_CELL items are one cell.
    """
    spark = items.sparkSession
    told = lambda df: df.where("item_id is not null and embedding is not null").select(F.col("item_id").cast("long").alias("item_id"), "embedding")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    rows, asks = told(items), told(queries).dropDuplicates(["item_id"])
    total = rows.count()
    if total <= ONE_CELL:
        parts = [F.lit(max(1, -(-n // size))) for n, size in ((total, CELL_BLOCK), (asks.count(), ASKING))]
        return ranked(_answers(_dealt(*(df.withColumn("cell", F.lit(0)) for df in (rows, asks)), *parts), k))
    with scratch(spark) as keep:
        centres = learn_centres(rows, min(MOST_CENTRES, max(1, math.isqrt(total) // 2)))
        placed = keep(_placed(rows, centres))
        found = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("apart").alias("inner"), F.max("apart").alias("outer")).collect()}
        column = lambda name: np.array([found[c][name] if c in found else 0 for c in range(len(centres))])
        cells = Cells(centres, column("n"), column("inner") - 1e-9, column("outer") + 1e-9)
        asks = keep(asks)
        first = keep(ranked(_met(_visits(asks, cells, k), placed, k, keep)))
        reached = first.groupBy("query_id").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("n")).select(F.col("query_id").alias("item_id"), F.when(F.col("n") == k, F.col("least")).alias("least"))
        open_ = asks.join(reached, "item_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        rest = _met(_visits(open_, cells, k, "least"), placed, k, keep)
        return stored(ranked(first.drop("rank").union(rest)))


def _bucket_plan(total: Column, threshold: float, recall: float) -> tuple[Column, Column]:
    """(bits, tables) of the buckets of an owner of `total` vectors; 0 tables where blocks are as good.

    Each bit is the side of a random plane; two vectors at the threshold agree in one with probability p, so that a table of
    b bits holds them together with p**b, and t tables lose 1 - recall of such pairs at most.
    """
    blocks = F.ceil(total / BLOCK)
    p = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = F.least(F.greatest(F.floor(F.log2(4 * total / BLOCK)), F.lit(1)), F.lit(MOST_BITS)).cast("int")
    if recall >= 1 or p <= 0.5:
        return bits, F.lit(0)
    tables = F.when(F.lit(p >= 1), F.lit(1)).otherwise(F.ceil(F.lit(math.log(1 - recall)) / F.ln(1 - F.least(F.pow(F.lit(p), bits), F.lit(1 - 1e-9)))))
    return bits, F.when((blocks >= LARGE) & (2 * tables < blocks), tables).otherwise(F.lit(0)).cast("int")


def _bucketed(rows: DataFrame, seed: int) -> DataFrame:
    """The rows with `keys`: the bucket of each in `tables` tables of `bits` planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.empty((0, 0))
        for batch in batches:
            keys: list[np.ndarray] = [np.empty(0, np.int64)] * batch.num_rows
            if batch.num_rows:
                v = _unit(_matrix(batch.column("embedding")))
                plan = pd.DataFrame({c: batch.column(c).to_numpy() for c in ("bits", "tables")})
                for (bits, tables), some in plan.groupby(["bits", "tables"]).indices.items():
                    if planes.shape[1] < tables * MOST_BITS:  # a table's planes are the same in every batch
                        planes = np.concatenate([np.random.default_rng([seed, t]).normal(size=(v.shape[1], MOST_BITS)) for t in range(tables)], axis=1)
                    side = (v[some] @ planes[:, : tables * MOST_BITS] > 0).reshape(len(some), tables, MOST_BITS)[:, :, :bits]
                    for i, own in zip(some, side @ (1 << np.arange(bits, dtype=np.int64))):
                        keys[i] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("keys", ArrayType(LongType()))]))


def dealt_blocks(items: DataFrame, threshold: float, by: str, recall: float, seed: int = 1) -> DataFrame:
    """by, bucket (table and key; null for a small owner), i, j (blocks), p (own block), item_id, embedding, keys: what is compared together, once for each group."""
    rows = items.where("item_id is not null and embedding is not null").select(by, F.col("item_id").cast("long").alias("item_id"), "embedding")
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    bits, tables = _bucket_plan(F.col("total"), threshold, recall)
    planned = join_same(rows, total.select(by, "total", bits.alias("bits"), tables.alias("tables")), [by])
    n_blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    small = planned.where("tables = 0").select(by, F.lit(None).cast("struct<t:int,key:long>").alias("bucket"), "item_id", "embedding", F.array().cast("array<long>").alias("keys"), n_blocks.alias("n"))
    large = _bucketed(planned.where("tables > 0").drop("total"), seed).select(by, "item_id", "embedding", "keys", F.posexplode("keys").alias("t", "key"))
    large = large.select(by, F.struct("t", "key").alias("bucket"), "item_id", "embedding", "keys")
    sizes = large.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(by, "bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("n"))
    rows = small.unionByName(join_same(large, sizes, [by, "bucket"])).withColumn("p", F.pmod(F.xxhash64("item_id"), F.col("n")).cast("int"))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select(by, "bucket", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "p", "item_id", "embedding", "keys")


def duplicate_items(items: DataFrame, threshold: float = 0.95, by: str = "user_id", recall: float = 0.99) -> DataFrame:
    """by, a, b, similarity: pairs of an owner's items at the threshold or above (a < b); items without an owner are one owner's.

    An owner is cut into blocks of BLOCK items, and each pair of its blocks is one group: exact, with a copy of a vector for each block.
    An owner of many blocks is dealt to random-plane buckets instead, if the tables that find a pair at the threshold with
    probability `recall` are fewer than half its blocks; a bucket of many vectors is cut into blocks again, every candidate is checked on full
    vectors, and a pair is given by the first table that has it.  With a recall of 1 all owners are exact.  Rows that repeat an item count once.
    """
    kind = items.schema[by].dataType.simpleString()

    def pairs(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, bucket, i, j = key
        frame = frame.drop_duplicates("item_id").sort_values("item_id")
        left, right = frame[frame["p"] == i], frame[frame["p"] == j]
        unit = lambda some: _unit(np.stack(some["embedding"].to_list()).astype(np.float64))
        sim = unit(left) @ unit(right).T if len(left) and len(right) else np.zeros((0, 0))
        x, y = np.nonzero(sim >= threshold)
        a, b = left["item_id"].to_numpy()[x], right["item_id"].to_numpy()[y]
        keep = a < b if i == j else a != b
        table = bucket["t"] if bucket is not None else 0
        if table and len(x):
            seen = [np.stack(some["keys"].to_list())[at, :table] for some, at in ((left, x), (right, y))]
            keep &= ~(seen[0] == seen[1]).any(axis=1)
        return pd.DataFrame({by: key[0], "a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": sim[x, y][keep]})

    return dealt_blocks(items, threshold, by, recall).groupBy(by, "bucket", "i", "j").applyInPandas(pairs, f"{by} {kind}, a long, b long, similarity double")


def _cluster_sums(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """cluster, n, sums: of the unit vectors that each task finds nearest to each centre, a row for each at most."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _unit(_matrix(batch.column("embedding")))
                near = _apart(v, shared.value).argmin(axis=1)
                np.add.at(sums, near, v)
                counts += np.bincount(near, minlength=len(counts))
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], ["cluster", "n", "sums"])

    return rows.select("embedding").mapInArrow(run, "cluster int, n long, sums array<double>")


def learn_clusters(items: DataFrame, k: int = 8, rounds: int = 10) -> np.ndarray:
    """Centres of unit vectors, from all items: they begin as the vectors of the k least ids, and `rounds` times each becomes the mean of those nearest to it.

    A centre without vectors stays, and of equally near ones the first counts.  The driver holds the centres alone.
    """
    rows = items.where("item_id is not null and embedding is not null")
    start = rows.groupBy("item_id").agg(F.min("embedding").alias("embedding")).orderBy("item_id").limit(k).collect()
    if not start:
        return np.zeros((0, 1))
    centres = _unit(np.array([r["embedding"] for r in start], np.float64))
    for _ in range(rounds):
        found = _cluster_sums(rows, centres).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(centres.shape[1])]).alias("sums")).collect()  # k rows at most
        moved = centres.copy()
        for r in found:
            moved[r["cluster"]] = np.array(r["sums"]) / r["n"]
        if (moved == centres).all():
            break
        centres = moved
    return centres


def assign_clusters(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """item_id, cluster (the nearest centre), apart (its distance) for every item that has a vector."""
    shared = items.sparkSession.sparkContext.broadcast(centres)
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(shared.value):
                apart = _apart(_unit(_matrix(batch.column("embedding"))), shared.value)
                near = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(near, pa.int32()), pa.array(apart[np.arange(len(near)), near])], ["item_id", "cluster", "apart"])

    return items.where("embedding is not null").select("item_id", "embedding").mapInArrow(run, f"item_id {kind}, cluster int, apart double")


def cluster_items(items: DataFrame, k: int = 8, rounds: int = 10) -> DataFrame:
    """item_id, cluster, apart by k-means on unit vectors."""
    return assign_clusters(items, learn_clusters(items, k, rounds))
