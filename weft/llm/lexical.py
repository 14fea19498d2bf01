"""Ranked lexical search: impact vectors in buckets by length, pruned by bounds, rescored exactly in integers.

1. Every document becomes a sparse vector over the terms that items ask for: how often it has
   each, and how many terms it has in all.  Totals and document frequencies are counted from
   these vectors, over all documents, and turn counts into impacts (integers).
2. Both sides carry the square root of a term's weight, so that an item's score is the inner
   product of its vector and a document's.  Vectors are put in order by length within each
   task, the longest first, and met in buckets.
3. The longest `HEAD_SHARE` of all vectors go first, over all tasks; the k-th best score that
   an item gets there is the least that any other document must reach.
4. A bucket is skipped for an item if the product of lengths is below that (Cauchy-Schwarz).
   In a bucket, a document's coordinates at the item's heaviest terms give a bound: their exact
   part plus the product of the lengths of both rests.  Survivors are scored exactly in 64-bit
   integers.  Bounds carry a slack for rounding and never lose a document.

Nothing is capped: bounds decide what is not scored, and ties at the k-th place are settled by id.
Items are asked in blocks of about `BLOCK_BYTES` of text; a block's terms are broadcast, and each
block is a pass over the documents.

Terms are maximal runs of ASCII letters, digits and bytes above 0x7F, with A-Z lower-cased.
Null and empty texts have no terms and do not count as documents with one.  Repeated documents
are documents each.  Items are the distinct (item_id, text) rows: a repeated row is one item,
texts that share an id are each ranked, a null id is an id; items without terms, or whose terms
no document has, have no row.  A document with a null id is the last among equal scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import arrow_map, byte_texts, scratch, small_batches, small_enough, stored

#: Bytes of item text in a block; share of the vectors that go first; cells of a bucket's matrix; terms of an item that bound it in a bucket.
BLOCK_BYTES, HEAD_SHARE, CELLS, FOCUS = 4_000_000, 1 / 32, 1_000_000, 8
#: What bounds in doubles are raised by.
SLACK = 1e-9

_TERM = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def count_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), terms, counts: one row for each of `docs` (doc_id, text), over the terms of `vocabulary`."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in (small for big in batches for small in small_batches(big, text_col="text")):
            sizes, offsets, names, counts = [], [0], [], []
            for text in byte_texts(batch.column("text")):
                found = terms(text)
                sizes.append(len(found))
                own = Counter(map(number, found))
                own.pop(None, None)
                names.extend(own.keys())
                counts.extend(own.values())
                offsets.append(len(names))
            at = pa.array(offsets, pa.int32())
            arrays = [pa.ListArray.from_arrays(at, pa.array(names, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *arrays], ["doc_id", "n", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


class Items:
    """The items of a block as vectors: `terms`, integer weights times occurrences, their part per root of weight, and what bounds need."""

    def __init__(self, asked: list[Counter], weights: np.ndarray) -> None:
        self.root = np.sqrt(weights.astype(np.float64))
        self.parts = []
        for own in asked:
            ids = np.array([t for t in own if weights[t] > 0], np.int64)
            times = np.array([own[t] for t in ids], np.int64)
            side = self.root[ids] * times
            order = np.argsort(-side, kind="stable")
            ids, times, side = ids[order], times[order], side[order]
            rest = math.sqrt(float((side[FOCUS:] ** 2).sum()))
            self.parts.append((ids, weights[ids] * times, side[:FOCUS], rest, math.sqrt(float((side**2).sum()))))


def _best(rows: list[tuple], k: int) -> list[tuple]:
    """The k first of (score, id) rows: highest score, then least id, null ids last."""
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:k]


class Ranking:
    """The k best documents of each item among those met; `least` is the score that a document must reach."""

    def __init__(self, items: Items, k: int, least: np.ndarray) -> None:
        self.items, self.k, self.least = items, k, least.copy()
        self.rows: list[list[tuple]] = [[] for _ in items.parts]
        self.lengths = np.array([p[4] for p in items.parts])
        self.scored = 0

    def meet(self, ids: list, impacts: np.ndarray, lengths: np.ndarray) -> None:
        """A bucket: impacts (documents x terms, int64) and their vectors' lengths."""
        sides = impacts * self.items.root
        place = np.empty(len(ids), np.int64)
        place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
        for q in np.flatnonzero(self.lengths * lengths.max(initial=0.0) * (1 + SLACK) >= self.least):
            own, weights, side, rest, _ = self.items.parts[q]
            near = sides[:, own[:FOCUS]]
            most = near @ side + rest * np.sqrt(np.maximum(lengths**2 - (near**2).sum(axis=1), 0) + SLACK * lengths**2)
            left = np.flatnonzero(most * (1 + SLACK) >= self.least[q])
            if not len(left):
                continue
            self.scored += len(left)
            scores = impacts[np.ix_(left, own)] @ weights
            good = np.flatnonzero(scores >= self.least[q])
            if not len(good):
                continue
            left, scores = left[good], scores[good]
            first = np.lexsort((place[left], -scores))[: self.k]
            self.rows[q] = _best(self.rows[q] + [(int(scores[i]), ids[left[i]]) for i in first], self.k)
            if len(self.rows[q]) == self.k:
                self.least[q] = max(self.least[q], self.rows[q][-1][0])


def _ranked(vectors: DataFrame, shared, k: int, least: np.ndarray) -> DataFrame:
    """ask, score, doc_id: what each task finds best for each item among its `vectors` (doc_id, length, terms, impacts)."""
    kind = vectors.schema["doc_id"].dataType.simpleString()
    floor = vectors.sparkSession.sparkContext.broadcast(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, items = shared.value
        ranking = Ranking(items, k, floor.value)
        width = len(items.root)
        for batch in (small for big in batches for small in small_batches(big, rows=max(1, CELLS // max(1, width)))):
            lists = batch.column("terms")
            at = lists.offsets.to_numpy()
            impacts = np.zeros((batch.num_rows, width), np.int64)
            impacts[np.repeat(np.arange(batch.num_rows), np.diff(at)), lists.flatten().to_numpy()] = batch.column("impacts").flatten().to_numpy()
            ranking.meet(batch.column("doc_id").to_pylist(), impacts, batch.column("length").to_numpy())
        found = [(a, *r) for a, rows in zip(asks, ranking.rows) for r in rows]
        doc_type = batch.schema.field("doc_id").type if found else None
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], doc_type)], ["ask", "score", "doc_id"])

    ordered = vectors.sortWithinPartitions(F.desc("length")).select("doc_id", "length", "terms", "impacts")
    return arrow_map(ordered, run, f"ask long, score long, doc_id {kind}")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weighted_vectors(index: DataFrame, n_docs: int, n_terms: int, roots: np.ndarray) -> DataFrame:
    """doc_id, length, terms, impacts for the rows of `index` that have a term."""
    shared = index.sparkSession.sparkContext.broadcast(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            sides = batch.column("impacts").flatten().to_numpy() * shared.value[lists.flatten().to_numpy()]
            starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
            sums = np.add.reduceat(sides**2, starts) if len(starts) else np.empty(0)  # no row is without a term
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.sqrt(sums)), lists, batch.column("impacts")], ["doc_id", "length", "terms", "impacts"])

    kind = index.schema["doc_id"].dataType.simpleString()
    usual = F.lit(25) + F.expr(f"(75 * n * {n_docs}L) div {n_terms}L")
    impact = F.transform("counts", lambda tf: F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * F.col("m")))
    rows = index.where(F.size("terms") > 0).withColumn("m", usual).select("doc_id", "terms", impact.alias("impacts"))
    return arrow_map(rows, run, f"doc_id {kind}, length double, terms array<int>, impacts array<long>")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, id, score: the `k` documents of highest score above 0 for each item (item_id, text)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(spark) as keep:
        asked = keep(items.where(F.col("text").isNotNull()).select("item_id", "text").distinct().withColumn("ask", F.monotonically_increasing_id()))
        n_blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
        dealt = F.pmod(F.xxhash64("ask"), F.lit(n_blocks))
        found = None
        for block in range(n_blocks):
            some = _search_block(source, asked.where(dealt == block), k, keep)
            if some is not None:
                found = some if found is None else found.unionByName(some)
        if found is None:
            found = source.limit(0).select(F.lit(0).cast("long").alias("ask"), F.lit(0).cast("long").alias("score"), "doc_id", F.lit(0).alias("rank"))
        named = found.join(small_enough(asked.select("ask", "item_id")), "ask")
        return stored(named.select("item_id", "rank", F.col("doc_id").alias(id_col), "score"))


def _search_block(source: DataFrame, block: DataFrame, k: int, keep) -> DataFrame | None:
    """ask, score, doc_id, rank for a block of items, or None if no document has any of their terms."""
    rows = block.select("ask", "text").collect()  # about BLOCK_BYTES
    asked = [Counter(terms(r["text"].encode())) for r in rows]
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for own in asked for t in own))}
    index = keep(count_vectors(source, vocabulary))
    n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a number for each term of the block
    if not holding:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    questions = Items([Counter({vocabulary[t]: n for t, n in own.items()}) for own in asked], weights)
    vectors = keep(weighted_vectors(index, n_docs, n_terms, questions.root))
    shared = source.sparkSession.sparkContext.broadcast(([r["ask"] for r in rows], questions))
    edge = vectors.agg(F.percentile_approx("length", 1 - HEAD_SHARE)).first()[0]
    least = np.ones(len(rows), np.int64)
    head = keep(_top(_ranked(vectors.where(F.col("length") >= edge), shared, k, least), k))
    reached = {r["ask"]: r["least"] for r in head.groupBy("ask").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()}  # a number for each item of the block
    least = np.array([reached.get(r["ask"], 1) for r in rows], np.int64)
    rest = _ranked(vectors.where(F.col("length") < edge), shared, k, least)
    return _top(head.drop("rank").unionByName(rest), k)
