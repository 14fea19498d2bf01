"""Best-fit packing by sum of squares: documents into sequences of a fixed token capacity.

A document is its token ids and one closing id 0; only longer ones are cut, into
full pieces and a last shorter one.  What decides a packing is how many pieces
there are of each length, at most `capacity` counts, so the plan is made from that
histogram and its size does not grow with the corpus: `plan_packing` divides the
counts by a number of copies, packs the quotient (a *unit* of at most `UNIT_PIECES`
pieces) piece by piece with the sum-of-squares rule, uses that unit once per copy,
and treats the remainders the same way until none are left.

Pieces then find their place by arithmetic on their rank among pieces of the same
length.  Ranks come from salted windows, so that one very common length is no
single task.  The plan is broadcast: it has at most `UNIT_PIECES` rows a level, and
the levels are about log(pieces) / log(UNIT_PIECES / capacity).

Null and empty texts are one piece of length 1 (the closing id).  Repeated rows are
packed each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import arrow_map, scratch, small_batches, stored
from weft.llm.tokens import TextEncoder, load_vocabulary

#: Pieces that the sum-of-squares rule places one by one, for each level of the plan.
UNIT_PIECES = 60_000
#: Pieces of one length that one window task ranks, about.
RANK_ROWS = 2_000


def cut_documents(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32: each document's pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(shared.value)
        for batch in (small for big in batches for small in small_batches(big, 256)):
            rows: list[tuple] = []
            for key, text in enumerate(batch.column("text").to_pylist()):
                ids = encoder.encode(text) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            key, piece, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(key)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_unit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing of `lengths`, longest first: bin and offset of each.

    With N[g] open bins of gap g, a piece of length s that goes into a gap g changes
    the sum of squares by 2 * (N[g - s] - N[g]) + 2, or by 1 - 2 * N[s] if it closes
    the bin.  A bin is opened only when no open one fits, which takes fewer bins than
    letting a new one compete.  Ties go to the smaller gap.
    """
    n_open = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, s in enumerate(lengths):
        fits = n_open[s:]
        change = 2 * (n_open[: capacity + 1 - s] - fits) + 2
        change[0] = 1 - 2 * fits[0]
        change[fits == 0] = np.iinfo(np.int64).max
        gap = int(np.argmin(change)) + s
        if n_open[gap]:
            at = stacks[gap].pop()
            n_open[gap] -= 1
        else:
            gap, at, made = capacity, made, made + 1
        bins[k], offsets[k] = at, capacity - gap
        if gap > s:
            stacks[gap - s].append(at)
            n_open[gap - s] += 1
    return bins, offsets


def plan_packing(counts: dict[int, int], capacity: int, unit_pieces: int = UNIT_PIECES) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(ranges, slots) for a histogram of lengths.

    ranges: length, level, first (rank at which the level begins), each (pieces a copy), copies, unit_bins, base.
    slots: level, length, slot, bin, offset within one unit.
    """
    left = {s: n for s, n in sorted(counts.items(), reverse=True) if n}
    first, ranges, slots, base, level = dict.fromkeys(left, 0), [], [], 0, 0
    while left:
        copies = max(1, -(-sum(left.values()) // unit_pieces))
        each = {s: n // copies for s, n in left.items() if n >= copies}
        while not each:
            copies = max(left.values())
            each = {s: n // copies for s, n in left.items() if n >= copies}
        lengths = np.repeat([*each], [*each.values()])
        bins, offsets = pack_unit(lengths, capacity)
        n_bins = int(bins.max()) + 1
        slot = np.concatenate([np.arange(n) for n in each.values()])
        slots.append(pd.DataFrame({"level": level, "length": lengths, "slot": slot, "bin": bins, "offset": offsets}))
        for s, n in each.items():
            ranges.append((s, level, first[s], n, copies, n_bins, base))
            first[s] += n * copies
            left[s] -= n * copies
        left, base, level = {s: n for s, n in left.items() if n}, base + copies * n_bins, level + 1
    names = ["length", "level", "first", "each", "copies", "unit_bins", "base"]
    empty = pd.DataFrame({"level": [], "length": [], "slot": [], "bin": [], "offset": []})
    return pd.DataFrame(ranges, columns=names, dtype="int64"), (pd.concat(slots) if slots else empty).astype("int64")


def rank_in_length(pieces: DataFrame, n_rows: int) -> DataFrame:
    """Adds `rank`: 0, 1, ... among the pieces of the same length, over salted windows."""
    salts = max(8, n_rows // RANK_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["length", "salt"]).withColumn("rank", F.col("ahead") + F.col("within")).drop("salt", "within", "ahead")


def pack(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        pieces = keep(cut_documents(docs, path, capacity, id_col, text_col))
        counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
        ranges, slots = plan_packing(counts, capacity)
        whole = "length long, level long, first long, each long, copies long, unit_bins long, base long"
        ranges = spark.createDataFrame(ranges, whole)
        slots = spark.createDataFrame(slots[["level", "length", "slot", "bin", "offset"]], "level long, length long, slot long, bin long, offset long")
        ranked = rank_in_length(pieces, sum(counts.values()))
        placed = ranked.join(F.broadcast(ranges), "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("each") * F.col("copies")))
        at = F.col("rank") - F.col("first")
        placed = placed.withColumns({"copy": F.floor(at / F.col("each")), "slot": at % F.col("each")})
        found = placed.join(F.broadcast(slots), ["level", "length", "slot"])
        sequence = F.col("base") + F.col("copy") * F.col("unit_bins") + F.col("bin")
        return stored(found.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset"))
