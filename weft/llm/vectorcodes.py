"""Vector code compression: a codebook for each part of the vectors, learned in rounds; nearest entries found through memoised grid cells.

Components become integers, floor(1024 * x), and all that follows is exact integer arithmetic.
A vector is cut into equal parts, each with a codebook of up to `entries` entries.  A round
assigns every part to its nearest entry and replaces each entry by the floor of its parts' mean.

Nearest entry: the space of a part is a grid.  A part's coarse cell is hashed; for a cell met
for the first time its box's least and greatest squared distance to every entry are added up
from tables by dimension and level, and the entries whose least distance does not exceed the
smallest greatest distance (the others are dominated across the box) are kept in a bounded
memo.  Only those are evaluated exactly, ties going to the lower index.  Parts outside the
grid are evaluated against all entries, so the grid's place and width change cost and nothing else.

Tasks send the sums and counts of each entry's parts, at most parts x entries rows each; the
driver holds codebooks alone, whose size does not depend on the data.

Rows whose vector is null or holds null or non-finite components are dropped; so is a vector
shorter than the longest of the table, which lacks components.  Lengths must be a multiple of
the number of parts, and components below 2**17 in size, else a ValueError says so.
Codebooks start from the least distinct ids that are not null, a repeated id counting once with
its least vector; with fewer vectors than entries the codebooks have as many entries.  Repeated
rows are coded each, as are rows with a null id.  An empty table has no rows,
nor has one without any id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import BROADCAST_WIDE, Memo, arrow_map, scratch, small_batches, stored

#: Steps of a component of 1; least size of an integer component that is too large; levels of the grid, over so many standard deviations on either side.
STEPS, TOO_LARGE, LEVELS, REACH = 1024, 1 << 27, 16, 4.0
#: What the greatest distance of a box is raised by, for sums in floats.
SLACK = 1e-4
#: Parts into which the rows of a label are dealt.
SALTS = 16


@dataclass
class Grid:
    """Cells of `width` steps a side, `LEVELS` along each dimension from `low` on."""

    low: int
    width: int


def whole_numbers(rows: DataFrame, vector_col: str) -> DataFrame:
    """`rows` whose vectors are whole, with the column `numbers`: their components as integers."""
    longest = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    fine = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    vector = F.col(vector_col).cast("array<double>")
    kept = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == longest) & F.forall(vector, fine))
    return kept.withColumn("numbers", F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * STEPS, F.lit(2.0**60)), F.lit(-(2.0**60))))))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


class Cells:
    """Nearest entries of one codebook (entries x width, int64)."""

    def __init__(self, book: np.ndarray, grid: Grid) -> None:
        self.book, self.grid = book, grid
        low = (grid.low + np.arange(LEVELS) * grid.width)[None, :, None]
        high, at = low + grid.width - 1, book.T[:, None, :]
        near = np.maximum(np.maximum(low - at, at - high), 0).astype(np.float64) ** 2
        far = np.maximum(np.abs(at - low), np.abs(at - high)).astype(np.float64) ** 2
        self.table = np.concatenate([near, far], axis=2).reshape(-1, 2 * len(book)).astype(np.float32)  # (dimension, level) x (least of entries, greatest)
        self.all = np.arange(len(book), dtype=np.uint16)
        self.memo = Memo(None)

    def _learn(self, cells: np.ndarray, keys: list[bytes]) -> None:
        """Puts the entries that no other dominates across each cell's box into the memo."""
        hot = np.zeros((len(cells), self.table.shape[0]), np.float32)
        hot[np.arange(len(cells))[:, None], np.arange(cells.shape[1]) * LEVELS + cells] = 1
        both = hot @ self.table
        near, far = both[:, : len(self.book)], both[:, len(self.book) :]
        open_ = near <= far.min(axis=1, keepdims=True) * np.float32(1 + SLACK)
        for key, row in zip(keys, open_):
            self.memo.remember(key, np.flatnonzero(row).astype(np.uint16))

    def candidates(self, parts: np.ndarray) -> list[np.ndarray]:
        """Of each part, ascending."""
        levels = (parts - self.grid.low) // self.grid.width
        inside = ((levels >= 0) & (levels < LEVELS)).all(axis=1)
        cells = levels.astype(np.uint8)
        keys = [c.tobytes() if i else None for c, i in zip(cells, inside)]
        known = {None: self.all}
        fresh = {}
        for n, key in enumerate(keys):
            if key not in known:
                found = self.memo.get(key)
                if found is None and (found := self.memo.before.get(key)) is not None:
                    self.memo.remember(key, found)
                if found is None:
                    fresh.setdefault(key, n)
                else:
                    known[key] = found
        if fresh:
            self._learn(cells[[*fresh.values()]], [*fresh])
            known |= {k: v for k in fresh if (v := self.memo.get(k, self.memo.before.get(k))) is not None}
        return [known[k] if k in known else self.all for k in keys]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part, exact."""
        if not len(parts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = self.candidates(parts)
        sizes = np.array([*map(len, found)])
        entry, row = np.concatenate(found), np.repeat(np.arange(len(parts)), sizes)
        apart = parts[row] - self.book[entry]
        distance = np.einsum("ij,ij->i", apart, apart)
        starts = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == least[row])
        best = np.empty(len(parts), np.int64)
        best[row[hit[::-1]]] = entry[hit[::-1]]  # the lowest index is written last
        return best, least


def _books(spark, books: np.ndarray, grid: Grid):
    return spark.sparkContext.broadcast((books, grid))


def _entry_sums(numbers: DataFrame, shared, n_parts: int) -> DataFrame:
    """part, entry, n, sums: of the parts that each task assigns to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, grid = shared.value
        cells = [Cells(b, grid) for b in books]
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in (small for big in batches for small in small_batches(big)):
            parts = matrix(batch.column("numbers")).reshape(batch.num_rows, n_parts, -1)
            for p, own in enumerate(cells):
                best, _ = own.nearest(parts[:, p])
                np.add.at(sums[p], best, parts[:, p])
                counts[p] += np.bincount(best, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        if len(part):
            flat = sums[part, entry]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(entry, pa.int64()), pa.array(counts[part, entry]), lists], ["part", "entry", "n", "sums"])

    return arrow_map(numbers.select("numbers"), run, "part long, entry long, n long, sums array<long>")


def fit(numbers: DataFrame, id_col: str, n_parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[np.ndarray, Grid] | None:
    """Codebooks (parts x entries x width) and the grid, from all rows of `numbers` (id, numbers); None without a row that has an id."""
    total = lambda f: F.sum(F.aggregate("numbers", F.lit(0.0), lambda a, x: a + f(x.cast("double"))))
    size, n, plain, squares, most = numbers.agg(F.max(F.size("numbers")), F.count(F.lit(1)), total(lambda x: x), total(lambda x: x * x), F.max(F.array_max(F.transform("numbers", F.abs)))).first()
    if not n or not size:
        return None
    if size % n_parts or most >= TOO_LARGE:
        raise ValueError(f"vectors of {size} components can't be cut into {n_parts} parts" if size % n_parts else f"components must be less than {TOO_LARGE // STEPS} in size")
    mean = plain / (n * size)
    spread = max(squares / (n * size) - mean * mean, 0.0) ** 0.5
    grid = Grid(int(np.floor(mean - REACH * spread)), int(np.ceil(2 * REACH * spread / LEVELS)) + 1)
    ids = numbers.where(F.col(id_col).isNotNull())
    first = ids.select(id_col).distinct().orderBy(id_col).limit(entries)
    start = ids.join(F.broadcast(first), id_col, "left_semi").groupBy(id_col).agg(F.min("numbers").alias("numbers")).orderBy(id_col).collect()  # `entries` rows at most
    if not start:
        return None
    width = size // n_parts
    books = np.array([r["numbers"] for r in start], np.int64).reshape(len(start), n_parts, width).swapaxes(0, 1).copy()
    for _ in range(rounds):
        sums = _entry_sums(numbers, _books(numbers.sparkSession, books, grid), n_parts).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
        for r in sums.collect():  # parts x entries rows at most
            books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books, grid


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assign(numbers: DataFrame, books: np.ndarray, grid: Grid, keep: list[str]) -> DataFrame:
    """The columns `keep`, codes (array of an index for each part) and error (squared distances in all)."""
    shared, n_parts = _books(numbers.sparkSession, books, grid), len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_books, own_grid = shared.value
        cells = [Cells(b, own_grid) for b in own_books]
        for batch in (small for big in batches for small in small_batches(big)):
            parts = matrix(batch.column("numbers")).reshape(batch.num_rows, n_parts, -1)
            found = [own.nearest(parts[:, p]) for p, own in enumerate(cells)]
            codes, error = np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * n_parts, pa.int32()), pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(error, pa.int64())], [*keep, "codes", "error"])

    schema = ", ".join(f"`{c}` {numbers.schema[c].dataType.simpleString()}" for c in keep)
    return arrow_map(numbers.select(*keep, "numbers"), run, f"{schema}, codes array<int>, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """`codes` with the column `vector`: the entries that its codes name, as components."""
    tables = [F.array(*[F.array(*[F.lit(float(x) / STEPS) for x in entry]) for entry in book.tolist()]) for book in books]
    return codes.withColumn("vector", F.concat(*[F.element_at(t, F.col("codes")[p] + 1) for p, t in enumerate(tables)]))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """id, label, codes, error, label_error (of all rows with an equal label, nulls together), codebooks_sha256: one row for each whole vector."""
    with scratch(rows.sparkSession) as keep:
        named = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
        numbers = keep(whole_numbers(named, "vector").select("id", "label", "numbers"))
        fitted = fit(numbers, "id", n_parts, entries, rounds)
        if fitted is None:
            out = numbers.limit(0).select("id", "label", F.array(F.lit(0)).alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        else:
            coded = keep(assign(numbers, *fitted, ["id", "label"]))
            sums = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same"))
            if sums.count() <= BROADCAST_WIDE:
                joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("same")))
            else:  # rows of a label are dealt out
                dealt = coded.withColumn("salt", F.pmod(F.xxhash64("id", "codes"), F.lit(SALTS)))
                sums = sums.withColumn("salted", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                joined = dealt.join(sums, F.col("label").eqNullSafe(F.col("same")) & (F.col("salt") == F.col("salted")))
            out = joined.select("id", "label", "codes", "error", "label_error", F.lit(books_sha256(fitted[0])).alias("codebooks_sha256"))
        return stored(out.withColumnsRenamed({"id": id_col, "label": label_col}))
