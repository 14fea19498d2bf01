"""Near-duplicates: one-permutation MinHash, densified, banded, with star-shaped candidate edges.

1. Every text becomes its set of word shingles (64-bit hashes).  Texts with equal
   sets are one node, `set_key` (128 bits), so exact copies cost one row.
2. One permutation: a set's least hash in each of `BINS` equal ranges; empty bins
   borrow from a bin found by their own fixed probe order (optimal densification).
   `ROWS` bins make a band; a pair of similarity 0.75 misses all bands with a
   probability of 2e-6, others with less.
3. Stars: within a bucket only (centre, member) is a candidate, the centre being the
   bucket's least key.  Each member's most frequent centre is confirmed on full sets.
4. Whole result: members that share a bucket but are not yet joined are compared,
   all of them, block by block on full sets (`_links_in_block`), which returns links
   and never lists pairs.  A bucket's largest class meets its other members only.
5. Classes are connected components over nodes (alternating large and small stars).

No cap on buckets, partners or candidates.  Blocks are bounded by members and by shingles,
and what joins by the key of a group is stored and broadcast if it is small, or salted, so
that no group of copies is one task.

Null or wordless texts have an empty set and are linked with nothing.  Rows with a null
id keep a null id; a class's id is its least non-null id.  Repeated rows are members like
any other: each is `kept` if its id is the class's.  `keep_one` goes by rows instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import any_names, arrow_map, byte_texts, free_name, scratch, small_batches, small_enough, stored
from weft.llm.words import Words, mixed

BINS, ROWS = 240, 5
BANDS = BINS // ROWS
#: Members of a class, or members that meet it, in one block, and their shingles in all, about.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Parts into which the rows of a hub are dealt.
SALTS = 16

_RNG = np.random.default_rng(20240229)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BAND_MIX = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_PROBE = np.stack([_RNG.permutation(BINS) for _ in range(BINS)])
_EDGES = np.array([(i << 64) // BINS for i in range(BINS)], dtype=np.uint64)


def shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a shorter text is one shingle, a wordless one none."""
    words = Words(texts)
    h, ends = words.hashes(lower=True), np.cumsum(words.n_words)
    n = len(h) - width + 1
    rolling = mixed(sum((h[j : n + j] * _PLACE[j] for j in range(1, width)), h[:n] * _PLACE[0])) if n > 0 else h[:0]
    found = []
    for end, size in zip(ends.tolist(), words.n_words.tolist()):
        own = rolling[end - size : end - width + 1]
        if 0 < size < width:
            own = mixed(np.array([(h[end - size : end] * _PLACE[:size]).sum() + np.uint64(size)], np.uint64))
        found.append(np.unique(own) if size else h[:0])
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    """The bucket of a set in each band."""
    first = np.searchsorted(found, _EDGES)
    full = first < np.append(first[1:], len(found))
    least = found[np.minimum(first, len(found) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        donors = _PROBE[empty]
        least[empty] = least[donors[np.arange(len(empty)), full[donors].argmax(axis=1)]]
    return mixed((least.reshape(BANDS, ROWS) * _BAND_MIX).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """row_id, doc_id, set_key, n_shingles, bands: one row for each of `docs` (row_id, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for big in batches for small in small_batches(big, text_col="text")):
            keys, sizes, bands = [], [], []
            for found in shingles([*byte_texts(batch.column("text"))], width):
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sizes.append(len(found))
                bands.append(band_keys(found).view(np.int64) if len(found) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64)))],
                ["row_id", "doc_id", "set_key", "n_shingles", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("row_id", "doc_id", "text"), run, f"row_id long, doc_id {kind}, set_key binary, n_shingles long, bands array<long>")


def full_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """set_key, n, members: the sorted shingle hashes of each text of `texts` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for big in batches for small in small_batches(big, text_col="text")):
            sets = shingles([*byte_texts(batch.column("text"))], width)
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["set_key", "n", "members"],
            )

    return arrow_map(texts.select("text"), run, "set_key binary, n long, members array<long>")


def linked(n_a, n_b, shared, percent: int):
    """Whether sets of these sizes and intersection are linked; for columns and for arrays alike."""
    return shared * 100 >= (n_a + n_b - shared) * percent


def _salted_join(rows: DataFrame, few: DataFrame, on: str, by: str) -> DataFrame:
    """`rows` joined with the one row of `few` for their key `on`; the rows of a key are dealt by the column `by`."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [on, "salt"]).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for undirected `edges` (a, b); nodes without an edge are not listed.

    Alternates large and small stars until the edges no longer change.  Every step is
    a grouped minimum, combined before it is shuffled, and a salted join on the node.
    """
    with scratch(edges.sparkSession) as keep:
        now, before = keep(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()), None
        while (mark := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()) != before:
            before = mark
            both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = _salted_join(both.where("v > u"), least, "u", "v").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
            least = large.groupBy("hi").agg(F.min("lo").alias("m"))
            small = _salted_join(large, least, "hi", "lo").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            now = keep(small.select("e.*").where("hi <> lo").distinct())
        return stored(now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct()))


def _links_in_block(frame: pd.DataFrame, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between the probing rows of a block and its other rows: as many as join everything that links in it, no more."""
    codes, at = np.unique(np.concatenate([*frame["members"]]), return_inverse=True)
    starts = np.cumsum([0, *frame["n"].iloc[:-1]])
    sizes, classes, keys = frame["n"].to_numpy(), pd.factorize(frame["class"])[0], frame["set_key"].to_list()
    ends, links, flags = [*starts[1:], len(at)], [], np.zeros(len(codes), np.int32)
    base = np.flatnonzero(frame["base"].to_numpy())
    for p in np.flatnonzero(frame["probe"].to_numpy()):
        own = at[starts[p] : ends[p]]
        flags[own] = 1
        shared = np.add.reduceat(flags[at], starts)[base]
        flags[own] = 0
        hit = base[linked(sizes[base], sizes[p], shared, percent) & (classes[base] != classes[p])]
        while len(hit):
            links.append((keys[p], keys[hit[0]]))
            classes[classes == classes[hit[0]]] = classes[p]
            hit = hit[classes[hit] != classes[p]]
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id of the class), kept for every row of `docs`.

    Texts are linked if their shingle sets' similarity is `percent` / 100 or more.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source = source.withColumn("row_id", F.xxhash64("doc_id", F.length("text")))  # finds texts again; that others may share it costs time only
    with scratch(docs.sparkSession) as keep:
        signed = keep(signatures(source, width))
        nodes = keep(signed.where("set_key is not null").groupBy("set_key").agg(F.min("row_id").alias("row_id"), F.min("n_shingles").alias("n"), F.min("bands").alias("bands"), F.min("doc_id").alias("least")))
        rows = nodes.select("set_key", F.explode("bands").alias("bucket"))
        buckets = rows.groupBy("bucket").agg(F.min("set_key").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
        members = keep(rows.join(buckets, "bucket").select("bucket", "set_key", "centre"))
        wanted = keep(members.select("set_key").distinct().join(nodes.select("set_key", "row_id"), "set_key"))
        texts = source.join(small_enough(wanted.select("row_id"), wide=False), "row_id", "left_semi")
        sets = keep(full_sets(texts, width).join(wanted.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"]))

        stars = members.where("set_key <> centre").groupBy("set_key", "centre").count()
        stars = stars.groupBy("set_key").agg(F.max_by("centre", F.struct("count", "centre")).alias("centre"))
        a = sets.select("set_key", F.col("n").alias("n_a"), F.col("members").alias("s_a"))
        b = sets.select(F.col("set_key").alias("centre"), F.col("n").alias("n_b"), F.col("members").alias("s_b"))
        shared = F.size(F.array_intersect("s_a", "s_b"))
        sure = keep(stars.join(a, "set_key").join(b, "centre").where(linked(F.col("n_a"), F.col("n_b"), shared, percent)).select(F.col("set_key").alias("a"), F.col("centre").alias("b")))

        links = keep(sure.union(_links_of_rest(members, sets, connected_components(sure), percent, keep)))
        classed = connected_components(links).withColumnRenamed("node", "set_key").join(nodes.select("set_key", "least"), "set_key")
        joined = keep(classed.groupBy("component").agg(F.min("least").alias("component_id")))
        named = classed.join(small_enough(joined), "component").select("set_key", "component_id")  # nodes in a class with others
        named = keep(nodes.select("set_key", "least").join(named, "set_key", "left").select("set_key", F.coalesce("component_id", "least").alias("component_id")))
        out = signed.select("doc_id", "set_key", "n_shingles").join(small_enough(named), "set_key", "left")
        out = out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
        return stored(out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", kept.alias("kept")))


@any_names
def keep_one(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row of `docs` (doc_id, text and others) for each class of near-duplicates, with all its columns: one of the least id, never a null one if there is another.

    Goes by rows: of rows that repeat an id and differ in text each stays unless it has a near-duplicate, and of equal rows one stays.  Texts without words all stay.
    Rows are numbered in a stored copy; the numbers of those that go are broadcast if they are few, and joined otherwise.  Both tables belong to the caller's `scratch` block.
    """
    key = free_name(docs, "row_number")
    with scratch(docs.sparkSession):
        numbered = stored(docs.withColumn(key, F.monotonically_increasing_id()))
        rows = numbered.select(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(key).alias("c")).alias("doc_id"), "text")
        gone = stored(near_duplicates(rows, width, percent).where("not kept").select(F.col("doc_id")["c"].alias(key)))
    return numbered.join(small_enough(gone, wide=False), key, "left_anti").drop(key)


def _links_of_rest(members: DataFrame, sets: DataFrame, classes: DataFrame, percent: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between members that share a bucket but no class yet."""
    classes = classes.withColumnRenamed("node", "set_key")
    classed = keep(members.join(classes, "set_key", "left").select("bucket", "set_key", F.coalesce("component", "set_key").alias("class")))
    sizes = classed.groupBy("bucket", "class").count()
    largest = sizes.groupBy("bucket").agg(F.max_by("class", F.struct("count", "class")).alias("home"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "home")
    probes = keep(classed.join(largest, "bucket").where(F.col("class") != F.col("home")).select("home", "set_key", "class").distinct())
    # A class that is home to probes comes whole, and its probes also meet each other.
    homes = keep(probes.select("home").distinct())
    own = classed.select("set_key", "class").distinct().join(small_enough(homes), F.col("class") == F.col("home")).select("home", "set_key", "class")
    base = keep(own.withColumn("probe", F.lit(False)).union(probes.withColumn("probe", F.lit(True))).join(sets.select("set_key", "n"), "set_key"))
    parts = lambda some: F.greatest(F.ceil(F.sum(some.cast("int")) / BLOCK), F.ceil(F.sum(F.when(some, F.col("n"))) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    blocks = keep(base.groupBy("home").agg(parts(F.lit(True)).alias("n_base"), parts(F.col("probe")).alias("n_probe")))
    base = base.drop("n").join(small_enough(blocks), "home")
    by = lambda n: F.pmod(F.xxhash64("set_key"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    row = ["home", "set_key", "class", "i", "j"]
    as_base = base.withColumn("i", by("n_base")).withColumn("j", span("n_probe")).select(*row, F.lit(True).alias("base"), F.lit(False).alias("probe"))
    as_probe = base.where("probe").withColumn("j", by("n_probe")).withColumn("i", span("n_base")).select(*row, F.lit(False).alias("base"), F.lit(True).alias("probe"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, ["home", "i", "j"]):
            yield pd.DataFrame(_links_in_block(frame, percent), columns=["a", "b"])

    dealt = as_base.union(as_probe).join(sets, "set_key").repartition("home", "i", "j").sortWithinPartitions("home", "i", "j")
    return dealt.mapInPandas(run, "a binary, b binary")


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of a sorted stream, each whole; what is held is one block and one batch."""
    held: list[pd.DataFrame] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key = list(zip(*(batch[c] for c in by)))
        cuts = [i for i in range(len(key)) if (key[i - 1] if i else last) != key[i]]
        if 0 not in cuts:
            cuts = [0, *cuts]
        for at, to in zip(cuts, [*cuts[1:], len(key)]):
            if held and key[at] != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[at:to])
            last = key[at]
    if held:
        yield pd.concat(held, ignore_index=True)
