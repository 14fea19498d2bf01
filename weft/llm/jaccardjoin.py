"""N-gram Jaccard join: groups of similar documents, a token-group matrix, and a bound that opens few groups.

1. Every text becomes its set of word shingles (64-bit hashes); texts with equal sets are one
   node.  Nodes whose sets have the same least hash are a group, cut into blocks of about
   `BLOCK_SHINGLES` shingles: documents that are alike in the share s are together with probability s.
2. Shingles have one order: those that are seldom come first, by hash, the frequent ones last, by
   estimated count.  Of two sets that are linked the larger one shares one of its first
   n - ceil(t n) + 1 shingles with the first n - ceil(2 t n / (1 + t)) + 1 of the smaller one,
   whatever the order is; so the estimate decides about cost only.
3. Token-group matrix: for each of these shingles the groups that have it, with how many members
   and of what sizes.  A node asks the groups that have one of its first shingles early enough, with
   members of fitting size other than itself.
4. A group holds the union of its members' shingles.  If fewer than t n of a node's shingles are in
   it, no member can be linked and the group stays closed.  An opened group counts the node's shingles
   in all members through lists of members by shingle, and so confirms links on full sets.
5. Groups return the number of links of each node, weighted by copies, and as many links as join
   what is joined, never all pairs.  Classes are the connected components.

The join is exact: no cap on groups, candidates or partners.  Its work within a family of
different texts that are all linked grows with the number of their links, in blocks.  A group's
nodes that ask are dealt to as many tasks as they need; a task holds one group and streams
what asks it.

Null or wordless texts have an empty set and are linked with nothing.  Rows with a null id keep a
null id; a class's id is its least non-null id.  Repeated rows are documents each, linked with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import BROADCAST_ROWS, arrow_map, byte_texts, scratch, small_batches, small_enough, stored
from weft.llm.neardup import SALTS, connected_components, linked, shingles

#: Shingles of a block of a group, about, and nodes that ask one block in one task.
BLOCK_SHINGLES, ASKING = 200_000, 2_048
#: More than any text has shingles; a set's size and a place in it are sent as one number.
PLACES = 1 << 31
#: Estimated count from which a shingle is put among the frequent ones, and shingles of a task that are counted together.
FREQUENT, COUNTED = 4, 2_000_000


def probe_length(n, percent: int):
    """How many first shingles of a set find all smaller sets that it is linked with; for numbers and arrays."""
    return n + (-percent * n) // 100 + 1


def index_length(n, percent: int):
    """How many first shingles of a set suffice to be found by larger sets."""
    return n + (-2 * percent * n) // (100 + percent) + 1


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind))


def signed_sets(docs: DataFrame, width: int) -> DataFrame:
    """row_id, doc_id, set_key, n, least: one row for each of `docs` (row_id, doc_id, text), and rows without `n` that have `often` and `times`.

    These are the shingles that several different sets of one task have, for every COUNTED shingles of its sets, and in how many.
    """

    def counts(sets: dict[bytes, np.ndarray], doc_type: pa.DataType) -> pa.RecordBatch:
        token, times = np.unique(np.concatenate([*sets.values()]), return_counts=True)
        several = times > 1
        empty = [pa.nulls(1, kind) for kind in (pa.int64(), doc_type, pa.binary(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*empty, _lists([token[several]], pa.int64()), _lists([times[several]], pa.int64())], names)

    names = ["row_id", "doc_id", "set_key", "n", "least", "often", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        size, doc_type = 0, pa.null()
        for batch in (small for big in batches for small in small_batches(big, text_col="text")):
            sets, doc_type = shingles([*byte_texts(batch.column("text"))], width), batch.column("doc_id").type
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            least = pa.array([int(s[:1].view(np.int64)[0]) if len(s) else None for s in sets], pa.int64())
            none = pa.nulls(len(sets), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), least, none, none], names)
            for key, own in zip(keys, sets):
                if key is not None and key not in held:
                    held[key] = own
                    size += len(own)
            if size > COUNTED:
                yield counts(held, doc_type)
                held, size = {}, 0
        if held:
            yield counts(held, doc_type)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("row_id", "doc_id", "text"), run, f"row_id long, doc_id {kind}, set_key binary, n long, least long, often array<long>, times array<long>")


def frequent_shingles(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, estimated counts) by shingle: those of FREQUENT or more, the BROADCAST_ROWS most frequent at most.  They set the order of shingles alone."""
    pairs = signed.where(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "times")).alias("p")).groupBy(F.col("p.often").alias("token")).agg(F.sum("p.times").alias("n"))
    found = pairs.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(BROADCAST_ROWS).toPandas()
    token, n = found["token"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def first_shingles(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first shingles of a set (sorted hashes), in the one order."""
    token, n = frequent
    most = probe_length(len(found), percent)
    if len(token):
        at = np.minimum(np.searchsorted(token, found), len(token) - 1)
        found = found[np.argsort(np.where(token[at] == found, n[at], 0), kind="stable")]
    return found[:most]


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], width: int, percent: int) -> DataFrame:
    """set_key, first: the first shingles of every text that has a word."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for big in batches for small in small_batches(big, text_col="text")):
            sets = {xxhash.xxh3_128_digest(s.tobytes()): s for s in shingles([*byte_texts(batch.column("text"))], width) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array([*sets], pa.binary()), _lists([first_shingles(s, shared.value, percent) for s in sets.values()], pa.int64())], ["set_key", "first"])

    return arrow_map(docs.select("text"), run, "set_key binary, first array<long>")


def wanted_sets(texts: DataFrame, width: int) -> DataFrame:
    """node, copies, n, members: the full sets of those of `texts` (text, set_key, node, copies) whose set is the node's; a row may share its row_id with another node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for big in batches for small in small_batches(big, text_col="text")):
            sets, keys = shingles([*byte_texts(batch.column("text"))], width), batch.column("set_key").to_pylist()
            own = [i for i, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == keys[i]]
            sizes = pa.array([len(sets[i]) for i in own], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own, pa.int64())) for c in ("node", "copies")), sizes, _lists([sets[i] for i in own], pa.int64())], ["node", "copies", "n", "members"])

    return arrow_map(texts.select("text", "set_key", "node", "copies"), run, "node long, copies long, n long, members array<long>")


class Group:
    """A block of a group: its members' sizes, copies and numbers, and the members that have each shingle of the union."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, copies: np.ndarray, shingles: np.ndarray, percent: int) -> None:
        self.nodes, self.sizes, self.copies, self.percent = nodes, sizes, copies, percent
        order = np.argsort(shingles, kind="stable")
        self.holder = np.repeat(np.arange(len(nodes)), sizes)[order]
        self.union, self.start = np.unique(shingles[order], return_index=True)
        self.stop = np.append(self.start[1:], len(order))
        self.links, self.classes = np.zeros(len(nodes), np.int64), np.arange(len(nodes))

    def ask(self, node: int, size: int, copies: int, own: np.ndarray) -> tuple[int, list[int]]:
        """(links of the node with smaller members, or earlier ones of its size; members that join their classes to it)."""
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        at = at[self.union[at] == own]
        if 100 * len(at) < self.percent * size:
            return 0, []
        runs = self.stop[at] - self.start[at]
        inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(self.start[at], runs)
        shared = np.bincount(self.holder[inside], minlength=len(self.nodes))
        before = (self.sizes < size) | ((self.sizes == size) & (self.nodes < node))
        hit = np.flatnonzero(before & linked(self.sizes, size, shared, self.percent))
        self.links[hit] += copies
        kinds, first = np.unique(self.classes[hit], return_index=True)
        if len(kinds) > 1:
            self.classes[np.isin(self.classes, kinds)] = kinds[0]
        return int(self.copies[hit].sum()), self.nodes[hit[first]].tolist()


def _answers(dealt: DataFrame, percent: int) -> DataFrame:
    """node, links, other: from rows (gid, part, asks, node, n, copies, members) that are together by gid and part, members before what asks them.

    Rows that repeat one are next to it and left out.  `links` are to be added up by node; `other` is a node that `node` is linked with, or null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        group: Group | None = None
        last = before = None
        out: list[tuple[int, int, int | None]] = []

        def closed() -> None:
            if group is not None:
                out.extend((int(n), int(x), None) for n, x in zip(group.nodes, group.links) if x)

        for batch in (small for big in batches for small in small_batches(big)):
            columns = [batch.column(c).to_pylist() for c in ("gid", "part", "asks", "node", "n", "copies")]
            lists = batch.column("members")
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (gid, part, asks, node, n, copies) in enumerate(zip(*columns)):
                own, now = values[at[i] : at[i + 1]], (gid, part, asks, node)
                if now == before:
                    continue
                before = now
                if (gid, part) != last:
                    closed()
                    last, group, held = (gid, part), None, []
                if not asks:
                    held.append((node, n, copies, own.copy()))
                    continue
                if group is None:
                    nodes, sizes, weights, sets = zip(*held)
                    group, held = Group(np.array(nodes, np.int64), np.array(sizes, np.int64), np.array(weights, np.int64), np.concatenate(sets), percent), []
                links, joined = group.ask(node, n, copies, own)
                if links:
                    out.append((node, links, None))
                    out.extend((node, 0, other) for other in joined)
            if len(out) > 10_000:
                yield answers(out)
                out = []
        closed()
        yield answers(out)

    def answers(rows: list[tuple[int, int, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["node", "links", "other"])

    return arrow_map(dealt, run, "node long, links long, other long")


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id of the class), n_links (other documents it is linked with) for every row of `docs`.

    Texts are linked if their shingle sets' similarity is `percent` / 100 or more.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source = source.withColumn("row_id", F.xxhash64("doc_id", F.length("text")))  # finds texts again; that others may share it costs time only
    with scratch(docs.sparkSession) as keep:
        signed = keep(signed_sets(source, width))
        nodes = signed.where("set_key is not null").groupBy("set_key").agg(F.min("row_id").alias("row_id"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("least").alias("least"), F.count(F.lit(1)).alias("copies"))
        nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()))
        sizes = nodes.groupBy("least").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks")).where("blocks > 1")
        block = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))
        placed = keep(nodes.join(small_enough(keep(sizes)), "least", "left").select("node", "set_key", "row_id", "n", "copies", F.xxhash64("least", block).alias("gid")))

        # One shuffle by set brings a text's first shingles together with its node, one by shingle finds those that several nodes have.
        both = prefixes(source, frequent_shingles(signed), width, percent).select("set_key", "first", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("n"))
        both = both.union(placed.select("set_key", F.lit(None).cast("array<long>"), "node", "n")).groupBy("set_key").agg(F.first("first", ignorenulls=True).alias("first"), F.max("node").alias("node"), F.max("n").alias("n"))
        rows = both.select("node", "n", F.posexplode("first").alias("pos", "token")).select("token", "node", (F.col("n") * PLACES + F.col("pos")).alias("np"))
        rows = keep(rows.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("times > 1").drop("times"))
        rows = rows.select("token", "node", F.floor(F.col("np") / PLACES).alias("n"), (F.col("np") % PLACES).alias("pos")).join(small_enough(placed.select("node", "gid"), wide=False), "node")
        rows = rows.withColumn("indexed", F.col("pos") < F.expr(f"n + floor(-{2 * percent} * n / {100 + percent}) + 1"))
        # The first shingle that two sets share leaves at most n - pos to be shared; `reach` is the largest set that a member can then be linked with.
        reach = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")
        matrix = rows.where("indexed").groupBy("token", "gid").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("from"), F.max("n").alias("to"), F.max(reach).alias("reach")).withColumnRenamed("gid", "asked")
        others = (F.col("asked") != F.col("gid")) | (F.col("times") > F.col("indexed").cast("int"))
        sized = (F.col("from") <= F.col("n")) & (F.col("to") * 100 >= F.col("n") * percent) & (F.col("reach") >= F.col("n"))
        placed_early = (F.col("n") - F.col("pos")) * (100 + percent) >= percent * (F.col("n") + F.greatest(F.col("from"), F.ceil(F.col("n") * percent / 100)))
        asking = keep(rows.join(matrix, "token").where(others & sized & placed_early).select("node", F.col("asked").alias("gid")).distinct())

        asked = keep(asking.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("parts")))
        base = keep(placed.join(small_enough(asked), "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), "node"))
        probes = asking.join(small_enough(asked), "gid").select("gid", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"), "node")
        dealt = keep(base.union(probes))
        wanted = keep(placed.join(small_enough(keep(dealt.select("node").distinct()), wide=False), "node", "left_semi").select("row_id", "set_key", "node", "copies"))
        sets = wanted_sets(source.join(small_enough(wanted, wide=False), "row_id"), width)
        met = sets.join(small_enough(dealt, wide=False), "node").repartition("gid", "part").sortWithinPartitions("gid", "part", "asks", "node").select("gid", "part", "asks", "node", "n", "copies", "members")
        answers = keep(_answers(met, percent))

        classes = connected_components(answers.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        classed = classes.join(nodes.select("node", "least_id"), "node")
        joined = keep(classed.groupBy("component").agg(F.min("least_id").alias("component_id")))
        named = classed.join(small_enough(joined), "component").select("node", "component_id")
        links = answers.groupBy("node").agg(F.sum("links").alias("links"))
        out = nodes.join(links, "node", "left").join(named, "node", "left")
        out = keep(out.select("set_key", F.coalesce("component_id", "least_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        worded = signed.where("set_key is not null").withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_id"), F.lit(SALTS)))
        out = worded.join(out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["set_key", "salt"]).select("doc_id", "n", "component_id", "n_links")
        out = out.union(signed.where("set_key is null and n is not null").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
        return stored(out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links"))
