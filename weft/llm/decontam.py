"""Benchmark decontamination: rare words as seeds, an upper bound, then Smith-Waterman alignment.

An alignment that scores `MIN_SCORE` of an item's own score or more matches at least half of the item's
words, in a stretch of at most twice its length.  So of any n // 2 + r of an item's n words it
matches r or more.  An item's seeds are its n // 2 + n // 4 rarest words among the
benchmark's; they join the words of a document to the items, and a document is a candidate where a window
of 2 n words holds r = n // 4 seeds of the item.  No alignment that scores enough is lost, however the
item was edited, and what many items share (the stem of a question) costs nothing, as it is not rare.
Runs of a document with very many seeds are met piece by piece, so that memory is bounded.
A second bound (`can_reach`, over all words of the item) leaves few stretches to align.  A document with a
score of `MIN_SCORE` or more holds the item, whole, edited or paraphrased.

An item of fewer than `SHORT` words is a candidate only where `SEED_WORDS` of its words follow each other in
the document: half of so few words are in many texts by chance.

The test items are the small side: they are broadcast in blocks of about `BLOCK_WORDS`
words, each block a pass of its own, so that a large benchmark costs passes and not
memory.  Documents are never shuffled, and whole texts are read.

Test items are the distinct (item_id, text) rows, ids of any type: a repeated row is one
item, texts that share an id are each searched and reported under it, and so are items
with a null id.  Items without words are in no document.  An item shorter than a seed is
found where all its words stand in a row, with score 1; as one or two words are no sign
of a leak, `keep_clean` leaves such items out unless `min_words` says otherwise.

Null and empty texts hold nothing.  Repeated rows are judged each; a document may hold
several items; a row's other columns pass through `scan`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructType

from weft.llm.common import any_names, arrow_map, byte_texts, free_name, small_batches

SEED_WORDS, SHORT, MIN_SCORE, BLOCK_WORDS = 3, 12, 0.5, 500_000
#: Pairs of a word and an item that has it as a seed, and words of stretches that are aligned, held at once.
HITS, ALIGNED_CELLS = 2_000_000, 100_000
MATCH, MISMATCH, GAP = 2, -1, -1


def leaks_type(item_id: DataType) -> ArrayType:
    return ArrayType(StructType().add("item_id", item_id).add("score", DoubleType()).add("first_word", IntegerType()).add("end_word", IntegerType()))


def index_words(texts: Iterable[bytes]) -> dict[bytes, int]:
    """A number from 1 for each word of the test items; any other word is 0."""
    index: dict[bytes, int] = {}
    for text in texts:
        for word in text.lower().split():
            index.setdefault(word, len(index) + 1)
    return index


def word_codes(text: bytes, index: dict[bytes, int]) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(index.get, words, repeat(0)), np.int64, len(words))


def seeds_of(codes: np.ndarray, n_words: int, width: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the n-grams made of known words alone; a key is the words' numbers as digits."""
    n = len(codes) - width + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    known = codes > 0
    at = np.flatnonzero(np.logical_and.reduce([known[j : n + j] for j in range(width)]))
    key = codes[at]
    for j in range(1, width):
        key = key * (n_words + 1) + codes[at + j]
    return at, key


class Seeds:
    """The n-grams of `width` words of a block of items, sorted, with the items that have them and each item's distinct words."""

    def __init__(self, index: dict[bytes, int], items: dict[int, np.ndarray], width: int = SEED_WORDS) -> None:
        self.index, self.items, self.width = index, items, width
        self.words = {i: np.unique(c) for i, c in items.items()}
        keys = [np.unique(seeds_of(c, len(index), width)[1]) for c in items.values()]
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        item = np.repeat(np.array([*items], np.int64), [len(k) for k in keys])
        order = np.lexsort((item, key))
        self.key, self.item = key[order], item[order]
        self.distinct = np.unique(self.key)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, keys) of seeds among the words `codes`."""
        at, key = seeds_of(codes, len(self.index), self.width)
        if not len(self.distinct) or not len(at):
            return at[:0], key[:0]
        own = self.distinct[np.minimum(np.searchsorted(self.distinct, key), len(self.distinct) - 1)] == key
        return at[own], key[own]

    def items_of(self, key: int) -> list[int]:
        a, b = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        return self.item[a:b].tolist()


class RareSeeds:
    """The rarest words of each of a block's longer items, as lists of items by word, and how many of them a window must hold."""

    def __init__(self, index: dict[bytes, int], items: dict[int, np.ndarray]) -> None:
        self.index, self.items = index, items
        self.words = {i: np.unique(c) for i, c in items.items()}
        held = np.bincount(np.concatenate([*self.words.values()])) if items else np.zeros(1, np.int64)
        self.wanted, self.reach = (np.zeros(max(items, default=-1) + 1, np.int64) for _ in range(2))
        word, item = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, codes in items.items():
            n = len(codes)
            rare = np.unique(codes[np.lexsort((codes, held[codes]))][: n // 2 + n // 4])
            word.append(rare)
            item.append(np.full(len(rare), i))
            self.wanted[i], self.reach[i] = n // 4, 2 * n
        word, item = np.concatenate(word), np.concatenate(item)
        order = np.argsort(word, kind="stable")
        self.item = item[order]
        self.start = np.searchsorted(word[order], np.arange(len(index) + 2))
        self.gap = int(self.reach.max(initial=0)) + 1

    def windows(self, codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items, first and last place) of every window that holds enough seeds of an item; `codes` are words at the ascending places `place`."""
        n = self.start[codes + 1] - self.start[codes]
        some = np.flatnonzero(n)
        codes, place, n = codes[some], place[some], n[some]
        upto, at, found = np.cumsum(n), 0, []
        while at < len(codes):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HITS, side="right")))
            begin = int(np.searchsorted(place, place[at] - self.gap))  # windows may reach back
            own = n[begin:stop]
            inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(self.start[codes[begin:stop]], own)
            item, where = self.item[inside], np.repeat(place[begin:stop], own)
            order = np.argsort(item, kind="stable")
            item, where = item[order], where[order]
            last = np.arange(len(item)) + self.wanted[item] - 1
            fits = np.flatnonzero(last < len(item))
            fits = fits[(item[last[fits]] == item[fits]) & (where[last[fits]] - where[fits] < self.reach[item[fits]])]
            found.append((item[fits], where[fits], where[last[fits]]))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (codes[:0], place[:0], place[:0])


def seeds_of_block(texts: list[bytes]) -> tuple[list[Seeds], RareSeeds]:
    """Of a block of items, numbered in order: the whole items of one word, of two, ..., the seeds of other short ones; and the seeds of the longer ones."""
    index = index_words(texts)
    codes = {n: c for n, t in enumerate(texts) if len(c := word_codes(t, index))}
    short = {n: c for n, c in codes.items() if len(c) < SHORT}
    return [Seeds(index, {n: c for n, c in short.items() if min(len(c), SEED_WORDS) == width}, width) for width in range(1, SEED_WORDS + 1)], RareSeeds(index, {n: c for n, c in codes.items() if len(c) >= SHORT})


def align_many(items: list[np.ndarray], stretches: list[np.ndarray]) -> list[tuple[float, int, int]]:
    """Best local alignment of each item's words in its stretch: share of the item's own score, first and last + 1 word of the stretch.

    Pairs are worked on together, filled up with words that match nothing, which never lift a best score.
    """
    n, width = max(map(len, items)), max(map(len, stretches))
    item, stretch = np.full((len(items), n), -1, np.int64), np.full((len(items), width), -2, np.int64)
    for k, (a, b) in enumerate(zip(items, stretches)):
        item[k, : len(a)], stretch[k, : len(b)] = a, b
    places, rows, none = np.arange(width + 1), np.arange(len(items)), np.zeros((len(items), 1), np.int64)
    steps = -GAP * places
    above, start_above = np.zeros((len(items), width + 1), np.int64), np.tile(places, (len(items), 1))
    best = np.zeros((3, len(items)), np.int64)
    for k in range(n):
        diagonal = above[:, :-1] + np.where(stretch == item[:, k : k + 1], MATCH, MISMATCH)
        down = above[:, 1:] + GAP
        own = np.maximum(diagonal, down)
        start = np.where(diagonal >= down, start_above[:, :-1], start_above[:, 1:])
        fresh = own <= 0
        own = np.concatenate([none, np.where(fresh, 0, own)], axis=1)
        start = np.concatenate([none, np.where(fresh, places[1:], start)], axis=1)
        lifted = own + steps
        top = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted >= top, places, 0), axis=1)
        above = np.maximum(top - steps, 0)
        start_above = np.where(above > 0, np.take_along_axis(start, source, axis=1), places)
        end = above.argmax(axis=1)
        value = above[rows, end]
        better = value > best[0]
        best[:, better] = np.stack([value, start_above[rows, end], end])[:, better]
    return [(float(v) / (MATCH * len(i)), int(a), int(b)) for i, v, a, b in zip(items, *best)]


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[float, int, int]:
    """`align_many` of one pair."""
    return align_many([item], [stretch])[0]


def can_reach(words: np.ndarray, stretch: np.ndarray, least: float) -> bool:
    """Whether a local alignment with an item of these distinct words may score `least`; never wrongly False.

    A word of the aligned part scores MATCH at most if the item has it, and costs a mismatch or a gap if not.
    """
    own = words[np.minimum(np.searchsorted(words, stretch), len(words) - 1)] == stretch
    sums = np.cumsum(np.concatenate(([0], np.where(own, MATCH, max(MISMATCH, GAP)))))
    return bool((sums - np.minimum.accumulate(sums)).max() >= least)


def _stretches(codes: np.ndarray, item: np.ndarray, words: np.ndarray, spans: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, int]]:
    """The stretches of `reach` words around spans of places (ascending) in which an item may score enough."""
    k = 0
    while k < len(spans):
        first, last = spans[k]
        while k < len(spans) and spans[k][0] <= last + reach:
            last, k = max(last, spans[k][1]), k + 1
        lo, hi = max(0, first - reach), min(len(codes), last + reach)
        if can_reach(words, codes[lo:hi], MIN_SCORE * MATCH * len(item)):
            yield lo, hi


def _aligned(texts: list[np.ndarray], seeds: Seeds | RareSeeds, jobs: list[tuple[int, int, int, int]]) -> list[list[tuple[int, float, int, int]]]:
    """For each text the (item, score, first word, last word + 1) that score enough; jobs: text, item, and a stretch of the text."""
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    jobs = sorted(jobs, key=lambda j: (j[3] - j[2], j))  # alike in length, so that little is filled up
    while jobs:
        some = max(1, ALIGNED_CELLS // (jobs[0][3] - jobs[0][2] + 1))
        while some > 1 and len(jobs[:some]) * (jobs[:some][-1][3] - jobs[:some][-1][2]) > ALIGNED_CELLS:
            some //= 2
        now, jobs = jobs[:some], jobs[some:]
        for (t, i, lo, _), (score, a, b) in zip(now, align_many([seeds.items[j[1]] for j in now], [texts[j[0]][j[2] : j[3]] for j in now])):
            found = (score, -lo - a, lo + b)  # of equal scores the first
            if score >= MIN_SCORE and found > best.get((t, i), (0.0, 0, 0)):
                best[t, i] = found
    out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
    for (t, i), (score, a, b) in sorted(best.items()):
        out[t].append((i, score, -a, b))
    return out


def short_leaks(codes: np.ndarray, seeds: Seeds) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, last word + 1) of every short item that the words `codes` hold."""
    if seeds.width < SEED_WORDS:
        found: dict[int, tuple[int, float, int, int]] = {}
        for at, key in zip(*seeds.hits(codes)):
            for i in seeds.items_of(key):
                found.setdefault(i, (i, 1.0, int(at), int(at) + seeds.width))
        return sorted(found.values())
    near: dict[int, list[tuple[int, int]]] = {}
    for at, key in zip(*seeds.hits(codes)):
        for i in seeds.items_of(key):
            near.setdefault(i, []).append((int(at), int(at)))
    jobs = [(0, i, *x) for i, spans in near.items() for x in _stretches(codes, seeds.items[i], seeds.words[i], spans, 2 * len(seeds.items[i]) + SEED_WORDS)]
    return _aligned([codes], seeds, jobs)[0]


def long_leaks(texts: list[np.ndarray], seeds: RareSeeds) -> list[list[tuple[int, float, int, int]]]:
    """The same of the longer items, for each of several texts at once."""
    if not seeds.items or not texts:
        return [[] for _ in texts]
    begins = np.cumsum([0, *(len(c) + seeds.gap for c in texts[:-1])])  # no window holds words of two texts
    item, first, last = seeds.windows(np.concatenate(texts), np.concatenate([np.arange(len(c)) + b for c, b in zip(texts, begins)]))
    text = np.searchsorted(begins, first, side="right") - 1
    order = np.lexsort((first, item, text))
    text, item, first, last = (x[order] for x in (text, item, first - begins[text], last - begins[text]))
    cuts, jobs = np.flatnonzero((text[1:] != text[:-1]) | (item[1:] != item[:-1])) + 1, []
    for a, b in zip([0, *cuts] if len(text) else [], [*cuts, len(text)]):
        t, i = int(text[a]), int(item[a])
        spans = [*zip(first[a:b].tolist(), last[a:b].tolist())]
        jobs += [(t, i, *x) for x in _stretches(texts[t], seeds.items[i], seeds.words[i], spans, int(seeds.reach[i]))]
    return _aligned(texts, seeds, jobs)


def _item_blocks(benchmark: DataFrame, min_words: int) -> Iterator[list[tuple[object, bytes]]]:
    """(item_id, text) of the distinct items of `min_words` words or more, in blocks of bounded words; streamed, never held whole."""
    block, size = [], 0
    for row in benchmark.where("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        text = row[1].encode()
        words = len(text.split())
        if words >= max(1, min_words):
            block.append((row[0], text))
            size += words
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "leaks", min_words: int = 1) -> DataFrame:
    """All columns of `docs` and `name`: array of (item_id, score, first_word, end_word), empty for clean rows."""
    kind = leaks_type(benchmark.schema["item_id"].dataType)
    out = docs
    for block in _item_blocks(benchmark, min_words):
        out = _with_leaks(out, text_col, block, kind, name)
    return out if name in out.columns else out.withColumn(name, F.from_json(F.lit("[]"), kind))


def _with_leaks(docs: DataFrame, text_col: str, block: list[tuple[object, bytes]], kind: ArrayType, name: str) -> DataFrame:
    """Adds the leaks of a block of items to the column `name`, which the first block makes."""
    shared = docs.sparkSession.sparkContext.broadcast((*seeds_of_block([t for _, t in block]), [i for i, _ in block]))
    more, fields, arrow = name in docs.columns, kind.elementType.names, to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long, ids = shared.value
        short = [seeds for seeds in short if seeds.items]
        for batch in (small for big in batches for small in small_batches(big, text_col=text_col)):
            codes = [word_codes(text, long.index) for text in byte_texts(batch.column(text_col))]
            found = [[x for seeds in short for x in short_leaks(c, seeds)] + more for c, more in zip(codes, long_leaks(codes, long))]
            leaks = [[dict(zip(fields, (ids[n], *x))) for n, *x in own] for own in found]
            if more:
                leaks = [a + b for a, b in zip(batch.column(name).to_pylist(), leaks)]
            kept = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(leaks, arrow)], [*kept, name])

    return arrow_map(docs, run, StructType([f for f in docs.schema.fields if f.name != name]).add(name, kind))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """id, item_id, score, first_word, end_word: one row for each document and test item it holds."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return scan(rows, benchmark, min_words=min_words).select(F.col("id").alias(id_col), F.explode("leaks").alias("leak")).select(id_col, "leak.*")


@any_names
def keep_clean(docs: DataFrame, benchmark: DataFrame, min_words: int = SEED_WORDS) -> DataFrame:
    """The rows of `docs` that hold no test item of `min_words` words or more, with all their columns."""
    name = free_name(docs, "leaks")
    return scan(docs, benchmark, name=name, min_words=min_words).where(F.size(name) == 0).drop(name)
