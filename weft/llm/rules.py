"""Quality rules: a document's character classes and common words against language references.

References are made from all documents.  A language's common words are the
`COMMON_OF_LANGUAGE` that most of its documents hold; its reference is the sum, over its
documents that pass the base rules, of their characters by class and of their words by
common word, with all others as one more class.  A document is compared by Jensen-Shannon
distance (base 2, so from 0 to 1) with every reference and judged by the nearest one, so
that a wrong or missing language code does it no harm.

Guards: a document in a language without a reference is left to the base rules, as those of
other languages say nothing about it; below `MIN_CHARS` and `MIN_WORDS` so is any.  A
histogram of n counts in k classes is off its source by about sqrt(k / (8 n ln 2)) by
chance alone, which is granted on top of the limits.  A word that fewer than `MIN_HELD`
documents of a language hold is not common, and without any there is no reference.

Three passes over the texts and no shuffle of them: common words, references, verdicts.
Any number of languages is compared with; each further `LANGUAGES_A_PASS` cost a pass.

Null and empty texts have all counts 0 and fail the base rules.  Without any reference
(an empty table, no language) the divergence rejects nothing and the distances are null.
Ties of nearness go to the first language by name.  Repeated rows are judged each, and
rows with null ids like any other; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from weft.llm.common import any_names, arrow_map, byte_texts, free_name, small_batches
from weft.llm.textstats import CLASSES, COUNTS, measure
from weft.llm.words import Words

#: Guards, and the distances beyond chance from which a document is rejected.
MIN_CHARS, MIN_WORDS, MIN_HELD = 200, 60, 5
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.15
#: Common words that a language is told by, and languages that one pass compares with.
COMMON_OF_LANGUAGE, LANGUAGES_A_PASS = 32, 64
#: Words, once for each text, that a task holds before it passes their counts on.
FLUSH = 2_000_000

DISTANCES = ["class_distance", "word_distance"]
MEASURED = StructType()
for _name in COUNTS:
    MEASURED.add(_name, LongType())
for _name in DISTANCES:
    MEASURED.add(_name, DoubleType())


def base_failed(n_words, n_repeat_words):
    """For columns and for numbers alike."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


@dataclass
class References:
    """Of at most LANGUAGES_A_PASS languages: names, hashes of all common words, each language's places among these, and both histograms.

    A language with fewer common words than others has the place behind the last one instead, which no text holds.
    """

    langs: list[str]
    words: np.ndarray
    places: np.ndarray
    classes: np.ndarray
    common: np.ndarray

    def own_words(self, common: np.ndarray) -> np.ndarray:
        """Rows of counts by common word and others (n x words + 1) as rows by language and its own words and others."""
        held = np.concatenate([common[:, :-1], np.zeros((len(common), 1), common.dtype)], axis=1)[:, self.places]
        return np.concatenate([held, common.sum(axis=1)[:, None, None] - held.sum(axis=2, keepdims=True)], axis=2)


def _common_words(docs: DataFrame) -> DataFrame:
    """lang, words: normal hashes of each language's common words, first those that most of its documents hold; `docs` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def counts_out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                words, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.view(np.int64)), pa.array(n)], ["lang", "word", "n"])
            held.clear()

        for batch in (small for big in batches for small in small_batches(big, 256, "text")):
            words = Words([*byte_texts(batch.column("text"))])
            normal, ends = words.normal_hashes(), np.cumsum(words.n_words)
            for lang, own in zip(batch.column("lang").to_pylist(), np.split(normal, ends[:-1])):
                own = np.unique(own[own > 0])
                held.setdefault(lang, []).append(own)
                size += len(own)
            if size > FLUSH:
                yield from counts_out()
                size = 0
        yield from counts_out()

    held = arrow_map(docs, run, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_HELD)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    first = held.withColumn("place", place).where(F.col("place") <= COMMON_OF_LANGUAGE)
    return first.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).getField("word").alias("words"))


def _histograms(docs: DataFrame, refs: References) -> DataFrame:
    """lang, k, n: sums over the documents of each language that pass the base rules, by class and then by own common word; `docs` (lang, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        row = {lang: i for i, lang in enumerate(refs.langs)}
        classes_sum, common_sum = np.zeros((len(row), len(CLASSES)), np.int64), np.zeros((len(row), len(refs.words) + 1), np.int64)
        for batch in (small for big in batches for small in small_batches(big, 256, "text")):
            counts, classes, common = measure([*byte_texts(batch.column("text"))], refs.words)
            good = ~base_failed(counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")])
            own = np.array([row[x] for x in batch.column("lang").to_pylist()])[good]
            np.add.at(classes_sum, own, classes[good])
            np.add.at(common_sum, own, common[good])
        sums = np.concatenate([classes_sum, refs.own_words(common_sum)[np.arange(len(row)), np.arange(len(row))]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(refs.langs, sums.shape[1])), pa.array(np.tile(np.arange(sums.shape[1]), len(row))), pa.array(sums.ravel())], ["lang", "k", "n"])

    return arrow_map(docs.where(F.col("lang").isin(refs.langs)), run, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))


def language_references(docs: DataFrame) -> list[References]:
    """References of all languages by name, in blocks; from all of `docs` (lang, text).  What the driver gets is one short row a language."""
    docs = docs.where("lang is not null").select("lang", "text")
    words = [(r["lang"], r["words"]) for r in _common_words(docs).orderBy("lang").collect()]
    blocks = []
    for at in range(0, len(words), LANGUAGES_A_PASS):
        langs, lists = zip(*words[at : at + LANGUAGES_A_PASS])
        index = {w: i for i, w in enumerate(dict.fromkeys(w for x in lists for w in x))}
        places = np.array([[index[w] for w in x] + [len(index)] * (COMMON_OF_LANGUAGE - len(x)) for x in lists])
        hashes = np.array([*index], np.int64).view(np.uint64)
        refs = References([*langs], hashes, places, np.zeros((len(langs), len(CLASSES))), np.zeros((len(langs), COMMON_OF_LANGUAGE + 1)))
        row = {lang: i for i, lang in enumerate(langs)}
        for r in _histograms(docs, refs).collect():
            own, k = (refs.classes, r["k"]) if r["k"] < len(CLASSES) else (refs.common, r["k"] - len(CLASSES))
            own[row[r["lang"]], k] = r["n"]
        some = refs.common.sum(axis=1) > 0
        if some.any():
            blocks.append(References([x for x, s in zip(langs, some) if s], hashes, places[some], refs.classes[some], refs.common[some]))
    return blocks


def _distances(rows: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts (n x 1 or languages x k) to each reference (languages x k)."""
    p = rows / np.maximum(rows.sum(axis=2, keepdims=True), 1)
    q = (refs / np.maximum(refs.sum(axis=1, keepdims=True), 1))[None, :, :]
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=2)
    return np.sqrt(np.maximum(0, (part(p) + part(q)) / 2))


def nearest(refs: References, classes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Class and word distance of each row of counts to its nearest reference, the one of least sum."""
    a, b = _distances(classes[:, None, :], refs.classes), _distances(refs.own_words(common), refs.common)
    best = (a + b).argmin(axis=1)[:, None]
    return np.concatenate([np.take_along_axis(x, best, axis=1) for x in (a, b)], axis=1)


def _measured(docs: DataFrame, refs: References | None, keep: list[str], text_col: str, name: str) -> DataFrame:
    """The columns `keep` of `docs` and a struct `name` of counts and distances; if `docs` has that struct, the lesser distances stay."""
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    again = name in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        words = refs.words if refs else np.empty(0, np.uint64)
        for batch in (small for big in batches for small in small_batches(big, 256, text_col)):
            counts, classes, common = measure([*byte_texts(batch.column(text_col))], words)
            far = nearest(refs, classes, common) if refs else np.full((len(counts), 2), np.nan)
            if again:
                before = np.stack([batch.column(name).field(d).to_numpy(zero_copy_only=False) for d in DISTANCES], axis=1)
                far = np.where((before.sum(axis=1) <= far.sum(axis=1))[:, None], before, far)
            arrays = [*map(pa.array, counts.T), *(pa.array(x, from_pandas=True) for x in far.T)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.StructArray.from_arrays(arrays, MEASURED.names)], [*keep, name])

    return arrow_map(docs, run, StructType([docs.schema[c] for c in keep]).add(name, MEASURED))


def _chance(classes: int, n: Column) -> Column:
    return F.sqrt(classes / (8 * log(2)) / n)


def judge(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", name: str = "verdict") -> DataFrame:
    """The columns `keep` (all, if not given) of `docs` and a struct `name`: COUNTS, class_distance, word_distance, base_failed, kept."""
    lang, keep = F.col(lang_col).cast("string"), keep or docs.columns
    blocks = language_references(docs.select(lang.alias("lang"), F.col(text_col).alias("text")))
    known = free_name(docs, "known_language")
    out = docs.withColumn(known, F.coalesce(lang.isin([x for refs in blocks for x in refs.langs]), F.lit(True)))
    for k, refs in enumerate(blocks or [None]):
        last = k + 1 >= len(blocks)
        out = _measured(out, refs, [*(keep if last else docs.columns), known], text_col, name)
    v = F.col(name)
    far = (v["class_distance"] > MAX_CLASS_DISTANCE + _chance(len(CLASSES), v["n_chars"])) & (v["n_chars"] >= MIN_CHARS)
    far = far | (v["word_distance"] > MAX_WORD_DISTANCE + _chance(COMMON_OF_LANGUAGE + 1, v["n_words"])) & (v["n_words"] >= MIN_WORDS)
    far = far & F.col(known)
    failed = base_failed(v["n_words"], v["n_repeat_words"])
    return out.withColumn(name, v.withField("base_failed", failed).withField("kept", ~failed & ~F.coalesce(far, F.lit(False)))).drop(known)


@any_names
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (text, lang and others) whose texts pass, with all their columns."""
    name = free_name(docs, "verdict")
    return judge(docs, name=name).where(F.col(name)["kept"]).drop(name)
