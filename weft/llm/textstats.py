"""Statistics of whole texts, in one pass: counts that quality rules and the quality classifier read.

All are counts over the whole text; a null text counts as empty and has all zeros.
Words are runs of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from weft.llm.common import arrow_map, byte_texts, small_batches
from weft.llm.words import Words, normal_hash

#: Function words of the languages a crawl holds most (fixed values), one line a language: a feature of the quality classifier.
#: Quality rules count the common words of each language in the corpus instead.
COMMON_WORDS = (
    "the of and to in a is that it for was on are as with be by this or from at an not have has"
    " der die das und in zu den von ist mit für auf im sich ein eine des dem nicht als auch wird an"
    " le la les de des et un une du en est que pour dans qui par sur pas au avec ce il plus"
    " el los las y que por una con no se del lo para su es al como más"
).split()
COMMON = [w.encode() for w in dict.fromkeys(COMMON_WORDS)]
COMMON_HASHES = np.array([normal_hash(w) for w in COMMON], np.uint64)
#: Classes of characters, by their first byte in UTF-8.
CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "symbol", "punctuation", "other", "latin_ext", "wide"]
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_pipes", "n_exclaim"]


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"))
    for b in range(256):
        c = chr(b)
        kind = None
        if b < 128:
            if c.isupper():
                kind = "upper"
            elif c.islower():
                kind = "lower"
            elif c.isdigit():
                kind = "digit"
            elif b == 10:
                kind = "newline"
            elif b in b" \t\x0b\x0c\r":
                kind = "space"
            elif b in SYMBOLS:
                kind = "symbol"
            elif c in ".,;:!?":
                kind = "stop"
            elif 32 < b < 127:
                kind = "punctuation"
        elif 0xC0 <= b < 0xE0:
            kind = "latin_ext"
        elif b >= 0xE0:
            kind = "wide"
        if kind:
            table[b] = CLASSES.index(kind)
    return table


_CLASS, _SPACES, _SYMBOL_BYTES = _class_table(), np.array([9, 10, 11, 12, 13, 32]), np.frombuffer(SYMBOLS, np.uint8)


def _repeated(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each of `n` texts, the words in a window of three that the text holds twice or more; word hashes and their text's number (below 256)."""
    covered = np.zeros(len(h), bool)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    if len(at):
        three = (h[at] * np.uint64(0x9E3779B97F4A7C15) ^ h[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ h[at + 2]
        three = doc[at].astype(np.uint64) << np.uint64(56) | three >> np.uint64(8)
        ordered = np.sort(three)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(again):
            twice = at[again[np.minimum(np.searchsorted(again, three), len(again) - 1)] == three]
            for k in range(3):
                covered[twice + k] = True
    return np.bincount(doc[covered], minlength=n)


def measure(texts: list[bytes], common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """COUNTS of up to 256 texts, their characters by class, their words by place in `common` (normal hashes; the last place: all others); a row a text."""
    n = len(texts)
    bytes_of = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts])
    starts = np.where((np.arange(256) & 0xC0) == 0x80, 0, bytes_of)  # of characters
    n_chars = starts.sum(axis=1)
    classes = np.stack([starts[:, k == _CLASS].sum(axis=1) for k in range(len(CLASSES))], axis=1)
    words = Words(texts)
    h, doc, n_words = words.hashes(), words.doc, words.n_words
    place = np.full(len(h), len(common))
    if len(common):
        order, normal = np.argsort(common), words.normal_hashes()
        found = order[np.minimum(np.searchsorted(common, normal, sorter=order), len(common) - 1)]
        place = np.where(common[found] == normal, found, len(common))
    by_word = np.bincount(doc * (len(common) + 1) + place, minlength=n * (len(common) + 1)).reshape(n, len(common) + 1)
    own = np.sort(doc.astype(np.uint64) << np.uint64(56) | h >> np.uint64(8))
    distinct = np.bincount((own[np.append(True, own[1:] != own[:-1])] >> np.uint64(56)).astype(np.int64), minlength=n) if len(own) else np.zeros(n, np.int64)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    counts = [
        np.array([len(t) for t in texts]), n_chars, n_words, n_chars - bytes_of[:, _SPACES].sum(axis=1), bytes_of[:, _SYMBOL_BYTES].sum(axis=1), n_lines,
        n_lines - np.array([len(set(x)) for x in lines]), _repeated(h, doc, n), distinct, bytes_of[:, ord("|")], bytes_of[:, ord("!")],
    ]
    return np.stack(counts, axis=1), classes, by_word


#: What the struct of statistics holds.
STATS = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField(c, ArrayType(LongType())) for c in ("classes", "common")])


def stats_array(counts: np.ndarray, classes: np.ndarray, common: np.ndarray) -> pa.StructArray:
    """An array of the type STATS from what measure() found."""
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (classes, common)]
    return pa.StructArray.from_arrays([*map(pa.array, counts.T), *lists], STATS.names)


def text_stats(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", name: str = "stats") -> DataFrame:
    """The columns `keep` (all, if not given) of `docs` and a struct `name` of COUNTS, classes array<long>, common array<long> (by COMMON) for every row."""
    keep = keep or docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for big in batches for small in small_batches(big, 256, text_col)):
            found = measure([*byte_texts(batch.column(text_col))], COMMON_HASHES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), stats_array(*found)], [*keep, name])

    return arrow_map(docs, run, StructType([docs.schema[c] for c in keep]).add(name, STATS))
