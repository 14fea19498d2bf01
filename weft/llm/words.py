"""Words of many texts at once, as 64-bit hashes made by array operations, with no Python object for a word.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Its hash is a polynomial over its
bytes' random values, mixed; that two words of one corpus share a hash is as unlikely as with
any other hash of 64 bits.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240301)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C13)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_POWERS = [np.cumprod(np.full(256, _STEP))]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.full(2 * n, _STEP))
    return _POWERS[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """All words of `texts` in order; `doc` is each word's text, `n_words` the number of each text's."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = np.frombuffer(b" ".join(texts), np.uint8)
        at = np.flatnonzero(~_BLANK[joined])
        self.data = joined[at]
        self.starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1))) if len(at) else at
        self.sizes = np.diff(np.append(self.starts, len(at)))
        self.place = np.arange(len(at)) - np.repeat(self.starts, self.sizes)  # of a byte in its word
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(ends, at[self.starts], side="right")
        self.n_words = np.bincount(self.doc, minlength=len(texts))

    def _sums(self, data: np.ndarray, place: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        if not len(data):
            return np.empty(0, np.uint64)
        terms = _BYTE[data] * _powers(int(self.sizes.max()))[place]
        return mixed(np.add.reduceat(terms if within is None else np.where(within, terms, np.uint64(0)), self.starts))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """Of each word, as it stands or with A-Z lower-cased."""
        return self._sums(_LOWER[self.data] if lower else self.data, self.place)

    def normal_hashes(self) -> np.ndarray:
        """Of each word lower-cased (A-Z) and without ASCII marks at its ends; 0 if nothing is left."""
        if not len(self.data):
            return np.empty(0, np.uint64)
        mark = _MARK[self.data]
        first = np.repeat(np.minimum.reduceat(np.where(mark, len(mark), self.place), self.starts), self.sizes)
        last = np.repeat(np.maximum.reduceat(np.where(mark, -1, self.place), self.starts), self.sizes)
        return self._sums(_LOWER[self.data], np.maximum(self.place - first, 0), (self.place >= first) & (self.place <= last))


def normal_hash(word: bytes) -> int:
    """The hash of one word, as Words.normal_hashes() has it."""
    return int(Words([word]).normal_hashes()[0])
