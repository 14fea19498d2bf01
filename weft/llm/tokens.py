"""Token counts: whole-token shortcut over a byte-level BPE with word ends.

`load_vocabulary` proves on the driver, once, which vocabulary strings encode
alone as one token.  Tasks look pre-tokens up in that table; only the rest is
merged, in batches, and remembered in a memo of bounded size.  The table is
bounded by the vocabulary (49k entries), which is why it may be broadcast.

Nulls count as the empty text (0 tokens).  Empty texts have 0 tokens.  Repeated
rows are counted each; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm.common import MEMO_BYTES, Memo, arrow_map, small_batches

#: White space to `str.split()`, but not to the tokenizer (fixed values).
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters, numbers and white space of Latin-1 as Unicode has them (fixed values).
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")


@dataclass
class Vocabulary:
    """spec: the tokenizer as JSON; special: ids of added tokens; whole: pre-tokens proven to be one token, with packed id."""

    spec: str
    special: dict[str, int]
    whole: dict[str, bytes]


def load_vocabulary(path: str) -> Vocabulary:
    """Read the tokenizer file and prove its whole tokens: each vocabulary string that closes a word is encoded alone."""
    tokenizer = Tokenizer.from_file(path)
    spec, suffix = tokenizer.to_str(), tokenizer.model.end_of_word_suffix or ""
    byte_of = {c: b for b, c in enumerate(_byte_alphabet())}
    words = {}
    for symbol, i in tokenizer.get_vocab(with_added_tokens=False).items():
        stem = symbol[: len(symbol) - len(suffix)]
        if stem and symbol.endswith(suffix) and all(c in byte_of for c in stem):
            try:
                words[bytes(byte_of[c] for c in stem).decode()] = i
            except UnicodeDecodeError:
                continue  # part of a character: never a pre-token of its own
    alphabet, model = _byte_alphabet(), tokenizer.model
    alone = lambda w: [t.id for t in model.tokenize("".join(alphabet[b] for b in w.encode()))]
    proven = {w: i.to_bytes(4, "little") for w, i in words.items() if alone(w) == [i]}
    return Vocabulary(spec, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}, proven)


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordIds(Memo):
    """Packed ids (uint32, little-endian) by word, remembered within the bounds of a memo; a missing word is cut into pre-tokens that are proven, remembered or merged now.

    A pre-token that stands alone as a word is the same to the tokenizer, so both share the memo.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(self._encoded, 3 * MEMO_BYTES)
        self.whole, self.library = vocabulary.whole, Tokenizer.from_str(vocabulary.spec)
        self.model, self.alphabet = self.library.model, _byte_alphabet()
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]

    def _encoded(self, word: str) -> bytes:
        pieces = [word] if word.isascii() and word.isalpha() else self._cut(word)
        return self._merged(word) if pieces == [word] else b"".join(map(self._piece, pieces))

    def _piece(self, piece: str) -> bytes:
        ids = self.get(piece) or self.before.get(piece)
        return self.remember(piece, self._merged(piece)) if ids is None else ids

    def _merged(self, piece: str) -> bytes:
        ids = self.whole.get(piece)
        if ids is None:
            standing = piece if piece.isascii() and piece.isprintable() else "".join(map(self.alphabet.__getitem__, piece.encode()))
            ids = b"".join([self.packed[t.id] for t in self.model.tokenize(standing)])
        return ids

    def _cut(self, word: str) -> list[str]:
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return [w for w, _ in self.library.pre_tokenizer[0].pre_tokenize_str(word)]
        return _PRE_TOKEN.findall(word)


class TextEncoder:
    """Packed ids of whole texts, as the library gives them without begin, end or added tokens.

    No pre-token spans white space, so a text's ids are those of its words in turn.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.words = vocabulary, WordIds(vocabulary)
        self.special = re.compile("|".join(map(re.escape, vocabulary.special))) if vocabulary.special else None

    def _split(self, text: str) -> list[str]:
        """Words of a text without special strings, normalised."""
        if not text.isascii():
            try:
                text.encode("latin-1")  # nothing to compose, and lower() is the tokenizer's
            except UnicodeEncodeError:
                return self.words.library.normalizer.normalize_str(text).split(" ")
        return text.lower().split() if not _ODD_SPACE.search(text) else re.split(f"[{_SPACE}]", text.lower())

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self._split(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special is None or "<" not in text or not self.special.search(text):
            return self._ids(text)
        parts, at = [], 0
        for hit in self.special.finditer(text):
            parts += [self._ids(text[at : hit.start()]), self.v.special[hit[0]].to_bytes(4, "little")]
            at = hit.end()
        return b"".join([*parts, self._ids(text[at:])])


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row of `docs`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(shared.value)
        for batch in (small for big in batches for small in small_batches(big, 256)):
            n = [len(encoder.encode(text)) // 4 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = arrow_map(rows, run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
