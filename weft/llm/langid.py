"""Language identification in two steps: first the family, then, within it, one-versus-one linear SVMs.

A text is its lower-cased bytes, with everything in ASCII that is no letter as one
blank; its features are the shares of hashed byte n-grams (1 to 3).  Families are told
apart by one linear SVM each against the rest; languages of a family by one SVM for
each pair, by votes and then by margins.  All weights sit in one small matrix, which
is broadcast: `DIMS` rows and a column for each SVM.

Learns from about `TRAIN_ROWS` texts for each language, and `TRAIN_TOTAL` in all where
there are many (an even sample by a hash of the id), whose features, 8 KB each, are the
one thing that the driver collects.  Null texts and texts without a letter are `und` with score 0.  If nothing
can be learned every text is `und`; with one language every text with a letter is it.
Languages are the learned values; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import arrow_map, byte_texts, hash_mod, small_batches

DIMS, TRAIN_ROWS, TRAIN_TOTAL, STEPS, RIDGE = 2048, 600, 12_000, 150, 0.01
HELD_OUT = (4, 2)
#: Families of common languages (fixed values); any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn pa gu mr ne si",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = bytes(b if 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def has_letter(text: bytes) -> bool:
    if text.translate(_LETTERS, bytes(range(128, 256))).strip():
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def ngram_shares(text: bytes) -> np.ndarray:
    """Shares of hashed byte n-grams of a text with a letter, scaled so that a step of training moves them."""
    x = np.frombuffer(b" " + b" ".join(text.translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    two = x[:-1] * np.uint32(257) + x[1:]
    three = (two[:-1] * np.uint32(257) + x[2:]) * np.uint32(2654435761)
    bins = np.concatenate([x, (two * np.uint32(2246822519)) >> np.uint32(21), three >> np.uint32(21)])
    return np.bincount(bins.astype(np.int32), minlength=DIMS)[:DIMS] * (100.0 / len(x))


def _features(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (small for big in batches for small in small_batches(big, 128)):
            x = [ngram_shares(t) if has_letter(t) else np.zeros(DIMS) for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * DIMS), pa.array(np.concatenate(x).astype(np.float32)))], ["lang", "x"])

    return arrow_map(rows.select("lang", "text"), run, "lang string, x array<float>")


def linear_svm(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear SVM (squared hinge, ridge) for y in {-1, 1}; accelerated gradient steps on scaled columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    v = np.ones(z.shape[1], np.float32)
    for _ in range(8):  # the largest curvature, by power iteration
        v = z.T @ (z @ v) / len(z)
        top = float(np.linalg.norm(v))
        v /= top + 1e-12
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * len(y)
    rate = 1 / (2 * float(weight.max()) * (top + 1) + RIDGE)
    w = last = np.zeros(z.shape[1], np.float32)
    b = last_b = 0.0
    for k in range(STEPS):
        ahead, ahead_b = w + k / (k + 3) * (w - last), b + k / (k + 3) * (b - last_b)
        slack = weight * y * np.maximum(0, 1 - y * (z @ ahead + ahead_b))
        last, last_b = w, b
        w = ahead - rate * (RIDGE * ahead - 2 * (z.T @ slack) / len(z))
        b = ahead_b + rate * 2 * float(slack.mean())
    return w / scale, float(b - (w / scale) @ mean)


def fit_languages(docs: DataFrame) -> dict:
    """langs, families, and for each SVM its kind, names, weights and intercept; from `docs` (doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (hash_mod(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1]))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    model = {"langs": langs, "families": sorted({family(x) for x in langs}), "ovr": [], "pairs": []}
    if len(langs) < 2:
        return model
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    most = min(TRAIN_ROWS, TRAIN_TOTAL / len(langs))
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(1_000_000 * min(1, most / n)))])
    sample = _features(known.where(place < limit[F.col("lang")])).toArrow()
    own = np.array(sample["lang"].to_pylist(), dtype=str)
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(len(own), DIMS)
    kin = np.array([family(a) for a in own])
    part = lambda rows, yes: linear_svm(x[rows], np.where(yes[rows], 1, -1).astype(np.float32))
    every = np.ones(len(own), bool)
    members = {f: [a for a in langs if family(a) == f] for f in model["families"]}
    if len(members) == 2:  # one plane parts two families
        first, second = model["families"]
        w, b = part(every, kin == first)
        model["ovr"] = [(first, w, b), (second, -w, -b)]
    elif len(members) > 2:
        model["ovr"] = [(f, *part(every, kin == f)) for f in members]
    for m in members.values():
        model["pairs"] += [(a, b, *part(np.isin(own, [a, b]), own == a)) for a, b in combinations(m, 2)]
    return model


def _predict(model: dict, margins: np.ndarray) -> tuple[str, float]:
    """Language and score of one text from the margins of all SVMs, in the model's order."""
    n = len(model["ovr"])
    best, sure = model["families"][0], np.inf
    if n:
        best, sure = model["ovr"][int(np.argmax(margins[:n]))][0], float(np.max(margins[:n]))
    inside = [x for x in model["langs"] if family(x) == best]
    if len(inside) > 1:
        votes = dict.fromkeys(inside, (0, 0.0))
        for (a, b, *_), m in zip(model["pairs"], margins[n:]):
            if a in votes and b in votes:
                votes[a] = (votes[a][0] + (m > 0), votes[a][1] + m)
                votes[b] = (votes[b][0] + (m <= 0), votes[b][1] - m)
        lang = max(inside, key=lambda x: votes[x])
        sure = min(sure, votes[lang][1] / (len(inside) - 1))
    else:
        lang = inside[0]
    return lang, float(1 / (1 + np.exp(-2 * np.clip(sure, -20, 20))))


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score for every row of `docs`."""
    svms = [*model["ovr"], *model["pairs"]]
    weights = np.stack([s[-2] for s in svms], axis=1).astype(np.float32) if svms else np.zeros((DIMS, 0), np.float32)
    plain = {"langs": model["langs"], "families": model["families"], "ovr": [(s[0],) for s in model["ovr"]], "pairs": [s[:2] for s in model["pairs"]]}
    shared = docs.sparkSession.sparkContext.broadcast((plain, weights, np.array([s[-1] for s in svms])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, b = shared.value
        for batch in (small for big in batches for small in small_batches(big)):
            found = []
            for text in byte_texts(batch.column("text")):
                if not names["langs"] or not has_letter(text):
                    found.append(("und", 0.0))
                else:
                    found.append(_predict(names, ngram_shares(text).astype(np.float32) @ w + b))
            lang, score = zip(*found)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(lang), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), (hash_mod(F.col(id_col), HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
