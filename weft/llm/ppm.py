"""Language-model scores: prediction by partial matching over a byte-context trie.

The model is pretrained on all training documents.  Every byte (and one end symbol a
document) is counted in its contexts of 0 to `ORDER` bytes, and the model holds all of
them, however many: it grows with the corpus.  A symbol not seen in a context escapes
to the next shorter one by the number of distinct symbols seen (method C), and symbols
already seen there no longer take part (symbol exclusion); below order 0 all remaining
symbols are equally likely.

A symbol's probability depends on it and the `ORDER` bytes before it alone, its gram.
The rows are dealt into chunks of about `CHUNK` bytes and written once; a chunk's
distinct grams, with their training counts, are dealt by the two bytes before the
symbol (`gram_scores`), where all their contexts of two bytes and more meet, and the
256 x 256 counts of shorter ones are broadcast.  Counts come first there and are added
up as they come; then each chunk's grams are answered one chunk at a time.  Each chunk
gets the values of its own grams back and is scored by them, so that no task holds more
than a chunk's grams or the distinct ones of a pair of bytes, however many chunks ask.

The unigram base needs the exact count of every token.  Tokens seen `n` times or more
(the smallest n that leaves at most `HOT_TOKENS` of them) are broadcast with their
counts; all other tokens are joined with the full count table by token, so the result
is exact whatever the vocabulary's size.

Null texts are empty: they have one token, the end.  Repeated rows are scored each;
a null id is in the training part and not held out.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from weft.llm.common import arrow_map, byte_texts, hash_mod, scratch, small_batches, stored

ORDER, HOT_TOKENS = 5, 100_000
HELD_OUT = (10, 0)
#: Bytes that UTF-8 never holds (fixed values): the blank before a text, and its end.
BEFORE, END = 0xFE, 0xFF
#: The end token of the unigram base; no word can hold a blank.
END_TOKEN = b" "
#: Distinct tokens, and bytes of text, that a task counts before it passes them on.
FLUSH, FLUSH_BYTES = 200_000, 64_000_000
#: Bytes of text that share one table of values.
CHUNK = 16_000_000
#: Grams that a task adds up before it passes them on, and about as many as are valued at a time.
HELD_GRAMS, SLICE_GRAMS = 1_000_000, 500_000


def _grams(text: bytes) -> np.ndarray:
    """Each symbol of a text with the ORDER bytes before it, packed, latest byte lowest."""
    x = np.frombuffer(bytes([BEFORE]) * ORDER + text + bytes([END]), np.uint8).astype(np.int64)
    n = len(x) - ORDER
    code = x[:n].copy()
    for k in range(1, ORDER + 1):
        code = (code << 8) | x[k : n + k]
    return code


def chunked(rows: DataFrame) -> DataFrame:
    """`rows` (text and others), chunk and place: successive rows of a task with about CHUNK bytes of text, numbered.  Store it before it is read twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, place, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in (small for big in batches for small in small_batches(big)):
            of = []
            for text in byte_texts(batch.column("text")):
                if size > CHUNK:
                    chunk, place, size = chunk + 1, 0, 0
                of.append((chunk, place))
                place, size = place + 1, size + len(text) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in zip(*of))], [*batch.schema.names, "chunk", "place"])

    return arrow_map(rows, run, StructType(list(rows.schema.fields)).add("chunk", LongType()).add("place", LongType()))


def _merged(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, with the sums of their n."""
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.empty(0, np.int64)
    return grams[first], np.add.reduceat(n, first) if len(first) else n


def _pack(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of 4-byte values between `cuts` as binaries, all first bytes before all second ones, as sorted values then compress well."""
    return pa.array([values[i:j].view(np.uint8).reshape(-1, 4).T.tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())


def _unpack(data: bytes, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view(kind).ravel()


def _full(last: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Grams from their last two context bytes and their other four."""
    tails = tails.astype(np.int64)
    return (tails >> 8) << 24 | last << 8 | tails & 255


def pair_counts(rows: DataFrame) -> np.ndarray:
    """How often each symbol follows each byte in `rows` (text): 256 x 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in (small for big in batches for small in small_batches(big, text_col="text")):
            n += np.bincount(np.concatenate([_grams(t.lower()) & 0xFFFF for t in byte_texts(batch.column("text"))]), minlength=1 << 16)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["pair", "n"])

    found = np.zeros(1 << 16, np.int64)
    for r in arrow_map(rows.select("text"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        found[r["pair"]] = r["n"]
    return found.reshape(256, 256)


def chunk_grams(rows: DataFrame) -> DataFrame:
    """last, chunk, tails, counts: the distinct grams of `rows` (chunk, held_out, text).

    A row holds grams that share the last two context bytes, `last`, as their other four bytes.  Rows with `counts` say how often the training rows
    of some chunks have them; rows without say which a chunk asks for, and a chunk that several tasks read has rows of each.
    """

    def by_last(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        last, tails = (grams >> 8) & 0xFFFF, (grams >> 24) << 8 | grams & 255
        order = np.argsort(last << 32 | tails)
        begin, _ = _runs(last[order])
        return order, last[order][begin], tails[order].astype(np.uint32), np.append(begin, len(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, texts, size = None, [], {False: [], True: []}, 0
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        names = ["last", "chunk", "tails", "counts"]

        def settle() -> None:
            for out, of in texts.items():
                if of:
                    grams, n = np.unique(np.concatenate(of), return_counts=True)
                    parts.append((grams, n * (not out)))
                    of.clear()

        def chunk_out() -> pa.RecordBatch:
            nonlocal held
            settle()
            grams, n = _merged(*(np.concatenate(x) for x in zip(*parts)))
            parts.clear()
            held = _merged(np.concatenate((held[0], grams)), np.concatenate((held[1], n)))
            _, last, tails, cuts = by_last(grams)
            return pa.RecordBatch.from_arrays([pa.array(last, pa.int32()), pa.array(np.full(len(last), now)), _pack(tails, cuts), pa.nulls(len(last), pa.binary())], names)

        def counts_out() -> pa.RecordBatch:
            nonlocal held
            grams, n = held
            held = (grams[:0], n[:0])
            order, last, tails, cuts = by_last(grams)
            return pa.RecordBatch.from_arrays([pa.array(last, pa.int32()), pa.nulls(len(last), pa.int64()), _pack(tails, cuts), _pack(n[order].astype(np.uint32), cuts)], names)

        for batch in (small for big in batches for small in small_batches(big)):
            for chunk, out, text in zip(batch.column("chunk").to_pylist(), batch.column("held_out").to_pylist(), byte_texts(batch.column("text"))):
                if chunk != now:
                    if now is not None:
                        yield chunk_out()
                        if len(held[0]) > HELD_GRAMS:
                            yield counts_out()
                    now, size = chunk, 0
                texts[out].append(_grams(text.lower()))
                size += len(text)
                if size > 4_000_000:
                    settle()
                    size = 0
        if now is not None:
            yield chunk_out()
            yield counts_out()

    return arrow_map(rows.select("chunk", "held_out", "text"), run, "last int, chunk long, tails binary, counts binary")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and the run of each row."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


def gram_values(grams: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's symbol after its context, for distinct grams that share the last two context bytes.

    `n` are the grams' training counts, 0 where only other rows have them; all training grams of the two bytes must be there.
    `low` (256 x 256) has the counts of a symbol by the byte before it.
    """
    known = [low.sum(axis=0), low[int(grams[0] >> 8) & 255], np.bincount(grams & 255, n, 256).astype(np.int64)]
    third = (grams >> 24) & 255
    order = np.argsort(third, kind="stable")
    cuts = [0]
    for begin in _runs(third[order])[0]:
        if begin - cuts[-1] >= SLICE_GRAMS:
            cuts.append(begin)
    out = np.empty(len(grams))
    for i, j in zip(cuts, [*cuts[1:], len(grams)]):
        out[order[i:j]] = _slice_values(grams[order[i:j]], n[order[i:j]], known)
    return out


def _slice_values(grams: np.ndarray, n: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """gram_values() of all grams with some third context bytes; `known` are the counts of a symbol in their shared contexts of 0, 1 and 2 bytes."""
    symbol = grams & 255
    log = lambda x: np.log10(np.maximum(x, 1))
    zero = known[0]
    counts = [c[symbol] for c in known]
    totals, kinds = ([np.full(len(grams), c) for c in of] for of in ([c.sum() for c in known], [(c > 0).sum() for c in known]))
    # what is left of an order's shorter context once the symbols seen in it are excluded
    rest = [None, *(np.full(len(grams), short[long == 0].sum()) for short, long in zip(known, known[1:]))]
    for k in range(len(known), ORDER + 1):
        key = grams & ((1 << (8 * (k + 1))) - 1)
        order = np.argsort(key, kind="stable")
        begin, run = _runs(key[order])
        sums = np.add.reduceat(n[order], begin)
        one_key = key[order][begin]
        context_begin, context = _runs(one_key >> 8)
        shorter = counts[k - 1][order][begin]
        per = (sums, np.add.reduceat(sums, context_begin)[context], np.add.reduceat((sums > 0).astype(np.int64), context_begin)[context], np.add.reduceat(np.where(sums > 0, shorter, 0), context_begin)[context])
        back = np.empty(len(grams), np.int64)
        back[order] = run
        count, total, kind, seen = (x[back] for x in per)
        counts.append(count)
        totals.append(total)
        kinds.append(kind)
        rest.append(totals[k - 1] - seen)
    out = np.zeros(len(grams))
    done = np.zeros(len(grams), bool)  # the symbol was found in a longer context
    entered = np.zeros(len(grams), bool)  # a longer context was seen
    for k in range(ORDER, -1, -1):
        fresh = ~entered & (totals[k] > 0)
        hit = fresh & (counts[k] > 0)
        out += np.where(fresh, np.where(hit, log(counts[k]), log(kinds[k])) - log(totals[k] + kinds[k]), 0)
        if k < ORDER:
            left = kinds[k] - kinds[k + 1]
            late = entered & ~done & (left > 0)
            found = late & (counts[k] > 0)
            out += np.where(late, np.where(found, log(counts[k]), log(left)) - log(rest[k + 1] + left), 0)
            hit |= found
        done |= hit
        entered |= fresh
    return np.where(done, out, out - np.log10(max(1, 255 - int((zero > 0).sum()))))


def gram_scores(grams: DataFrame, low: np.ndarray) -> DataFrame:
    """last, chunk, tails, scores for every row of `grams` (of chunk_grams()) that asks: the grams' log10 probabilities; `low` of pair_counts()."""
    shared = grams.sparkSession.sparkContext.broadcast(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size, merged, distinct, value = None, [], 0, 0, None, None
        answers = []

        def answers_out() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*answers), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["last", "chunk", "tails", "scores"])
            answers.clear()
            return out

        for batch in batches:
            for last, chunk, tails, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if last != now:
                    now, parts, size, merged, distinct = last, [], 0, 0, None
                if counts is not None:
                    parts.append((_unpack(tails), _unpack(counts).astype(np.int64)))
                    size += len(tails) // 4
                    if size > 2 * merged + HELD_GRAMS:  # add up as they come
                        parts = [_merged(*(np.concatenate(x) for x in zip(*parts)))]
                        size = merged = len(parts[0][0])
                    continue
                if distinct is None:  # all counts of these two bytes are in
                    distinct, n = _merged(*(np.concatenate(x) for x in zip(*parts)))
                    parts, value = [], gram_values(_full(np.int64(now), distinct), n, shared.value).astype(np.float32)
                scores = value[np.searchsorted(distinct, _unpack(tails))]
                answers.append((last, chunk, tails, scores.view(np.uint8).reshape(-1, 4).T.tobytes()))
                if len(answers) == 64:
                    yield answers_out()
        if answers:
            yield answers_out()

    return arrow_map(grams.repartition("last").sortWithinPartitions("last", F.col("counts").isNull()), run, "last int, chunk long, tails binary, scores binary")


def token_counts(rows: DataFrame) -> DataFrame:
    """token binary, n: how often each token stands in `rows` (text), the end of a text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, size = Counter(), 0

        def tokens_out() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.binary()), pa.array(list(tokens.values()), pa.int64())], ["token", "n"])
            tokens.clear()
            return out

        for batch in (small for big in batches for small in small_batches(big)):
            for text in byte_texts(batch.column("text")):
                tokens.update(text.lower().split())
                tokens[END_TOKEN] += 1
                size += len(text)
                if len(tokens) > FLUSH or size > FLUSH_BYTES:
                    yield tokens_out()
                    size = 0
        if tokens:
            yield tokens_out()

    return arrow_map(rows.select("text"), run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The smallest n (a step of a quarter of a power of two) so that at most `most` rows of `counts` have n or more."""
    steps = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("step")).count().collect()  # a few hundred rows at most
    total, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        least = int(np.ceil(2 ** (r["step"] / 4) - 1e-9))
    return least


def gram_sums(texts: list[bytes], grams: np.ndarray, values: np.ndarray) -> np.ndarray:
    """log10 probability of each text and its end, from the values of all their grams (sorted)."""
    return np.array([values[np.searchsorted(grams, _grams(t))].sum() for t in texts], np.float64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`."""
    with scratch(docs.sparkSession) as keep:
        return stored(_scored(docs, id_col, text_col, keep))


def _chunk_scores(docs: DataFrame, id_col: str, text_col: str, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int, int, DataFrame]:
    """Counts of all training tokens, their sum and number, and the rows scored but for the tokens that are not hot; the texts' copy goes at the end."""
    held = hash_mod(F.col(id_col), HELD_OUT[0]) == HELD_OUT[1]
    with scratch(docs.sparkSession) as early:
        rows = early(chunked(docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))))
        tokens = keep(token_counts(rows.where(~F.col("held_out"))))
        total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        hot = tokens.where(F.col("n") >= _least_count(tokens, HOT_TOKENS)).toPandas()
        values = gram_scores(chunk_grams(rows), pair_counts(rows.where(~F.col("held_out"))))
        shared = docs.sparkSession.sparkContext.broadcast({bytes(t): np.log10(n + 0.1) for t, n in zip(hot["token"], hot["n"])})

        def run(table: pa.Table, own: pa.Table) -> pa.Table:
            value = shared.value.get
            tails, scores = (own.column(c).to_pylist() for c in ("tails", "scores"))
            last = np.repeat(own.column("last").to_numpy().astype(np.int64), [len(t) // 4 for t in tails])
            grams, at = np.unique(_full(last, np.concatenate([_unpack(t) for t in tails])), return_index=True)
            values = np.concatenate([_unpack(v, np.float32) for v in scores])[at].astype(np.float64)
            done = [pa.RecordBatch.from_pylist([], schema=kinds)]
            for batch in (small for big in table.to_batches() for small in small_batches(big, 64)):
                texts = [t.lower() for t in byte_texts(batch.column("text"))]
                n_tokens, n_known, sums, rest = [], [], [], []
                for text in texts:
                    words = [*text.split(), END_TOKEN]
                    got = list(map(value, words))
                    late = [w for w, v in zip(words, got) if v is None]
                    n_tokens.append(len(words))
                    n_known.append(len(words) - len(late))
                    sums.append(sum(v for v in got if v is not None) if late else sum(got))
                    rest.append(late)
                offsets = np.cumsum([0, *map(len, rest)]).astype(np.int32)
                late = pa.ListArray.from_arrays(pa.array(offsets), pa.array([w for r in rest for w in r], pa.binary()))
                score = gram_sums(texts, grams, values)
                same = [batch.column(c) for c in ("chunk", "place", "id", "held_out")]
                done.append(pa.RecordBatch.from_arrays([*same, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), late, pa.array(score)], schema=kinds))
            return pa.Table.from_batches(done, kinds)

        kind = rows.schema["id"].dataType
        types = StructType().add("chunk", "long").add("place", "long").add("id", kind).add("held_out", "boolean").add("n_tokens", "long").add("n_hot", "long").add("hot_sum", "double").add("late", ArrayType(BinaryType())).add("score", "double")
        kinds = to_arrow_schema(types)
        paired = rows.groupBy("chunk").cogroup(values.groupBy("chunk"))
        return tokens, total, distinct, keep(paired.applyInArrow(run, types))


def _scored(docs: DataFrame, id_col: str, text_col: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    tokens, total, distinct, scored = _chunk_scores(docs, id_col, text_col, keep)
    shift = np.log10(total + 0.1 * (distinct + 1))
    late = scored.where(F.size("late") > 0).select("chunk", "place", F.explode("late").alias("token"))
    late = late.groupBy("chunk", "place", "token").agg(F.count(F.lit(1)).alias("k")).join(tokens, "token", "left")
    late = late.groupBy("chunk", "place").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("n_late"), F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("late_sum"))
    out = scored.drop("late").join(late, ["chunk", "place"], "left")
    base = F.col("hot_sum") + F.coalesce("late_sum", F.lit(0.0)) - F.col("n_tokens") * float(shift)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_late", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
