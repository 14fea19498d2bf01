"""Training-data operators against brute force, round trips and held-out accuracy, on small tables with odd rows."""

import hashlib
import json
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.llm import chat, common, decontam, langid, neardup, packing, pipeline, ppm, quality, queries, rules, textstats, tokens, urlrules, words

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "one", "two words", "a b c d e", "A b C d E", "a b c d e", "<|endoftext|> x", "naïve 中文 ﬁ É", "x" * 20_000, "w " * 9_000]


def docs(spark, texts, first=1, **extra):
    rows = [(first + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.withColumns({k: F.lit(v) for k, v in (extra or {"score": 1, "id": 2, "row_id": 3, "kept": 4}).items()})


def empty(spark):
    return docs(spark, ["x"]).where("doc_id < 0")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


def test_tokens_equal_library(spark, library):
    rng = random.Random(4)
    pool = [chr(c) for c in range(256)] + ["'s", "re", "<|endoftext|>", "É", "İ", "Σ", "ﬁ", "中", "é", "٣", "‍"]
    texts = ODD + ["".join(rng.choices(pool, k=rng.randint(0, 15))) for _ in range(800)]
    encoder = tokens.TextEncoder(tokens.load_vocabulary(queries.TOKENIZER))
    for t, ids in zip(texts, map(encoder.encode, texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    got = {r["doc_id"]: r for r in tokens.count_tokens(docs(spark, ODD), queries.TOKENIZER, 100).collect()}
    assert len(got) == len(ODD) and got[1]["n_tokens"] == 0 and got[1]["n_bytes"] == 0
    assert all(got[i + 1]["over_limit"] == (len(library.encode(t or "", add_special_tokens=False).ids) > 100) for i, t in enumerate(ODD))
    assert tokens.count_tokens(empty(spark), queries.TOKENIZER).count() == 0


def test_small_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(common, "MEMO_BYTES", 500)
    encoder = tokens.TextEncoder(tokens.load_vocabulary(queries.TOKENIZER))
    texts = ["the quick brown foxling jumped's over", "unheardofwords abcdxyz, the end!!"] * 3
    assert [np.frombuffer(x, "<u4").tolist() for x in map(encoder.encode, texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(rows, texts, library, capacity):
    by_doc, seqs = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(by_doc[i + 1], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), capacity))
        for r in parts:
            part = ids[r["start"] : r["start"] + capacity]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), sum(r["length"] for r in rows)


def test_packing(spark, library, monkeypatch):
    rng = random.Random(1)
    texts = ODD + ["tok " * rng.randint(0, 90) for _ in range(300)] + ["same"] * 200
    monkeypatch.setattr(packing, "UNIT_PIECES", 40)  # many copies and levels
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    n, total = check_packing(packing.pack(docs(spark, texts), queries.TOKENIZER, 64).collect(), texts, library, 64)
    assert n <= math.ceil(total / 64) * 1.05 + 3
    assert packing.pack(empty(spark), queries.TOKENIZER, 64).count() == 0


def brute_packing(lengths, capacity):
    """Sum of squares, piece by piece, longest first, over lists: the (offset, length) of each sequence."""
    bins = []
    for n in sorted(lengths, reverse=True):
        open_bins = Counter(capacity - sum(b) for b in bins if sum(b) < capacity)
        squares = lambda c: sum(v * v for v in c.values())
        best = None
        for gap in sorted(g for g in open_bins if g >= n):
            after = open_bins.copy()
            after[gap] -= 1
            if gap > n:
                after[gap - n] += 1
            if best is None or squares(after) < best[0]:
                best = (squares(after), gap)
        if best:
            k = max(k for k, b in enumerate(bins) if capacity - sum(b) == best[1])  # of equal gaps the one that came last to it
            bins.append([*bins.pop(k), n])
        else:
            bins.append([n])
    return Counter(tuple((sum(b[:k]), n) for k, n in enumerate(b)) for b in bins)


def test_packing_equals_brute_force(spark, library):
    rng = random.Random(21)
    texts = [*ODD[:9], *[" ".join(rng.choices(["house", "water", "evening", "x"], k=rng.randrange(60))) for _ in range(70)]]
    lengths = [n for t in texts for ids in [len(library.encode(t or "", add_special_tokens=False).ids) + 1] for n in [40] * (ids // 40) + [ids % 40] * (ids % 40 > 0)]
    rows = packing.pack(docs(spark, texts), queries.TOKENIZER, 40).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    got, want = Counter(tuple(sorted(x)) for x in by_sequence.values()), brute_packing(lengths, 40)
    assert sum(got.values()) == sum(want.values()) and Counter(n for x in got.elements() for _, n in x) == Counter(lengths)
    assert got == want


def test_plan_is_complete_and_tight():
    rng = np.random.default_rng(2)
    counts = Counter(rng.integers(1, 513, 30_000).tolist())
    ranges, slots = packing.plan_packing(counts, 512, 5_000)
    assert {s: int(g["each"].mul(g["copies"]).sum()) for s, g in ranges.groupby("length")} == dict(sorted(counts.items()))
    bins = int(ranges.drop_duplicates("level").eval("copies * unit_bins").sum())
    assert bins <= sum(k * v for k, v in counts.items()) / 512 * 1.02
    assert len(slots) <= 5_000 * (ranges["level"].max() + 1)


def test_sum_of_squares_choice():
    bins, offsets = packing.pack_unit(np.array([6, 6, 5, 4, 4]), 10)
    assert bins.tolist() == [0, 1, 2, 1, 0] and offsets.tolist() == [0, 0, 0, 6, 6]  # both gaps of 4 close rather than the one of 5


def test_chat_round_trips(spark):
    rng = random.Random(3)
    bits = [chat.START, chat.END, "<\\|im_end|>", "<\\\\|im_start|>", "\n", "user", "x", "<|", "|>", "\\", "<|im_end|>\n<|im_start|>assistant\nok"]
    for _ in range(500):
        role, text = "".join(rng.choices(bits, k=rng.randint(0, 2))), "".join(rng.choices(bits, k=rng.randint(0, 6)))
        out, a, b = chat.render(role, text)
        assert chat.parse(out) == [(role, text)] and chat.unescape(out[a:b]) == text
        assert chat._CONTROL.findall(out.removeprefix(chat.START).removesuffix(chat.END + "\n")) == [] or all(s for s, _ in chat._CONTROL.findall(out[len(chat.START) : -len(chat.END) - 1]))
    rows = [(7, 1, "assistant", chat.END), (7, 0, None, None), (7, 2, "assistant", "é"), (None, 0, "user", ""), (8, 0, "user", "hi"), (8, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[7]["turns_sha256"] == hashlib.sha256(f"\n\nassistant\n{chat.END}\nassistant\né\n".encode()).hexdigest()
    assert (got[7]["loss_chars"], got[7]["loss_sha256"]) == (len(chat.END) + 1, hashlib.sha256((chat.END + "é").encode()).hexdigest())
    assert got[8]["n_turns"] == 2 and got[None]["n_turns"] == 1


def test_chat_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra string")
    assert chat.format_turns(none).count() == 0 and chat.read_back(chat.format_turns(none)).count() == 0


def test_parser_reads_whole_conversations():
    rng = random.Random(4)
    bits = [chat.START, chat.END, "<\\|im_end|>", "\n", "assistant", "ok", "\\"]
    for _ in range(200):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 2))), "".join(rng.choices(bits, k=rng.randint(0, 5)))) for _ in range(rng.randint(0, 6))]
        assert chat.parse("".join(chat.render(*t)[0] for t in turns)) == turns


@pytest.mark.parametrize("name", ["op4_chat_formatting", "op5_url_filters", "op6_minhash_near_dedup"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    text = lambda df: sorted(tuple("null" if pd.isna(v) else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert text(got) == text(want)


def test_url_rules(spark):
    urls = ["http://a.example.com/en/1", "http://WWW.example.com/en/1", "x", None, "", "http://spam-farm.org/a", "http://notspam-farm.org/a", "http://net/es/", "http://x.net/es", "ftp://h/casino/a/bonus?x", "http://example.com", "http://x.org/a+b(c)", "http://x.org/a+b(c)"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumns({"rule": F.lit("mine"), "key": F.lit(1)})
    made = [("||com/", "allow", 1), ("||example.com/en/", "block", 1), ("||www.example.com/en/", "allow", 1), ("||net/es/", "block", 1), ("||spam-farm.", "block", 0), ("/casino/*/bonus^", "block", 0), ("a+b(c)", "block", 0)]
    got = {r["page_id"]: (r["rule"], r["action"]) for r in urlrules.judge_urls(df, spark.createDataFrame(made, "rule string, action string, tier int")).collect()}
    assert [got[i][0] for i in range(13)] == ["||example.com/en/", "||www.example.com/en/", None, None, None, "||spam-farm.", None, "||net/es/", None, "/casino/*/bonus^", None, "a+b(c)", "a+b(c)"]
    assert urlrules.judge_urls(df.where("page_id < 0"), spark.createDataFrame(made, "rule string, action string, tier int")).count() == 0
    found = spark.createDataFrame([("||a.b-c.",), ("x/y*z/",), ("/p^",)], "rule string").select(urlrules.rule_tokens(F.col("rule")).alias("t")).collect()
    assert [r["t"] for r in found] == [["a", "b", "c"], [], ["p"]]


def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    own = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = own[i], own[j]
                own = [min(a, b) if x in (a, b) else x for x in own]
    return {i + 1: (len(sets[i]), own[i] + 1) for i in range(len(texts))}


def near_texts():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for size, edits, copies in ((60, 4, 60), (30, 2, 40), (12, 1, 20), (200, 20, 25)):
        base = rng.choices(words, k=size)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(size)] = rng.choice(words)
            texts.append(" ".join(own))
    return texts + texts[-5:] + [" ".join(rng.choices(words, k=40)) for _ in range(40)]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    texts = near_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_odd_rows(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", None]).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    got = sorted(neardup.near_duplicates(df).collect(), key=str)
    assert {r["component_id"] for r in got if r["n_shingles"]} == {2}
    assert neardup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [0, 10**6])
def test_keep_one_goes_by_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(common, "BROADCAST_WIDE", limit)
    x, y, near = "a b c d e f g h i j k l m n o p q r s t", "totally other words stand here and there now", "a b c d e f g h i j k l m n o p q r s u"
    df = spark.createDataFrame([(3, x), (7, x), (7, y), (None, x), (None, x), (9, near), (5, None), (5, None), (6, "")], "doc_id long, text string").withColumns({"row_number": F.lit("mine"), "a.b": F.lit(1)})
    got = neardup.keep_one(df)
    assert got.columns == df.columns
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted([(3, x), (7, y), (5, None), (5, None), (6, "")], key=str)
    only_null = neardup.keep_one(df.where("doc_id is null")).collect()
    assert [(r[0], r[1]) for r in only_null] == [(None, x)]


def test_near_duplicates_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 3_000)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(2_500)]
    texts = []
    for _ in range(12):
        own = list(base)
        for _ in range(rng.choice([5, 60, 90, 200])):
            own[rng.randrange(2_500)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    own = list(range(300))
    for a, b in pairs:
        x, y = own[a], own[b]
        own = [min(x, y) if o in (x, y) else o for o in own]
    got = {r["node"]: r["component"] for r in neardup.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: own[n] for p in pairs if p[0] != p[1] for n in p}


def brute_alignment(a, b):
    best, m = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            m[i][j] = max(0, m[i - 1][j - 1] + (2 if x == y else -1), m[i - 1][j] - 1, m[i][j - 1] - 1)
            best = max(best, m[i][j])
    return best / (2 * len(a))


def test_alignment_equals_full_table():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(3, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 25)).astype(np.uint64)
        score, lo, hi = decontam.align(a, b)
        assert score == pytest.approx(brute_alignment(a.tolist(), b.tolist()))
        if score:
            assert brute_alignment(a.tolist(), b[lo:hi].tolist()) == pytest.approx(score)


def test_leaks(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(500)]
    items = [" ".join(rng.choices(words, k=n)) for n in (15, 30, 60, 20)] + [None, "", "two words"]
    noise = lambda n: " ".join(rng.choices(words, k=n))
    edited = items[2].split()
    for k in range(0, 60, 6):
        edited[k] = "changed"
    texts = [noise(80), f"{noise(30)} {items[0]} {noise(9)}", items[1].upper(), f"{noise(400)} {' '.join(edited)}", " ".join(items[3].split()[:4]), None, "", f"{items[0]} {noise(50)} {items[1]}"] + [f"{noise(5)} {items[1]}"] * 60
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("score", F.lit(1))
    want = {(2, 0), (3, 1), (4, 2), (8, 0), (8, 1)} | {(9 + k, 1) for k in range(60)}
    for block in (10**6, 40):  # one pass, and a pass for every few items
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs(spark, texts), bench).collect()} == want
    assert {r["doc_id"] for r in decontam.keep_clean(docs(spark, texts), bench).collect()} == {1, 5, 6, 7}
    assert decontam.keep_clean(docs(spark, texts), bench.limit(0)).count() == len(texts)
    assert decontam.find_leaks(empty(spark), bench).count() == 0


def test_leaks_of_an_edit_in_many_documents(spark):
    rng = random.Random(8)
    item = [f"w{k}" for k in range(40)]
    edited = [w if k % 4 else f"other{k}" for k, w in enumerate(item)]
    noise = [f"n{k}" for k in range(500)] + item[:6]
    texts = [" ".join([*rng.choices(noise, k=30), *edited, *rng.choices(noise, k=30)]) for _ in range(3000)]
    texts += [" ".join([*rng.choices(noise, k=30), *item[10:31], *rng.choices(noise, k=30)]) for _ in range(60)] + [" ".join(item)] * 5
    texts += [" ".join([*item[:4], *rng.choices(noise, k=60)]) for _ in range(100)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    index = decontam.index_words([bench.first()["text"].encode()])
    whole = decontam.word_codes(" ".join(item).encode(), index)
    want = {k + 1 for k, t in enumerate(texts) if decontam.align(whole, decontam.word_codes(t.encode(), index))[0] >= decontam.MIN_SCORE}
    assert want >= set(range(1, 3066))
    assert {r["doc_id"] for r in decontam.find_leaks(docs(spark, texts), bench).collect()} == want


def test_leaks_of_items_that_share_an_id(spark, monkeypatch):
    items = [(1, "a b c d e f"), (1, "g h i j k l"), (1, "a b c d e f"), (None, "m n o p q r"), (None, "s t u v w x"), (2, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["0 a b c d e f 0", "g h i j k l", "m n o p q r", "s t u v w x", "y z"]
    for block in (500_000, 5):
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        found = decontam.find_leaks(docs(spark, texts), bench).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (2, 1), (3, None), (4, None)]
        assert [r["doc_id"] for r in decontam.keep_clean(docs(spark, texts), bench).collect()] == [5]


def brute_leaks(texts, items):
    found = set()
    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        for k, item in items:
            own = (item or "").encode().lower().split()
            if 0 < len(own) < 3:
                held = any(words[j : j + len(own)] == own for j in range(len(words)))
            else:
                seeds = {tuple(own[j : j + 3]) for j in range(len(own) - 2)}
                near = len(own) >= decontam.SHORT or any(tuple(words[j : j + 3]) in seeds for j in range(len(words) - 2))
                held = near and brute_alignment(own, words) >= decontam.MIN_SCORE
            if held:
                found.add((i + 1, k))
    return found


@pytest.mark.parametrize("block", [10**6, 25])
def test_leaks_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    rng = random.Random(12)
    words = [f"v{i}" for i in range(40)]
    items = [(f"mmlu-{i % 9}", "\n".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 8, 20])))) for i in range(14)] + [(None, "v1 v2 v3 v4"), ("x", ""), ("y", " \n"), (None, None)]
    texts = [None, "", *[" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(40)]]
    for _, item in items[:14]:
        own = item.split()
        for k in range(0, len(own), 5):
            own[k] = "edit"
        texts.append(" ".join([*rng.choices(words, k=6), *own, *rng.choices(words, k=6)]))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.find_leaks(docs(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(texts, items)
    df = docs(spark, texts).withColumns({"leaks": F.lit("mine"), "item_id": F.lit(1), "a.b": F.lit(2)})
    kept = decontam.keep_clean(df, bench)
    assert kept.columns == df.columns and {r["leaks"] for r in kept.collect()} <= {"mine"}
    long_items = [x for x in items if len((x[1] or "").split()) >= 3]
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i + 1 for i in range(len(texts))} - {d for d, _ in brute_leaks(texts, long_items)}


EDITS = {
    "one put in after every second": lambda rng, w: [x for k, y in enumerate(w) for x in ([y, f"new{k}"] if k % 2 else [y])],
    "one put in after every third": lambda rng, w: [x for k, y in enumerate(w) for x in ([y, f"new{k}"] if k % 3 == 2 else [y])],
    "every third replaced": lambda rng, w: [f"new{k}" if k % 3 == 2 else y for k, y in enumerate(w)],
    "every third left out": lambda rng, w: [y for k, y in enumerate(w) if k % 3 != 2],
    "every fourth replaced": lambda rng, w: [f"new{k}" if k % 4 == 3 else y for k, y in enumerate(w)],
    "a quarter replaced": lambda rng, w: [f"new{k}" if rng.random() < 0.25 else y for k, y in enumerate(w)],
    "a third replaced": lambda rng, w: [f"new{k}" if rng.random() < 0.33 else y for k, y in enumerate(w)],
    "a fifth put in or left out": lambda rng, w: [x for k, y in enumerate(w) for x in rng.choice([[], [y, f"new{k}"]] + [[y]] * 8)],
    "the first half alone": lambda rng, w: w[: (len(w) + 1) // 2],
    "halves changed round": lambda rng, w: w[len(w) // 2 :] + w[: len(w) // 2],
}


def test_every_kind_of_edit_is_found(monkeypatch):
    """Against alignment of all items with all documents, without any seed."""
    rng = random.Random(31)
    words = [f"v{n}" for n in range(3000)] + ["the", "of", "and", "to"] * 150
    items = [" ".join(rng.choices(words, k=rng.randint(20, 60))).encode() for _ in range(60)]
    short, long = decontam.seeds_of_block(items)
    assert not any(seeds.items for seeds in short) and len(long.items) == 60
    for hits in (2_000_000, 50):
        monkeypatch.setattr(decontam, "HITS", hits)
        for name, edit in EDITS.items():
            texts = [" ".join([*rng.choices(words, k=30), *edit(rng, i.decode().split()), *rng.choices(words, k=30)]).encode() for i in items]
            codes = [decontam.word_codes(t, long.index) for t in texts]
            found = decontam.long_leaks(codes, long)
            n_aligned = 0
            for t, own in enumerate(codes):
                score, *_ = decontam.align(long.items[t], own)
                n_aligned += score >= decontam.MIN_SCORE
                assert (t in {x[0] for x in found[t]}) == (score >= decontam.MIN_SCORE), name
                assert all(x[1] == pytest.approx(score) for x in found[t] if x[0] == t)
            assert n_aligned > 20 or name in ("the first half alone",), name


def test_a_stem_that_many_items_share_costs_little():
    rng = random.Random(32)
    stem = "which of the following is".split()
    words = [f"v{n}" for n in range(20_000)]
    text = " ".join(rng.choices(words, k=400) + stem * 10).encode()
    sizes = {}
    for n in (100, 10_000):
        _, seeds = decontam.seeds_of_block([" ".join([*stem, *rng.choices(words, k=25)]).encode() for _ in range(n)])
        degree = np.diff(seeds.start)
        assert not degree[[seeds.index[w.encode()] for w in stem]].any()
        codes = decontam.word_codes(text, seeds.index)
        sizes[n] = int(degree[codes].sum())
    assert sizes[10_000] < 30 * len(text.split())  # a word is a seed of the few items that have it, never of all


def test_bound_of_alignment():
    rng = np.random.default_rng(5)
    for _ in range(300):
        item, stretch = rng.integers(1, 9, rng.integers(3, 20)), rng.integers(0, 12, rng.integers(0, 60))
        score = decontam.align(item, stretch)[0] * decontam.MATCH * len(item)
        assert decontam.can_reach(np.unique(item), stretch, score)


def brute_stats(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = {k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def brute_histograms(text, words):
    """Characters by class and words by place in `words`, all others last."""
    classes = [0] * len(textstats.CLASSES)
    for c in text or "":
        b = c.encode()[0]
        kind = next((k for k, yes in {"upper": "A" <= c <= "Z", "lower": "a" <= c <= "z", "digit": "0" <= c <= "9", "newline": c == "\n", "space": c in " \t\x0b\x0c\r", "symbol": c in "#*$%&|<>", "stop": c in ".,;:!?", "latin_ext": 0xC0 <= b < 0xE0, "wide": b >= 0xE0, "punctuation": 32 < b < 127}.items() if yes), "other")
        classes[textstats.CLASSES.index(kind)] += 1
    own = [plain(w) for w in (text or "").encode().split()]
    return classes, [*(own.count(w) for w in words), sum(w not in words for w in own)]


def plain(word):
    return word.lower().strip(bytes(b for b in range(33, 127) if not chr(b).isalnum()))


def brute_divergence(a, b):
    p, q = ([x / max(1, sum(v)) for x in v] for v in (a, b))
    m = [(x + y) / 2 for x, y in zip(p, q)]
    half = lambda v: sum(x * math.log2(x / z) for x, z in zip(v, m) if x > 0)
    return math.sqrt(max(0, (half(p) + half(q)) / 2))


@pytest.mark.parametrize("a_pass", [64, 1])
def test_quality_rules_equal_brute_force(spark, monkeypatch, a_pass):
    monkeypatch.setattr(rules, "LANGUAGES_A_PASS", a_pass)
    monkeypatch.setattr(rules, "FLUSH", 50)
    rng = random.Random(9)
    vocabulary = {"en": "the of and to in a is that it for was on water house garden évé running looked after bread small".split(), "fr": "le la les des et un une que pour dans maison jardin pain petit été courir".split()}
    texts, langs = list(ODD), ["en"] * len(ODD)
    for lang in ("en", "fr", "en", None):
        for _ in range(30):
            texts.append(" ".join(rng.choice(vocabulary[lang or "fr"]) for _ in range(rng.randint(40, 160))) + ".\nIt was.\nIt was.")
            langs.append(lang)
    junk = " ".join("#$%&" + rng.choice("abcdef") + rng.choice("xyz") + str(rng.random()) + "|<>*" for _ in range(120))
    texts += [junk, "a\nb\na\n\n\na", texts[20], junk]
    langs += ["en", "en", "en", "xx"]
    rows = [(i + 1, t, lang, "mine") for i, (t, lang) in enumerate(zip(texts, langs))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, verdict string")
    stats = [brute_stats(t) for t in texts]
    failed = [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in stats]
    refs = {}
    for lang in ("en", "fr", "xx"):
        df_of = Counter(w for t, x in zip(texts, langs) if x == lang for w in {plain(w) for w in (t or "").encode().split()} if w)
        signed = lambda w: int(np.uint64(words.normal_hash(w)).view(np.int64))
        common = [w for w, n in sorted(df_of.items(), key=lambda x: (-x[1], signed(x[0]))) if n >= rules.MIN_HELD][: rules.COMMON_OF_LANGUAGE]
        own = [brute_histograms(t, common) for t, x, f in zip(texts, langs, failed) if x == lang and not f]
        if common and own:
            refs[lang] = (common, *([sum(v) for v in zip(*(h[k] for h in own))] for k in (0, 1)))
    assert set(refs) == {"en", "fr"}
    got = {r["doc_id"]: r["v"] for r in rules.judge(df, ["doc_id"], name="v").collect()}
    kept = set()
    for i, t in enumerate(texts):
        r, n_chars, n_words = got[i + 1], len(t or ""), stats[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == stats[i], repr(t)[:40]
        assert r["base_failed"] == failed[i]
        far = []
        for common, classes, counts in refs.values():
            h = brute_histograms(t, common)
            far.append((brute_divergence(h[0], classes), brute_divergence(h[1], counts)))
        a, b = min(far, key=sum)
        assert (r["class_distance"], r["word_distance"]) == pytest.approx((a, b), abs=1e-9)
        chance = lambda k, n: math.sqrt(k / (8 * n * math.log(2))) if n else 0
        rejected = n_chars >= 200 and a > 0.25 + chance(len(classes), n_chars) or n_words >= 60 and b > 0.15 + chance(33, n_words)
        assert r["kept"] == (not failed[i] and not (rejected and langs[i] in (*refs, None)))
        kept |= {i + 1} if r["kept"] else set()
    assert len(kept) > 60 and len(texts) - 3 not in kept and len(texts) in kept  # the same junk in a language with a reference, and in one without
    good = rules.keep_good(df)
    assert good.columns == df.columns and {(r["doc_id"], r["verdict"]) for r in good.collect()} == {(k, "mine") for k in kept}
    assert rules.judge(df.where("doc_id < 0"), name="v").count() == 0
    assert [r["v"]["class_distance"] for r in rules.judge(docs(spark, ODD[:2]), ["doc_id"], name="v").collect()] == [None, None]


@pytest.mark.parametrize("a_pass", [64, 1])
def test_a_small_language_is_left_to_the_base_rules(spark, monkeypatch, a_pass):
    monkeypatch.setattr(rules, "LANGUAGES_A_PASS", a_pass)
    rng = random.Random(6)
    spoken = {lang: [f"{a}{b}{c}" for a in letters for b in "aeiou" for c in letters] for lang, letters in (("en", "bdgk"), ("fr", "lmnr"), ("qq", "xzŵŷ"))}
    rows = [(lang, " ".join(rng.choices(spoken[lang], k=150))) for lang, n in (("en", 30), ("fr", 30), ("qq", 4)) for _ in range(n)] + [("qq", "too short"), (None, " ".join(rng.choices(spoken["en"], k=150)))]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").withColumn("known_language", F.lit("mine"))
    kept = {r["doc_id"] for r in rules.keep_good(df).collect()}
    assert kept == {*range(64), 65}
    far = [r["v"]["word_distance"] for r in rules.judge(df.where("lang = 'qq'").union(df.where("lang <> 'qq'")), name="v").where("lang = 'qq'").collect()]
    assert max(x for x in far if x is not None) > 0.3  # foreign references would have rejected them


def left_over(spark, run):
    """Tables that `run` leaves in the shared folder."""
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = run().count()
    return rows, len({x for x in os.listdir(folder) if x.startswith("weft-")} - before)


@pytest.mark.parametrize("name", [*(n for n in queries.queries() if n.split("_")[0] in ("op3", "op6", "op10", "op11", "op12", "op13")), "pipeline"])
def test_only_the_result_is_left(spark, name):
    rows, left = left_over(spark, lambda: pipeline.run(spark, SF) if name == "pipeline" else queries.queries()[name](spark, SF))
    assert rows and left <= 1


def test_quality_rules_of_a_text_between_two_references(spark):
    texts = ["aa bb " * 30] * 6 + ["cc dd " * 30] * 6
    df = docs(spark, [" ".join(f"{w}" for w in t.split()) for t in texts]).withColumn("lang", F.when(F.col("doc_id") <= 6, "x").otherwise("y"))
    assert rules.judge(df).count() == 12  # all fail the base rules, so no language has a reference
    a, b = np.array([[[1.0, 1, 0]]]), np.array([[1.0, 0, 0], [0, 1, 0]])
    assert rules._distances(a, b)[0] == pytest.approx([rules._distances(a, b)[0][0]] * 2)


def test_divergence():
    d = rules._distances(np.array([[[1.0, 0]], [[1, 1]], [[0, 0]]]), np.array([[1.0, 0], [0, 1]]))
    assert d[0] == pytest.approx([0, 1]) and d[1] == pytest.approx([math.sqrt(0.311278)] * 2, abs=1e-4)


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_quality(d, l).join(l, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93
    odd = quality.score_quality(docs(spark, ODD), l.where("doc_id < 0")).collect()
    assert len(odd) == len(ODD) and all(r["score"] == 0.5 for r in odd)
    assert quality.score_quality(empty(spark), l).count() == 0


def brute_features(text):
    """The classifier's features in plain Python, by name."""
    text = text or ""
    words, n_chars = text.encode().split(), len(text)
    n = len(words)
    _, word_chars, n_symbols, n_dup_lines, n_repeat_words = brute_stats(text)
    n_lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n"))
    classes, common = brute_histograms(text, textstats.COMMON)
    of = dict(zip(textstats.CLASSES, classes))
    share = lambda a, b: a / max(b, 1)
    return {
        "log_words": math.log1p(n), "word_length": share(word_chars, n), "symbols": share(n_symbols, n), "pipes": share(text.count("|"), n), "exclaims": share(text.count("!"), n),
        "upper": share(of["upper"], of["upper"] + of["lower"]), "digits": share(of["digit"], n_chars), "stops": share(of["stop"], n), "other_marks": share(of["punctuation"], n_chars),
        "line_words": share(n, n_lines), "dup_lines": share(n_dup_lines, n_lines), "repeated": share(n_repeat_words, n), "distinct": share(len(set(words)), n), "common": share(n - common[-1], n),
    }


def test_quality_scores_equal_rules_applied_in_python(spark):
    sf = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn_quality(d, l)
    assert len(model.rules) > 1
    texts = ODD + [r["text"] for r in d.orderBy("doc_id").limit(150).collect()]
    got = {r["doc_id"]: r["score"] for r in quality.with_score(docs(spark, texts), model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        x = brute_features(t)
        total = model.intercept + sum(w for w, tests in model.rules if all((x[f] <= c) if at_most else (x[f] > c) for f, at_most, c in tests))
        assert got[i + 1] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9), repr(t)[:40]


def test_quality_filter_of_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs(spark, ODD, first=10**9).select("doc_id", "text")
    df = d.union(odd).union(odd).union(d.limit(3).selectExpr("null", "text")).withColumns({"score": F.lit("mine"), "stats": F.lit(1), "a.b": F.lit(2)})
    kept = quality.keep_good(df, l)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    scores = quality.with_score(df.select("doc_id", "text"), quality.learn_quality(df, l)).where("score >= 0.7").count()
    assert kept.count() == scores
    for none in (l.limit(0), l.withColumn("quality", F.lit(0)), l.withColumn("quality", F.lit(None).cast("int"))):
        assert quality.keep_good(df, none).count() == df.count()
    assert quality.keep_good(df.limit(0), l).count() == 0


def test_rule_paths():
    text = "Tree\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    assert quality.tree_rules(text, ["a", "b"]) == [[("a", True, 0.5)], [("a", True, 0.5), ("b", True, 2.0)], [("a", True, 0.5), ("b", False, 2.0)], [("a", False, 0.5)]]


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(d)
    got = langid.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    odd = {r["doc_id"]: r for r in langid.identify(docs(spark, [None, "", "123 !!", "中", "the cat"]), model).collect()}
    assert [odd[k]["lang_pred"] == "und" for k in range(1, 6)] == [True, True, True, False, False]
    none = langid.fit_languages(empty(spark))
    assert [r["lang_pred"] for r in langid.identify(docs(spark, ["the cat"]), none).collect()] == ["und"]
    three = docs(spark, ["der die das und"] * 20 + ["il la gli che"] * 20 + ["и в на что"] * 20).withColumn("lang", F.when(F.col("doc_id") <= 20, "de").when(F.col("doc_id") <= 40, "it").otherwise("ru"))
    m = langid.fit_languages(three)
    assert [r["lang_pred"] for r in langid.identify(docs(spark, ["und die", "che la", "что на"]), m).orderBy("doc_id").collect()] == ["de", "it", "ru"]


def test_languages_equal_votes_in_python(spark):
    """Families by the largest margin, then votes and margins of the pairs inside, in plain Python on the given weights."""
    rng = np.random.default_rng(5)
    langs = ["de", "en", "fr", "nl", "ru"]
    families = sorted({langid.family(x) for x in langs})
    plane = lambda: (rng.normal(size=langid.DIMS) / 20, float(rng.normal()))
    pairs = [(a, b) for i, a in enumerate(langs) for b in langs[i + 1 :] if langid.family(a) == langid.family(b)]
    model = {"langs": langs, "families": families, "ovr": [(f, *plane()) for f in families], "pairs": [(a, b, *plane()) for a, b in pairs]}
    texts = [t for t in ODD if t] + ["".join(rng.choice(list("abc defé .\nZ"), size=80)) for _ in range(60)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t):
            assert got[i + 1] == ("und", 0.0)
            continue
        plain_text = " " + " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in t.lower() if True).split()) + " "
        x = bytes(ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in plain_text).decode() if plain_text.isascii() else None
        shares = np.zeros(langid.DIMS)
        raw = x.encode() if x is not None else b" " + b" ".join(t.encode().translate(langid._LETTERS).split()) + b" "
        for k in range(len(raw)):
            shares[raw[k]] += 1
            if k + 1 < len(raw):
                two = raw[k] * 257 + raw[k + 1]
                shares[(two * 2246822519 & 0xFFFFFFFF) >> 21] += 1
            if k + 2 < len(raw):
                shares[((two * 257 + raw[k + 2]) * 2654435761 & 0xFFFFFFFF) >> 21] += 1
        shares *= 100 / len(raw)
        margin = lambda plane: float(shares @ plane[-2] + plane[-1])
        best = max(model["ovr"], key=margin)
        inside = [a for a in langs if langid.family(a) == best[0]]
        sure = margin(best)
        if len(inside) > 1:
            votes = {a: [0, 0.0] for a in inside}
            for p in model["pairs"]:
                if p[0] in inside:
                    m = margin(p)
                    votes[p[0] if m > 0 else p[1]][0] += 1
                    votes[p[0]][1] += m
                    votes[p[1]][1] -= m
            inside.sort(key=lambda a: votes[a])
            sure = min(sure, votes[inside[-1]][1] / (len(inside) - 1))
        assert got[i + 1][0] == inside[-1], repr(t)[:40]
        assert got[i + 1][1] == pytest.approx(1 / (1 + math.exp(-2 * max(-20, min(20, sure)))), abs=1e-4)


def brute_ppm(counts, text, order):
    """Plain escape chain: counts[context] is a Counter of symbols."""
    data, total = bytes([ppm.BEFORE]) * order + text + bytes([ppm.END]), 0.0
    for i in range(order, len(data)):
        x, out, k = data[i], set(), order
        while k >= 0 and data[i - k : i] not in counts:
            k -= 1
        while True:
            c = {s: n for s, n in counts.get(data[i - k : i], {}).items() if s not in out} if k >= 0 else None
            if c is None:
                total -= math.log10(255 - len(out))
                break
            d = len(c)
            if x in c:
                total += math.log10(c[x] / (sum(c.values()) + d))
                break
            if d:
                total += math.log10(d / (sum(c.values()) + d))
                out |= set(c)
            k -= 1
    return total


@pytest.mark.parametrize("hot", [3, 10**6])
def test_lm_scores_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT_TOKENS", hot)
    texts = ODD + ["The cat The dog", "the cat", "unseen words here", "the cat"] * 6
    held = {i + 1: zlib.crc32(str(i + 1).encode()) % 10 == 0 for i in range(len(texts))}
    words = [[*(t or "").encode().lower().split(), b"\x00end"] for t in texts]
    c = Counter(w for i, ws in enumerate(words) if not held[i + 1] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in ppm.score(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, ws in enumerate(words):
        r = got[i + 1]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i + 1], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r["score"] < 0
    assert ppm.score(empty(spark)).count() == 0


@pytest.mark.parametrize("chunk, held", [(40, 5), (40, 10**6), (10**7, 10**6)])
def test_lm_keeps_every_context(spark, monkeypatch, chunk, held):
    monkeypatch.setattr(ppm, "CHUNK", chunk)
    monkeypatch.setattr(ppm, "HELD_GRAMS", held)
    rng = random.Random(3)
    texts = [t for t in ODD if len(t or "") < 1000] + ["the cat sat on the mat", "the hat", "zebra"] * 3
    texts += [" ".join("".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 20))) for _ in range(60)]
    order, counts = ppm.ORDER, {}
    for i, t in enumerate(texts):
        if zlib.crc32(str(i + 1).encode()) % 10:
            data = bytes([ppm.BEFORE]) * order + (t or "").encode().lower() + bytes([ppm.END])
            for j in range(order, len(data)):
                for k in range(order + 1):
                    counts.setdefault(data[j - k : j], Counter())[data[j]] += 1
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i + 1] == pytest.approx(brute_ppm(counts, (t or "").encode().lower(), order), abs=1e-4, rel=1e-5), t


def test_lm_values_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(5)
    grams = np.unique(ppm._full(np.int64(0x6162), rng.integers(0, 4, (3000, 4)) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])))
    n = rng.integers(0, 3, len(grams))
    low = np.zeros((256, 256), np.int64)
    low[0x62, :4], low[0x63, :6] = np.bincount(grams & 255, n, 256)[:4] + 1, 7
    whole = ppm.gram_values(grams, n, low)
    monkeypatch.setattr(ppm, "SLICE_GRAMS", 1)
    assert np.array_equal(ppm.gram_values(grams, n, low), whole) and (whole < 0).all()


def test_stats_cover_columns():
    counts, classes, common = (x[0] for x in textstats.measure(["The The the, é\n|".encode()], textstats.COMMON_HASHES))
    assert len(counts) == len(textstats.COUNTS) and classes.sum() == 16 and common[textstats.COMMON.index(b"the")] == 3 and common.sum() == 5


def test_stats_of_many_texts_are_those_of_each():
    rng = random.Random(3)
    texts = [(t or "").encode() for t in ODD] + [" ".join(rng.choices(["the", "a", "b\n", "ß", "|"], k=rng.randint(0, 30))).encode() for _ in range(244)]
    together, alone = textstats.measure(texts, textstats.COMMON_HASHES), [textstats.measure([t], textstats.COMMON_HASHES) for t in texts]
    assert len(texts) == 256 and all((x == np.concatenate([a[k] for a in alone])).all() for k, x in enumerate(together))


def test_word_hashes_are_those_of_the_words():
    rng = random.Random(7)
    texts = [(t or "").encode() for t in ODD] + ["".join(rng.choices("aAbB,.\n \t\x0bé'-x", k=rng.randint(0, 60))).encode() for _ in range(300)]
    found = words.Words(texts)
    assert found.n_words.tolist() == [len(t.split()) for t in texts]
    for kind, change in ((found.hashes(), bytes), (found.hashes(lower=True), bytes.lower), (found.normal_hashes(), plain)):
        seen = {}
        for h, w in zip(kind.tolist(), (change(w) for t in texts for w in t.split())):
            assert seen.setdefault(h, w) == w
        assert len(set(seen.values())) == len(seen)


def test_memo_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(common, "MEMO_BYTES", 10_000)
    memo = common.Memo(len)
    for k in range(3_000):
        assert memo["x" * (k % 1200)] == k % 1200 and sum(150 + 4 * len(w) for w in memo) <= 5_000 and sum(150 + 4 * len(w) for w in memo.before) <= 5_000


def test_stored_needs_a_shared_folder_on_a_cluster():
    class Session:
        conf = type("Conf", (), {"get": lambda self, key, default: default})()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})()

    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Session)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    columns = kept.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, kept = kept, common.stored(stage(spark, kept, sf))
        if k < 4:
            assert kept.columns == columns and 0 < kept.count() <= before.count(), name
        if name == "benchmark_decontamination":
            assert decontam.find_leaks(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
            last = kept
        if name == "near_dedup":
            near = neardup.near_duplicates(kept)
            assert near.where("not kept").count() == 0
    assert {r["doc_id"] for r in kept.select("doc_id").distinct().collect()} == {r["doc_id"] for r in last.select("doc_id").collect()}
    run = corpus_pipeline.run(spark, sf)
    assert run.count() == kept.count()
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def brute_rules(texts, langs):
    """Places of the texts that pass the quality rules."""
    stats = [brute_stats(t) for t in texts]
    failed = [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in stats]
    refs = {}
    for lang in sorted({x for x in langs if x is not None}):
        held = Counter(w for t, x in zip(texts, langs) if x == lang for w in {plain(w) for w in (t or "").encode().split()} if w)
        signed = lambda w: int(np.uint64(words.normal_hash(w)).view(np.int64))
        common = [w for w, n in sorted(held.items(), key=lambda x: (-x[1], signed(x[0]))) if n >= rules.MIN_HELD][: rules.COMMON_OF_LANGUAGE]
        own = [brute_histograms(t, common) for t, x, f in zip(texts, langs, failed) if x == lang and not f]
        if common and own:
            refs[lang] = (common, *([sum(v) for v in zip(*(h[k] for h in own))] for k in (0, 1)))
    kept = set()
    for i, t in enumerate(texts):
        n_chars, n_words, a, b = len(t or ""), stats[i][0], 0, 0
        if refs and langs[i] in (*refs, None):
            far = [(brute_divergence(h[0], classes), brute_divergence(h[1], counts)) for common, classes, counts in refs.values() for h in [brute_histograms(t, common)]]
            a, b = min(far, key=sum)
        chance = lambda k, n: math.sqrt(k / (8 * n * math.log(2))) if n else 0
        rejected = n_chars >= 200 and a > 0.25 + chance(len(textstats.CLASSES), n_chars) or n_words >= 60 and b > 0.15 + chance(33, n_words)
        kept |= set() if failed[i] or rejected else {i}
    return kept


def test_pipeline_equals_brute_force(spark, library, tmp_path):
    """Each stage against a plain Python version on its own input, over a table of 500 rows."""
    sf, small = "/root/testdata/sf0.01", str(tmp_path)
    spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(500).write.parquet(f"{small}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{small}/benchmark.parquet")
    # Labels of which enough are left after the first stage: long texts are the good ones.
    spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0").selectExpr("doc_id", "CAST(size(split(text, ' ')) > 150 AS INT) AS quality").write.parquet(f"{small}/labels.parquet")
    labels, items = spark.read.parquet(f"{small}/labels.parquet"), [r["text"].encode() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    index = decontam.index_words(items)
    codes = [decontam.word_codes(t, index) for t in items]

    def expected(name, docs, texts, langs):
        if name == "quality_rules":
            return brute_rules(texts, langs)
        if name == "quality_classifier":
            model = quality.learn_quality(docs, labels)
            assert model.rules
            total = lambda x: model.intercept + sum(w for w, tests in model.rules if all((x[f] <= c) if at_most else (x[f] > c) for f, at_most, c in tests))
            return {i for i, t in enumerate(texts) if 1 / (1 + math.exp(-total(brute_features(t)))) >= 0.7}
        if name == "near_dedup":
            return {i - 1 for i, (_, own) in brute_components(texts).items() if own == i}
        found = [decontam.align_many(codes, [decontam.word_codes(t.encode(), index)] * len(codes)) for t in texts]
        return {i for i, scores in enumerate(found) if max(s[0] for s in scores) < decontam.MIN_SCORE}

    kept, sizes = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in pipeline.STAGES[:4]:
        rows = kept.select("doc_id", "text", "lang").orderBy("doc_id").collect()
        want = expected(name, kept, [r["text"] for r in rows], [r["lang"] for r in rows])
        kept = common.stored(stage(spark, kept, small))
        assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {rows[i]["doc_id"] for i in want}, name
        sizes.append((len(rows), len(want)))
    assert all(a > b > 0 for a, b in sizes)  # every stage had something to do
    texts = [r["text"] for r in kept.collect()]
    lengths = [n for t in texts for ids in [len(library.encode(t or "", add_special_tokens=False).ids) + 1] for n in [2048] * (ids // 2048) + [ids % 2048] * (ids % 2048 > 0)]
    by_sequence = {}
    for r in pipeline.run(spark, small).collect():
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert Counter(tuple(sorted(x)) for x in by_sequence.values()) == brute_packing(lengths, 2048)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_odd_rows(spark, name):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, columns of clashing names."""
    stage = dict(pipeline.STAGES)[name]
    good = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    rows = [(i % 9 if i % 5 else None, t, None if i % 3 else "en", None, None) for i, t in enumerate([*ODD, *good, *ODD, *good])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    df = df.withColumns({c: F.lit("mine") for c in ("verdict", "score", "row_number", "leaks", "stats", "piece", "id", "chunk", "set_key", "a.b")})
    got = stage(spark, df, SF)
    none = stage(spark, df.where("doc_id < -1"), SF)
    assert none.count() == 0
    if name == "best_fit_packing":
        assert got.where("piece = 0").count() == len(rows)
    else:
        assert got.schema.names == df.columns and none.columns == df.columns and 0 < got.count() <= len(rows)
        assert {r["verdict"] for r in got.select("verdict").collect()} == {"mine"}
        assert Counter(got.select("text").toPandas()["text"]) <= Counter(df.select("text").toPandas()["text"])
