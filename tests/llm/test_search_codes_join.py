"""Lexical search, vector codes and the Jaccard join against brute force in plain Python, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import common, jaccardjoin, lexical, queries, vectorcodes

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "one", "two words", "a b c d e", "A b C d E", "a b c d e", "naïve 中文 ﬁ É İ", "x" * 5_000, "w " * 3_000, "?!-- ..."]
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_ranked_lexical_search", "op12_vector_code_compression", "op13_ngram_jaccard_join"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns) and sorted(got[cols].itertuples(index=False, name=None)) == sorted(want[cols].itertuples(index=False, name=None))


def brute_search(docs, items, k):
    words = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    held = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in dict.fromkeys(x for x in items if x[1] is not None):
        asked, scores = Counter(TERM.findall(text.translate(LOWER))), []
        for doc_id, own in words:
            tf, score = Counter(own), 0
            m = 25 + 75 * len(own) * n_docs // max(1, n_terms)
            for term, times in asked.items():
                if tf[term]:
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[term] + 1))) * (10**9 * tf[term] // (1000 * tf[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "cells", "share"), [(4_000_000, 1_000_000, 1 / 32), (40, 60, 0.5), (4_000_000, 40, 1.0)])
def test_search_equals_brute_force(spark, monkeypatch, block, cells, share):
    for name, value in (("BLOCK_BYTES", block), ("CELLS", cells), ("HEAD_SHARE", share)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(7)
    pool = [f"{c}{n}" for c in "abcde" for n in range(12)] + ["é", "中文", "the"] * 3
    texts = ODD + [rng.choice([" ", "-", ", "]).join(rng.choices(pool, k=rng.choice([1, 5, 30, 200]))) for _ in range(90)]
    texts += [texts[20].upper()] * 14  # more copies than places
    rows = [(None if i == 25 else i % 110, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 3, 12])))) for i in range(8)] + [(3, "a1 a1 b2"), (3, "a1 a1 b2"), (None, "c3 THE d4"), (90, None), (91, " - "), (92, "absent"), (93, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ask", "score", "rank", "n", "m", "terms", "item_id")}).repartition(5)
    got = lexical.search(docs, spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(2)), 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, items, 10)


def test_search_of_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", None)], "key string, body string")
    items = spark.createDataFrame([("q", "x"), ("r", "z")], "item_id string, text string")
    got = lexical.search(docs, items, 3, "key", "body").orderBy("rank").collect()
    assert [r["key"] for r in got] == ["a", "b", None] and {r["item_id"] for r in got} == {"q"}
    assert lexical.search(docs.where("false"), items, 3, "key", "body").count() == 0
    assert lexical.search(docs, items.where("false"), 3, "key", "body").count() == 0


def test_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    weights = rng.integers(0, 5_000, 40)
    items = lexical.Items([Counter(dict(zip(rng.integers(0, 40, 12).tolist(), rng.integers(1, 3, 12).tolist()))) for _ in range(6)], weights)
    impacts = rng.integers(0, 900_000, (400, 40)) * (rng.random((400, 40)) < 0.3)
    lengths = np.sqrt(((impacts * items.root) ** 2).sum(axis=1))
    order = np.argsort(-lengths)
    ranking = lexical.Ranking(items, 5, np.ones(6, np.int64))
    for at in range(0, 400, 50):
        some = order[at : at + 50]
        ranking.meet(some.tolist(), impacts[some], lengths[some])
    for own, rows in zip(items.parts, ranking.rows):
        scores = impacts[:, own[0]] @ own[1]
        assert rows == sorted(((int(s), i) for i, s in enumerate(scores) if s > 0), key=lambda r: (-r[0], r[1]))[:5]
    assert ranking.scored < 0.7 * 6 * 400


def brute_codes(rows, n_parts, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and len(v) == max(len(u or []) for _, u, _ in rows) and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // n_parts
    ids = sorted({i for i, *_ in kept if i is not None})[:entries]
    first = [min(v for j, v, _ in kept if j == i) for i in ids]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for v in first] for p in range(n_parts)]
    near = lambda v, p: min((apart(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(n_parts):
            by = {}
            for _, v, _ in kept:
                by.setdefault(near(v, p)[1], []).append(cut(v, p))
            for k, own in by.items():
                new[p][k] = [sum(c) // len(own) for c in zip(*own)]
        books = new
    found = [[near(v, p) for p in range(n_parts)] for _, v, _ in kept]
    errors = Counter()
    for (_, _, label), f in zip(kept, found):
        errors[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, label, [k for _, k in f], sum(d for d, _ in f), errors[label], digest) for (i, _, label), f in zip(kept, found)), key=str)


@pytest.mark.parametrize(("memo", "wide", "reach"), [(16_000_000, 50_000, 4.0), (400, 0, 0.5)])
def test_codes_equal_brute_force(spark, monkeypatch, memo, wide, reach):
    monkeypatch.setattr(common, "MEMO_BYTES", memo)
    monkeypatch.setattr(vectorcodes, "BROADCAST_WIDE", wide)
    monkeypatch.setattr(vectorcodes, "REACH", reach)
    rng = random.Random(11)
    vectors = [[rng.gauss(0, 0.2) for _ in range(8)] for _ in range(120)]
    rows = [(i if i != 30 else None, v, rng.choice([0, 1, None])) for i, v in enumerate(vectors, 5)]
    rows += [(500 + i, vectors[3], 1) for i in range(40)]  # copies, ties
    rows += [(5, vectors[9], 7), (5, vectors[0], 7), (1, None, 1), (2, [0.1] * 7 + [None], 1), (3, [math.nan] * 8, 1), (4, [0.1] * 7 + [math.inf], 1), (0, [0.1] * 4, 1), (-1, [], 1), (700, [90.0, -90.0] * 4, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "numbers", "vector", "codes", "error", "n", "same")}).repartition(3)
    got = vectorcodes.compress(df, n_parts=2, entries=12, rounds=4)
    assert got.columns == ["vec_id", "label", "codes", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_codes(rows, 2, 12, 4)


def test_codes_of_few_and_odd_tables(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25], 3), (2, [0.5, 0.25], None)], "vec_id long, embedding array<float>, label int")
    got = vectorcodes.compress(df, n_parts=2).orderBy("vec_id").collect()
    assert [r["codes"] for r in got] == [[0, 0], [0, 0]] and [r["error"] for r in got] == [0, 0]
    assert vectorcodes.compress(df.where("false"), n_parts=2).count() == 0
    assert vectorcodes.compress(df.withColumn("vec_id", F.lit(None).cast("long")), n_parts=2).count() == 0
    with pytest.raises(ValueError, match="cut into"):
        vectorcodes.compress(df, n_parts=4).count()
    with pytest.raises(ValueError, match="less than"):
        vectorcodes.compress(df.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(1e9).cast("float"))), n_parts=2).count()


def test_decoded_vectors_are_their_entries(spark):
    books = np.arange(12).reshape(2, 3, 2) * 512
    got = vectorcodes.decode(spark.createDataFrame([([2, 0],)], "codes array<int>"), books).first()
    assert got["vector"] == [2.0, 2.5, 3.0, 3.5]


def test_cells_leave_dominated_entries_out():
    rng = np.random.default_rng(5)
    parts, book = rng.integers(-400, 400, (300, 4)), rng.integers(-300, 300, (64, 4))
    cells = vectorcodes.Cells(book, vectorcodes.Grid(-320, 40))
    apart = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    for _ in range(2):  # the second time from the memo
        best, least = cells.nearest(parts)
        assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()
    inside = ((parts >= -320) & (parts < 320)).all(axis=1)
    sizes = np.array([*map(len, cells.candidates(parts))])
    assert sizes[inside].mean() < 20 and (sizes[~inside] == 64).all()


def brute_join(rows, percent):
    def shingle_set(text):
        w = (text or "").translate(LOWER)
        w = re.findall("[^\x20\x09-\x0d]+", w)
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    sets = [shingle_set(t) for _, t in rows]
    up, links = list(range(len(rows))), Counter()

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(top(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in classes.items()}
    return sorted(((rows[i][0], len(sets[i]), least[top(i)], links[i]) for i in range(len(rows))), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def family_rows(rng):
    base = [f"b{rng.randrange(3000)}" for _ in range(60)]
    texts = ODD + ["one", "Two  Words"]
    for _ in range(12):
        words = base[:20] + [f"v{rng.randrange(4000)}" for _ in range(rng.choice([8, 40, 90]))]  # a passage that all share
        texts += [edited(rng, words, rng.randrange(3)) for _ in range(rng.randrange(1, 9))]
    texts += [" ".join(base)] * 5 + [" ".join(base[:k]) for k in range(40, 60, 2)]  # chains at and around the threshold
    rng.shuffle(texts)
    return [(None if i == 7 else i // 2 * 2 if i % 9 == 0 else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("block", "asking", "few", "frequent"), [(400_000, 4_096, 50_000, 8), (150, 3, 0, 2)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block, asking, few, frequent):
    for name, value in (("BLOCK_SHINGLES", block), ("ASKING", asking), ("FREQUENT", frequent)):
        monkeypatch.setattr(jaccardjoin, name, value)
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    monkeypatch.setattr(common, "BROADCAST_WIDE", few)
    rows = family_rows(random.Random(block))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row_id", "node", "gid", "n", "copies", "token", "set_key", "least")}).repartition(4)
    got = jaccardjoin.jaccard_join(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_join(rows, 80)


def test_jaccard_join_of_an_empty_table_and_text_ids(spark):
    df = spark.createDataFrame([("b", "a b c d e f"), ("a", "A b c d e  f"), ("c", None)], "key string, body string")
    assert jaccardjoin.jaccard_join(df.where("false"), id_col="key", text_col="body").count() == 0
    got = jaccardjoin.jaccard_join(df, id_col="key", text_col="body").orderBy("key").collect()
    assert [tuple(r) for r in got] == [("a", 2, "a", 1), ("b", 2, "a", 1), ("c", 0, "c", 0)]


def test_first_shingles_meet_whatever_the_order(monkeypatch):
    rng = np.random.default_rng(2)
    for percent in (50, 75, 80, 95):
        for _ in range(300):
            n = int(rng.integers(1, 40))
            a = np.unique(rng.integers(1, 60, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(1, 60, int(rng.integers(0, 4))).astype(np.uint64)]))
            big, small = sorted([a, b], key=len, reverse=True)
            shared = len(np.intersect1d(a, b))
            if not len(small) or not shared * 100 >= (len(a) + len(b) - shared) * percent:
                continue
            frequent = (np.arange(1, 60, 3, dtype=np.uint64), rng.integers(8, 30, 20))
            first = jaccardjoin.first_shingles(big, frequent, percent)
            stored = jaccardjoin.first_shingles(small, frequent, percent)[: jaccardjoin.index_length(len(small), percent)]
            assert len(np.intersect1d(first, stored))


def test_a_closed_group_answers_nothing():
    group = jaccardjoin.Group(np.array([1, 2]), np.array([3, 3]), np.array([1, 4]), np.array([1, 2, 3, 1, 2, 9]), 80)
    assert group.ask(5, 5, 1, np.array([1, 2, 20, 21, 22])) == (0, [])
    assert group.ask(6, 3, 2, np.array([1, 2, 9])) == (4, [2]) and group.links.tolist() == [0, 2]
