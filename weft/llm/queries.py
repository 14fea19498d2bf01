"""Registered queries of the training-data operators: thin digests over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.chat import format_turns, read_back
from weft.llm.common import table
from weft.llm.decontam import find_leaks
from weft.llm.jaccardjoin import jaccard_join
from weft.llm.langid import fit_languages, identify
from weft.llm.lexical import search
from weft.llm.neardup import near_duplicates
from weft.llm.packing import pack
from weft.llm.ppm import score
from weft.llm.quality import score_quality
from weft.llm.rules import judge
from weft.llm.tokens import count_tokens
from weft.llm.urlrules import judge_urls
from weft.llm.vectorcodes import compress

#: Vocabulary of token counts and packing.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: URL rules: those of tier 1 decide where they fit; tier 0 are patterns for the rest (fixed values).
HOST_RULES = [("||com/", "allow"), ("||example.com/en/", "block"), ("||www.example.com/en/", "allow"), ("||net/es/", "block"), ("||net/fr/", "block")]
PATTERN_RULES = ["||spam-farm.", "||cheap-pills.", "||casino-win.", "||ads-track.", "||free-bets.", "||adult-x.", "/casino/*/bonus^", "||porn."]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit_languages(docs))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, 2048)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, 2048)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(turns.unionByName(probe)))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(r, a, 1) for r, a in HOST_RULES] + [(r, "block", 0) for r in PATTERN_RULES], "rule string, action string, tier int")
    judged = judge_urls(table(spark, sf_dir, "pages"), rules)
    rule = F.when(F.col("tier") == 1, F.replace(F.col("rule"), F.lit("||"), F.lit("")))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("action", F.lit("allow")).alias("verdict"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    digest = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    return judge(docs, ["doc_id"]).select("doc_id", *[f"verdict.{c}" for c in digest])


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = compress(table(spark, sf_dir, "embeddings"))
    code = F.concat(*[F.lower(F.lpad(F.hex(F.col("codes")[p]), 2, "0")) for p in range(4)])
    return coded.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked AS (
  SELECT *, len(regexp_extract_all(text, '<\\*\|im_(start|end)\|>')) AS n_control FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(text) + n_control + 10 + 1) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

URL_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
judged AS (
  SELECT *, CASE
    WHEN regexp_matches(host, '(^|\.)www\.example\.com$') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN regexp_matches(host, '(^|\.)example\.com$') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '^([^/]*\.)?(spam-farm|cheap-pills|casino-win|ads-track|free-bets|adult-x|porn)\.') THEN 'block'
  WHEN regexp_matches(host || path, '/casino/.*/bonus([^A-Za-z0-9_.%-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_LINKS_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
"""

NEAR_DEDUP_SQL = f"""{_LINKS_SQL.replace("{percent}", "75")}
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.b, s.doc_id)) AS kept
FROM sets s LEFT JOIN least l ON l.a = s.doc_id
"""

JACCARD_SQL = f"""{_LINKS_SQL.replace("{percent}", "80")}, partners AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id, coalesce(p.n, 0) AS n_links
FROM sets s LEFT JOIN least l ON l.a = s.doc_id LEFT JOIN partners p ON p.a = s.doc_id
"""

TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS terms FROM documents),
docs AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM texts WHERE len(terms) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
asked AS (SELECT item_id, unnest({TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
held AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, total GROUP BY term, n_docs),
scores AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM wanted JOIN held USING (term) JOIN weights USING (term), total GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""


def _codes_sql(n_parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Rounds as chained tables; squared distances of integers are exact in doubles."""
    steps = [
        "vec AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings\n"
        "  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"part AS (SELECT vec_id, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM vec, (SELECT unnest(range({n_parts})) AS p))",
        f"book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM part WHERE vec_id IN (SELECT vec_id FROM vec ORDER BY vec_id LIMIT {entries}))",
    ]
    apart = "list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v)"
    for r in range(rounds + 1):
        steps.append(f"near{r} AS (SELECT vec_id, p, min(d) AS d, arg_min(e, d * {entries} + e) AS e FROM (SELECT a.vec_id, a.p, b.e, {apart} AS d FROM part a JOIN book{r} b USING (p)) GROUP BY vec_id, p)")
        if r < rounds:
            means = ", ".join(f"floor(sum(v[{j + 1}]) / count(*))" for j in range(width))
            steps.append(f"mean{r} AS (SELECT p, e, [{means}] AS v FROM part JOIN near{r} USING (vec_id, p) GROUP BY p, e)")
            steps.append(f"book{r + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e)")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)")
    steps.append("sums AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN vec USING (vec_id) GROUP BY label)")
    steps.append(f"hash AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, label_error, codebooks_sha256 FROM coded JOIN vec USING (vec_id) JOIN sums ON vec.label IS NOT DISTINCT FROM sums.label, hash"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_language_id, op2_token_counts, op3_best_fit_packing, op4_chat_formatting, op5_url_filters,
        op6_minhash_near_dedup, op7_benchmark_decontamination, op8_quality_classifier, op9_quality_rules, op10_lm_scoring,
        op11_ranked_lexical_search, op12_vector_code_compression, op13_ngram_jaccard_join,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": CHAT_SQL, "op5_url_filters": URL_SQL, "op6_minhash_near_dedup": NEAR_DEDUP_SQL, "op11_ranked_lexical_search": SEARCH_SQL, "op12_vector_code_compression": _codes_sql(), "op13_ngram_jaccard_join": JACCARD_SQL}
