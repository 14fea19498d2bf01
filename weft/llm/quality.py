"""Quality classifier: a sparse ensemble of rules, compiled into one Spark column.

Shallow trees (a random forest) are grown on ratios of text statistics; every path
from a root to a node is a rule, a conjunction of threshold tests.  A lasso logistic
regression over the rules keeps a few of them, and the score of a document is the
logistic of their weights, as a plain column expression over its statistics.

Learns from the documents of at most about `TRAIN_ROWS` labelled ids (an even sample by
a hash of the id), all ids outside the held-out fold if there are fewer.  If these hold
one label only, the score is that label's share; if there are none, it is 0.5; in either
case nothing was learned that tells documents apart, and `keep_good` rejects none.  A
document with several labels counts as good only if all say so.  Null and empty texts
have all statistics 0 and are scored like others; repeated rows are scored each; a null
id is in no fold and has no label; other columns pass through, whatever their names.

Texts are read twice and never shuffled: the labelled ones to learn from, whose ids are
broadcast, and all of them to be scored where they lie.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import any_names, free_name, hash_mod, scratch
from weft.llm.textstats import CLASSES, text_stats

#: Labelled rows to learn from, trees and their depth, lasso strength.
TRAIN_ROWS, TREES, DEPTH, LASSO = 20_000, 12, 3, 0.002
HELD_OUT = (4, 2)


def features(stats: Column) -> dict[str, Column]:
    """The struct of text_stats() as ratios that do not depend on the length."""
    c, of = lambda name: stats[name], lambda name: stats["classes"][CLASSES.index(name)]
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    return {
        "log_words": F.log1p(c("n_words")),
        "word_length": share(c("word_chars"), c("n_words")),
        "symbols": share(c("n_symbols"), c("n_words")),
        "pipes": share(c("n_pipes"), c("n_words")),
        "exclaims": share(c("n_exclaim"), c("n_words")),
        "upper": share(of("upper"), of("upper") + of("lower")),
        "digits": share(of("digit"), c("n_chars")),
        "stops": share(of("stop"), c("n_words")),
        "other_marks": share(of("punctuation"), c("n_chars")),
        "line_words": share(c("n_words"), c("n_lines")),
        "dup_lines": share(c("n_dup_lines"), c("n_lines")),
        "repeated": share(c("n_repeat_words"), c("n_words")),
        "distinct": share(c("n_distinct_words"), c("n_words")),
        "common": share(c("n_words") - F.element_at(c("common"), -1), c("n_words")),
    }


@dataclass
class RuleModel:
    """intercept, and (weight, tests) for each rule; a test is (feature, at most?, threshold)."""

    intercept: float
    rules: list[tuple[float, list[tuple[str, bool, float]]]]

    def score(self, values: Column) -> Column:
        """The score as a column over a struct of the features."""
        total = F.lit(float(self.intercept))
        for weight, tests in self.rules:
            total = total + F.when(rule_column(tests, values), F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def rule_column(tests: list[tuple[str, bool, float]], values: Column | None = None) -> Column:
    """Whether all tests hold, for features in a struct or, without one, in columns of their own."""
    held = F.lit(True)
    for name, at_most, threshold in tests:
        value = F.col(name) if values is None else values[name]
        held = held & ((value <= threshold) if at_most else (value > threshold))
    return held


def tree_rules(debug: str, names: list[str]) -> list[list[tuple[str, bool, float]]]:
    """Every path of a tree, from the text that MLlib prints for it."""
    found, path = [], []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if m:
            path = [x for x in path if x[0] < len(m[1])] + [(len(m[1]), (names[int(m[2])], m[3] == "<=", float(m[4])))]
            found.append([x[1] for x in path])
    return found


def fit_rules(rows: DataFrame, names: list[str], seed: int = 7) -> RuleModel:
    """Fit on `rows` (the features `names` and label int)."""
    shares = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(shares.values())
    if len(shares) < 2:
        p = min(max(shares.get(1, 0) / n if n else 0.5, 1e-3), 1 - 1e-3)
        return RuleModel(log(p / (1 - p)), [])
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label", *names)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = sorted({tuple(r) for tree in forest.trees for r in tree_rules(tree.toDebugString, names)})
    if not rules:
        return RuleModel(0.0, [])
    ones = vectors.select("label", F.array(*[rule_column(r).cast("double") for r in rules]).alias("x"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(ones.select("label", array_to_vector("x").alias("features")))
    weights = lasso.coefficients.toArray()
    return RuleModel(lasso.intercept, [(float(w), list(r)) for w, r in zip(weights, rules) if abs(w) > 1e-6])


def learn_quality(docs: DataFrame, labels: DataFrame) -> RuleModel:
    """A model learned from the labelled rows of `docs` (doc_id, text) outside the held-out fold, by labels.quality."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    marked = marked.where(hash_mod(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])
    rate = TRAIN_ROWS / max(1, marked.count())
    if rate < 1:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000))
    with scratch(docs.sparkSession) as keep:
        rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("label", "text")  # about TRAIN_ROWS ids
        values = features(F.col("stats"))
        return fit_rules(keep(text_stats(rows, ["label"]).select("label", *[e.alias(k) for k, e in values.items()])), list(values))


def with_score(docs: DataFrame, model: RuleModel, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` (all, if not given) of `docs` (text and others) and their score."""
    scored = text_stats(docs, keep, name=name)
    scored = scored.withColumn(name, F.struct(*[e.alias(k) for k, e in features(F.col(name)).items()]))
    return scored.withColumn(name, model.score(F.col(name)))


def score_quality(docs: DataFrame, labels: DataFrame, min_score: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; learns from labels.quality."""
    docs = docs.select("doc_id", "text")
    held = hash_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]
    return with_score(docs, learn_quality(docs, labels), ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= min_score).cast("int").alias("predicted"))


@any_names
def keep_good(docs: DataFrame, labels: DataFrame, min_score: float = 0.7) -> DataFrame:
    """The rows of `docs` that are predicted good, with all their columns; all rows if no rule could be learned."""
    model = learn_quality(docs, labels)
    if not model.rules:
        return docs
    name = free_name(docs, "score")
    return with_score(docs, model, name=name).where(F.col(name) >= min_score).drop(name)
