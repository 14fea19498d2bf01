"""Zero-shot scores: softmax of scaled cosines of item vectors and label vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The temperature of the softmax, and the most label vectors that a vocabulary may broadcast.
SCALE, MAX_LABELS = 100.0, 10_000


def softmax_scores(items: DataFrame, labels: DataFrame, allowed: list[str] | None = None, allowed_col: str | None = None) -> DataFrame:
    """item_id, label, idx, score: long rows, each item's scores summing to 1.

    items: item_id, embedding; labels: idx, label, embedding (a vocabulary, at most MAX_LABELS).
    allowed: restricts the labels of all items; allowed_col: an array of labels by item, which restricts that item's, as its detected group does.
    A restriction that leaves no label is none; so is a null or empty array.
    """
    vocab = labels.select("idx", "label", "embedding").orderBy("idx").limit(MAX_LABELS + 1).toPandas()
    if len(vocab) > MAX_LABELS:
        raise ValueError(f"a vocabulary has at most {MAX_LABELS} labels")
    if allowed is not None and vocab["label"].isin(allowed).any():
        vocab = vocab[vocab["label"].isin(allowed)]
    names, idx = vocab["label"].tolist(), vocab["idx"].astype(int).tolist()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
    matrix = unit(np.stack(vocab["embedding"].to_list()).astype(np.float64)) if len(vocab) else np.zeros((0, 1))
    places: dict[str, list[int]] = {}
    for place, name in enumerate(names):
        places.setdefault(name, []).append(place)
    shared = items.sparkSession.sparkContext.broadcast((matrix, places))

    @F.pandas_udf("array<double>")
    def scores(vectors: pd.Series, own: pd.Series) -> pd.Series:
        matrix, places = shared.value
        logits = SCALE * unit(np.stack(vectors.to_list()).astype(np.float64)) @ matrix.T
        for row, told in enumerate(own):
            at = [p for x in told for p in places.get(x, [])] if told is not None else []
            if at:
                left_out = np.ones(logits.shape[1], bool)
                left_out[at] = False
                logits[row, left_out] = -np.inf
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return pd.Series([[x if y > -np.inf else None for x, y in zip(p, q)] for p, q in zip(e / e.sum(axis=1, keepdims=True), logits)])

    @F.pandas_udf("array<double>")
    def all_scores(vectors: pd.Series) -> pd.Series:
        logits = SCALE * unit(np.stack(vectors.to_list()).astype(np.float64)) @ shared.value[0].T
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

    labelled = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("label")) for i, n in zip(idx, names)])
    found = scores("embedding", allowed_col) if allowed_col else all_scores("embedding")
    pairs = items.select("item_id", F.explode(F.arrays_zip(labelled.alias("l"), found.alias("score"))).alias("p"))
    return pairs.select("item_id", F.col("p.l.label").alias("label"), F.col("p.l.idx").alias("idx"), F.col("p.score").alias("score")).where("score is not null")


def active_heads(heads: DataFrame, active: list[str], colour: str = "color") -> tuple[DataFrame, DataFrame]:
    """(reported heads, colour heads) of long rows with an `attribute`: those of active attributes alone.

    Colour only corroborates the measured one, so it is kept apart; `subcategory` waits for a second pass.
    """
    own = heads.where(F.col("attribute").isin([a for a in active if a != "subcategory"]))
    return own.where(F.col("attribute") != colour), own.where(F.col("attribute") == colour)


def top_labels(scores: DataFrame, k: int = 3) -> DataFrame:
    """item_id, label, score, rank of the k best labels; ties by vocabulary order."""
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "idx")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def head_diagnostics(scores: DataFrame, cap: float = 1.0) -> DataFrame:
    """item_id, label, confidence (capped, 5 digits), entropy, margin of each item's head: one grouped pass."""
    n = F.count(F.lit(1))
    entropy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(-F.col("score") * F.log(F.col("score") + 1e-12)) / F.log(n.cast("double"))))
    two = F.sort_array(F.collect_list("score"), asc=False)
    return scores.groupBy("item_id").agg(
        F.max_by("label", F.struct("score", -F.col("idx"))).alias("label"), F.least(F.round(F.max("score"), 5), F.lit(cap)).alias("confidence"),
        F.when(n < 2, 0.0).otherwise(entropy).alias("entropy"), F.when(n < 2, 1.0).otherwise(F.get(two, F.lit(0)) - F.get(two, F.lit(1))).alias("margin"),
    )
