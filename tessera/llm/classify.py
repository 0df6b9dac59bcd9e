"""Labelled samples for the two text classifiers, and what they share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sample:
    """rows: (text, label, turn), at most `limit` of each class; class_odds: log odds of label 1 over all rows it was drawn from; log_odds: the same less the sample's."""

    rows: DataFrame
    class_odds: float
    log_odds: float
    size: int


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, may_learn: Column, id_col: str, column: str, limit: int) -> Sample:
    """The bounded sample that a classifier is fitted on.

    Of the labelled ids that may_learn admits, each class gives at most `limit`,
    taken in the order of a hash of the id. A null id or label isn't used; an
    id with both labels counts as 1, and of rows with one id that with the least
    text hash is used.
    """
    known = labels.where(may_learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    turn = F.xxhash64(F.lit("turn"), "_id")
    part = [known.where(F.col("label") == y).withColumn("turn", turn).orderBy("turn", "_id").limit(limit) for y in (0, 1)]
    chosen = part[0].union(part[1])  # at most 2 * limit ids: small enough to send to every executor
    rows = docs.select(F.col(id_col).alias("id"), F.col(column).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("_id"))
    rows = rows.groupBy("_id", "label", "turn").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label", "turn")
    taken = {y: min(counts.get(y, 0), limit) for y in (0, 1)}
    odds = [float(np.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5))) for n in (counts, taken)]
    return Sample(rows, odds[0], odds[0] - odds[1], sum(taken.values()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
