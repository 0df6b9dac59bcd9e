"""K-means primitives and the loop over them. Centroids are K x D numbers on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as vec
from tessera.operators.linalg import dimension


def seeds(df: DataFrame, k: int, id_col: str = "id", v: str = "v") -> np.ndarray:
    """Centroid i is the i-th sample by id."""
    rows = df.orderBy(id_col).limit(k).select(v).collect()
    if len(rows) < k:
        raise ValueError(f"{len(rows)} samples for {k} clusters")
    return np.array([r[0] for r in rows], float)


def distances(v: Column, centroids: np.ndarray) -> Column:
    """Squared distances to every centroid; a centroid with NaN is infinitely far, but the first keeps NaN."""
    return F.array(*(vec.sq_dist(v, vec.literal(c)) for c in centroids))


def nearest(v: Column, centroids: np.ndarray, compat: bool = False) -> Column:
    """Number of the nearest centroid; of equals the lowest.

    With compat a centroid of NaNs (an empty cluster's) never wins, except the
    first, which then keeps every sample.
    """
    bad = [bool(np.isnan(c).any()) for c in centroids]
    if compat and bad[0]:
        return F.lit(0)
    far = F.lit(float("inf"))
    d = F.array(*(far if b else vec.sq_dist(v, vec.literal(c)) for c, b in zip(centroids, bad, strict=True)))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def assign(df: DataFrame, centroids: np.ndarray, v: str = "v", compat: bool = False) -> DataFrame:
    """df with the label of the nearest centroid: one pass, nothing shuffled."""
    return df.withColumn("label", nearest(F.col(v), centroids, compat))


def update(labelled: DataFrame, dims: int, v: str = "v", label: str = "label") -> DataFrame:
    """(label, n, mean) of each cluster: sums combined before the shuffle, so a label that holds most rows doesn't hurt."""
    means = [F.avg(F.element_at(F.col(v), i + 1)) for i in range(dims)]
    return labelled.groupBy(label).agg(F.count("*").alias("n"), F.array(*means).alias("mean"))


def changed(before: DataFrame, after: DataFrame, id_col: str = "id") -> DataFrame:
    """One row (changed): whether any sample moved."""
    both = before.select(id_col, F.col("label").alias("old")).join(after.select(id_col, F.col("label").alias("new")), id_col)
    return both.agg(F.coalesce(F.bool_or(F.col("old") != F.col("new")), F.lit(False)).alias("changed"))


def fit(df: DataFrame, k: int, max_iter: int = 100, id_col: str = "id", v: str = "v", compat: bool = False, start: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Centroids and rounds until no sample moves, or max_iter rounds.

    An empty cluster keeps its centroid; with compat it becomes NaN. A round is
    one job: it moves the samples, sums the clusters and counts how many moved.
    """
    centroids = seeds(df, k, id_col, v) if start is None else np.array(start, float)
    d = dimension(df, v)
    old: np.ndarray | None = None
    for i in range(max_iter):
        moved = F.lit(1) if old is None else (nearest(F.col(v), old, compat) != F.col("label")).cast("int")
        sums = [F.avg(F.element_at(F.col(v), j + 1)).alias(f"m{j}") for j in range(d)]
        rows = {r["label"]: r for r in assign(df, centroids, v, compat).groupBy("label").agg(*sums, F.sum(moved).alias("moved")).collect()}
        if old is not None and not sum(r["moved"] for r in rows.values()):
            return centroids, i
        old = centroids
        centroids = np.array([[rows[c][f"m{j}"] for j in range(d)] if c in rows else [math.nan] * d if compat else old[c] for c in range(k)], float)
    return centroids, max_iter
