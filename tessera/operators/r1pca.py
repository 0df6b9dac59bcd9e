"""Rotational-invariant L1 principal components (Ding et al. 2006).

Samples are rows (id, v). Each turn of the loop is one pass that sums a
weighted d x d Gram matrix; the d x k basis stays on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as vec
from tessera.operators.linalg import WRITTEN_OUT, dimension, gram, left_vectors, numbers, orthonormal, project


def residual(v: Column, u: np.ndarray) -> Column:
    """Norm of what lies outside the span of u's orthonormal columns: sqrt(v'v - |u'v|^2), not under 0."""
    if u.size > WRITTEN_OUT:
        return numbers(lambda x: np.sqrt(np.maximum((x * x).sum(1) - ((x @ u) ** 2).sum(1), 0)))(v)
    inside = project(v, u)
    return F.sqrt(F.greatest(vec.dot(v, v) - vec.dot(inside, inside), F.lit(0.0)))


def difference_norm(v: Column, u: np.ndarray) -> Column:
    """The same norm from the difference itself, v - u u'v: exact where it is small."""
    d = u.shape[0]
    if d * d > WRITTEN_OUT:
        return numbers(lambda x: np.sqrt(((x - (x @ u) @ u.T) ** 2).sum(1)))(v)
    flat = u @ u.T
    parts = [F.element_at(v, i + 1) - sum((F.element_at(v, j + 1) * F.lit(float(flat[i, j])) for j in range(d)), F.lit(0.0)) for i in range(d)]
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def residuals(df: DataFrame, u: np.ndarray, v: str = "v") -> DataFrame:
    _check(df, u, v)
    return df.withColumn("residual", residual(F.col(v).cast("array<double>"), u))


def weighted_covariance(df: DataFrame, u: np.ndarray, c: float, v: str = "v") -> np.ndarray:
    """Sum of w v v' with Huber weights of the difference norms; a norm of 0 raises."""
    _check(df, u, v)
    x = df.select(F.col(v).cast("array<double>").alias("v")).withColumn("r", difference_norm(F.col("v"), u))
    if x.where("r = 0").limit(1).count():
        raise ValueError("a sample lies in the subspace: its weight is undefined")
    return gram(x, "v", vec.huber_weight(F.col("r"), c))


def _check(df: DataFrame, u: np.ndarray, v: str) -> None:
    if (d := dimension(df, v)) != u.shape[0]:
        raise ValueError(f"vectors of {d} values and a basis of {u.shape[0]} rows")


@dataclass
class RobustPCA:
    """u: d x k basis; d: u' C u; scores: (id, score) of every sample; c: the residual limit; errors: one a turn."""

    u: np.ndarray
    d: np.ndarray
    scores: DataFrame
    c: float
    errors: list[float]


def _pass(x: DataFrame, u: np.ndarray, c: float) -> tuple[float, np.ndarray, bool]:
    """Of a basis: the sum of residuals, the weighted covariance, and whether a sample lies in the subspace. One job."""
    d = u.shape[0]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(d * d + 2)
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                inside = v @ u
                total[0] += np.sqrt(np.maximum((v * v).sum(1) - (inside * inside).sum(1), 0)).sum()
                r = np.sqrt(((v - inside @ u.T) ** 2).sum(1))
                total[1] += (r == 0).sum()
                w = np.where(r <= c, 1, c / np.where(r > 0, r, 1))
                total[2:] += ((v * w[:, None]).T @ v).ravel()
        yield pd.DataFrame({"cell": np.arange(len(total)), "x": total})

    out = np.zeros(d * d + 2)
    for r in x.select("v").mapInPandas(partial, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        out[r["cell"]] = r["x"]
    return out[0], out[2:].reshape(d, d), out[1] > 0


def fit(df: DataFrame, k: int, id_col: str = "id", v: str = "v", max_iter: int = 100) -> RobustPCA:
    """The basis after the first turn that doesn't lower the sum of residuals (that turn's, not the best).

    A turn is one job: the pass that gives a basis' error also gives the
    covariance that the next turn needs.
    """
    x = df.select(F.col(id_col).alias("id"), F.col(v).cast("array<double>").alias("v")).persist()
    u = left_vectors(x, k)
    c = x.select(residual(F.col("v"), u).alias("r")).agg(F.median("r")).first()[0]
    if c is None:
        raise ValueError("no samples")
    now, following, zero = _pass(x, u, c)
    before, cov, errors = math.inf, following, [now]
    while before > now and len(errors) <= max_iter:
        if zero:
            raise ValueError("a sample lies in the subspace: its weight is undefined")
        before, cov = now, following
        u = orthonormal(cov @ u)
        now, following, zero = _pass(x, u, c)
        errors.append(now if not math.isnan(now) else math.inf)
    x.unpersist()
    return RobustPCA(u, u.T @ cov @ u, x.select("id", project(F.col("v"), u).alias("score")), c, errors)
