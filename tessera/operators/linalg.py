"""Matrices as tables: coordinate products, Gram matrices, truncated factorisations.

A dense matrix is (id, v ARRAY<DOUBLE>), a sparse one (i, j, x). What reaches
the driver is d x d or k x k, never a dimension that grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, x) of the product of two coordinate matrices: a join on the inner index and a sum."""
    left = a.select("i", F.col("j").alias("inner"), F.col("x").alias("xa"))
    right = b.select(F.col("i").alias("inner"), "j", F.col("x").alias("xb"))
    return left.join(right, "inner").groupBy("i", "j").agg(F.sum(F.col("xa") * F.col("xb")).alias("x"))


def elementwise(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """(i, j, x) with x = f(xa, xb) over cells that both have."""
    return a.select("i", "j", F.col("x").alias("xa")).join(b.select("i", "j", F.col("x").alias("xb")), ["i", "j"]).select("i", "j", f(F.col("xa"), F.col("xb")).alias("x"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")


def gram(df: DataFrame, v: str = "v", weight: Column | None = None) -> np.ndarray:
    """Sum of w v v^T over the rows: partial d x d sums in each task, summed by cell."""
    d = dimension(df, v)
    rows = df.select(F.col(v).cast("array<double>").alias("v"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                total += (x * pdf["w"].to_numpy()[:, None]).T @ x
        yield pd.DataFrame({"cell": np.arange(d * d), "x": total.ravel()})

    out = np.zeros(d * d)
    for r in rows.mapInPandas(partial, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
        out[r["cell"]] = r["x"]
    return out.reshape(d, d)


def dimension(df: DataFrame, v: str = "v") -> int:
    """Length of the vectors; rows that differ raise, an empty table gives 0."""
    r = df.agg(F.min(F.size(v)), F.max(F.size(v))).first()
    if r[0] != r[1]:
        raise ValueError(f"vectors of {r[0]} to {r[1]} values")
    return r[0] or 0


def fix_signs(u: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive: factorisations leave the sign open."""
    top = np.abs(u).argmax(0)
    return u * np.where(u[top, np.arange(u.shape[1])] < 0, -1, 1)


def left_vectors(df: DataFrame, k: int, v: str = "v") -> np.ndarray:
    """The k leading left singular vectors of the matrix whose columns are the samples, uncentred."""
    values, vectors = np.linalg.eigh(gram(df, v))
    return fix_signs(vectors[:, np.argsort(-values)[:k]])


def orthonormal(u: np.ndarray) -> np.ndarray:
    return fix_signs(np.linalg.qr(u)[0])


#: up to so many products an expression is written out; beyond it Arrow batches are faster to plan and run
WRITTEN_OUT = 64


def project(v: Column, u: np.ndarray) -> Column:
    """u^T v: one dot product a column of u."""
    if u.size > WRITTEN_OUT:
        return arrays(lambda x: x @ u)(v)
    return F.array(*(sum((F.element_at(v, i + 1) * F.lit(float(u[i, c])) for i in range(u.shape[0])), F.lit(0.0)) for c in range(u.shape[1])))


def arrays(f):
    """A function of N x d matrices to N x k ones, over array columns."""

    @pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(f(np.stack(v.to_numpy())))) if len(v) else pd.Series([], dtype=object)

    return run


def numbers(f):
    """A function of N x d matrices to N numbers, over array columns."""

    @pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(f(np.stack(v.to_numpy())) if len(v) else [], dtype=float)

    return run
