"""Truncated singular value decomposition of a sparse matrix, by restarted block Krylov iteration.

The matrix is (i, j, x). Bases of its rows and columns are tables of short
vectors, (i, v) and (j, v); a product with the matrix is a join and a grouped
sum, and only Gram matrices of (k + oversample) * depth columns reach the driver
(Halko, Martinsson and Tropp 2011; Musco and Musco 2015).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as vec
from tessera.operators.linalg import arrays, gram
from tessera.runtime import Scratch, ship

#: scaled Gram eigenvalues under this are rounding, and their directions dropped
_NOTHING = 1e-12


@dataclass
class SVD:
    """u: (i, v), the left vectors of every row that has an entry; s: singular values, falling; v: (j, v), the right ones.

    Fewer than k columns if the rank is less. converged says whether every
    residual |A v - s u| came under the limit; rounds are restarts.
    """

    u: DataFrame
    s: np.ndarray
    v: DataFrame
    rounds: int
    converged: bool
    scratch: Scratch


def times(a: DataFrame, b: DataFrame, inner: str, outer: str, width: int) -> DataFrame:
    """(outer, v): the matrix times vectors (inner, v), summed in each task before the shuffle."""
    scaled = a.join(b, inner).select(outer, vec.scale("v", "x").alias("t"))
    return scaled.groupBy(outer).agg(F.array(*(F.sum(F.element_at("t", c + 1)) for c in range(width))).alias("v"))


def _by(v: Column, m: np.ndarray) -> Column:
    return arrays(lambda x: x @ m)(v)


def _normal(key: str, width: int, seed: int) -> Column:
    """Standard normal numbers that depend on the key and the seed alone."""

    def uniform(c: int, which: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(c), F.lit(which)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))

    return F.array(*(F.sqrt(-2 * F.ln(uniform(c, 0))) * F.cos(2 * math.pi * uniform(c, 1)) for c in range(width)))


def _whitening(g: np.ndarray) -> np.ndarray:
    """l x r matrix m with m' g m = I: orthonormal columns once vectors with Gram matrix g are multiplied by it."""
    size = np.sqrt(np.maximum(np.diag(g), 0))
    if not size.any():
        return np.zeros((len(g), 0))
    scale = np.where(size > size.max() * _NOTHING, 1 / np.where(size > 0, size, 1), 0)
    values, vectors = np.linalg.eigh(g * scale[:, None] * scale)
    keep = values > _NOTHING * max(values.max(), 1e-300)
    return scale[:, None] * vectors[:, keep] / np.sqrt(values[keep])


def _beside(tables: list[DataFrame], key: str) -> DataFrame:
    """(key, v): vectors of several tables with the same keys, one after another."""
    out = tables[0].withColumnRenamed("v", "v0")
    for b, t in enumerate(tables[1:], 1):
        out = out.join(t.withColumnRenamed("v", f"v{b}"), key)
    return out.select(key, F.concat(*(f"v{b}" for b in range(len(tables)))).alias("v"))


def svd(a: DataFrame, k: int, oversample: int = 8, depth: int = 4, tol: float = 1e-7, max_rounds: int = 20, seed: int = 0) -> SVD:
    """The k largest singular values of a matrix (i, j, x) and their vectors.

    A round builds `depth` blocks of a Krylov space, a product with the matrix
    and one with its transpose each, and starts again from its best k +
    oversample directions. It ends when no residual |A v - s u| of the k values
    exceeds tol times the largest value, or after max_rounds (see converged).
    Cells given twice add up; zeros and nulls are nothing; an empty or zero
    matrix has no singular values. Values less than about 1e-6 of the largest
    are rounding.
    """
    if k < 1:
        raise ValueError("at least one singular value must be asked for")
    ship(a.sparkSession)
    scratch, width = Scratch(a.sparkSession, "svd"), k + oversample
    a = scratch.write(a.where("x <> 0").select("i", "j", F.col("x").cast("double").alias("x")), "a")
    right = a.select("j").distinct().select("j", _normal("j", width, seed).alias("v"))
    left, s, rounds, done = None, np.zeros(0), 0, False
    while True:
        y = scratch.write(times(a, right, "j", "i", width), f"{rounds}-y-0")
        squares = gram(y, "v")
        if rounds:
            # |A v - s u|^2 = |A v|^2 - s^2
            excess = np.maximum(np.diag(squares) - s * s, 0)[:k]
            done = bool((excess <= (tol * s[0]) ** 2 + 1e-15 * s[0] ** 2).all())
            if done or rounds >= max_rounds:
                break
        qs, zs = [], []
        for b in range(depth):
            m = _whitening(squares)
            if not m.shape[1]:
                break
            qs.append(y.select("i", _by(F.col("v"), m).alias("v")))
            zs.append(scratch.write(times(a, qs[-1], "i", "j", m.shape[1]), f"{rounds}-z-{b}"))
            if b + 1 < depth:
                y = scratch.write(times(a, zs[-1], "j", "i", m.shape[1]), f"{rounds}-y-{b + 1}")
                squares = gram(y, "v")
        if not qs:
            return SVD(y.limit(0), np.zeros(0), right.limit(0), rounds, True, scratch)
        # orthonormal twice over, as one pass leaves the rounding of a squared condition number
        q, z = scratch.write(_beside(qs, "i"), f"{rounds}-q"), _beside(zs, "j")
        first = _whitening(gram(q, "v"))
        q = scratch.write(q.select("i", _by(F.col("v"), first).alias("v")), f"{rounds}-q-1")
        second = _whitening(gram(q, "v"))
        z = scratch.write(z.select("j", _by(F.col("v"), first @ second).alias("v")), f"{rounds}-z")
        # with z = A'q and z'z = m s^2 m': left vectors q m, right ones z m / s
        values, m = np.linalg.eigh(gram(z, "v"))
        order = np.argsort(-values)[: k + oversample]
        s, m = np.sqrt(np.maximum(values[order], 0)), m[:, order]
        real = s > s[0] * 1e-12
        s, m, width = s[real], m[:, real], int(real.sum())
        left = scratch.write(q.select("i", _by(F.col("v"), second @ m).alias("v")), f"{rounds}-u")
        right = scratch.write(z.select("j", _by(F.col("v"), m / s).alias("v")), f"{rounds}-v")
        scratch.drop(*(f"{rounds}-{x}-{b}" for x in "yz" for b in range(depth)), f"{rounds}-q", f"{rounds}-q-1", f"{rounds}-z", f"{rounds - 1}-u", f"{rounds - 1}-v")
        rounds += 1
    return SVD(left.select("i", F.slice("v", 1, k).alias("v")), s[:k], right.select("j", F.slice("v", 1, k).alias("v")), rounds, done, scratch)
