"""Non-negative factorisation of sparse matrices, and cross-validation over ranks.

A is (i, j, x) without its zeros; W is (i, w), H is (j, h), with rank-k arrays.
Products with A are a join and a grouped sum; k x k products are summed to the
driver. W H is never made dense but for the cells that are asked about.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as vec
from tessera.operators.linalg import gram
from tessera.operators.svd import svd
from tessera.runtime import Scratch

TINY = 1e-10


def check(a: DataFrame) -> None:
    if a.where("x < 0").limit(1).count():
        raise ValueError("the matrix has negative elements")


def _sums(of: Column, k: int) -> Column:
    return F.array(*(F.sum(F.element_at(of, c + 1)) for c in range(k)))


def a_times(a: DataFrame, h: DataFrame, k: int) -> DataFrame:
    """(i, p): A H', a rank-k vector a row."""
    return a.join(h, "j").select("i", vec.scale("h", "x").alias("t")).groupBy("i").agg(_sums(F.col("t"), k).alias("p"))


def at_times(a: DataFrame, w: DataFrame, k: int) -> DataFrame:
    """(j, p): A' W, a rank-k vector a column."""
    return a.join(w, "i").select("j", vec.scale("w", "x").alias("t")).groupBy("j").agg(_sums(F.col("t"), k).alias("p"))


def _by_matrix(v: Column, m: np.ndarray) -> Column:
    """v' m for a k x k matrix."""
    return F.array(*(sum((F.element_at(v, r + 1) * F.lit(float(m[r, c])) for r in range(m.shape[0])), F.lit(0.0)) for c in range(m.shape[1])))


def _step(old: Column, top: Column, bottom: Column) -> Column:
    """old * top / bottom, element by element; 0 / 0 is 0, and a missing product 0."""
    zipped = F.arrays_zip(old.alias("o"), top.alias("t"), bottom.alias("b"))
    return F.transform(zipped, lambda x: F.when(x["b"] > 0, x["o"] * x["t"] / x["b"]).otherwise(F.lit(0.0)))


def cross_gram(left: DataFrame, right: DataFrame, key: str, x: str, y: str, k: int) -> np.ndarray:
    """Sum over the rows of left's vector times right's: k x k."""
    both = left.join(right, key)
    cells = [F.sum(F.element_at(x, r + 1) * F.element_at(y, c + 1)) for r in range(k) for c in range(k)]
    return np.array([v or 0.0 for v in both.agg(*(e.alias(f"c{i}") for i, e in enumerate(cells))).first()]).reshape(k, k)


def update(a: DataFrame, w: DataFrame, h: DataFrame, k: int, mode: str = "compat", scratch: Scratch | None = None, name: str = "step") -> tuple[DataFrame, DataFrame]:
    """One multiplicative update of H, then of W.

    compat: W's numerator and the right factor of its denominator use the H
    from before the update. lee_seung: both use the new one.
    """
    zero = F.array(*[F.lit(0.0)] * k)
    new_h = h.join(at_times(a, w, k), "j", "left").select("j", _step(F.col("h"), F.coalesce("p", zero), _by_matrix(F.col("h"), gram(w, "w"))).alias("h"))
    if scratch:
        new_h = scratch.write(new_h, f"{name}-h")
    used = h if mode == "compat" else new_h
    product = cross_gram(new_h.withColumnRenamed("h", "hn"), used, "j", "hn", "h", k)
    new_w = w.join(a_times(a, used, k), "i", "left").select("i", _step(F.col("w"), F.coalesce("p", zero), _by_matrix(F.col("w"), product)).alias("w"))
    return (scratch.write(new_w, f"{name}-w") if scratch else new_w), new_h


def loss(a: DataFrame, w: DataFrame, h: DataFrame, k: int) -> float:
    """Squared Frobenius norm of A - W H: sum of a^2, less 2 a (W H) over A's cells, plus tr(W'W H H')."""
    cross = a.join(w, "i").join(h, "j").agg(F.sum(F.col("x") * vec.dot("w", "h"))).first()[0] or 0.0
    own = a.agg(F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0
    return own - 2 * cross + float((gram(w, "w") * gram(h, "h")).sum())


def nndsvd(a: DataFrame, k: int, m: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Non-negative double singular value decomposition (Boutsidis and Gallopoulos 2008) of an m x n matrix.

    Singular vectors stay tables of both sides; 4 k norms reach the driver.
    """
    if k > min(m, n):
        raise ValueError(f"rank {k} is more than the {min(m, n)} rows or columns")
    spark, found = a.sparkSession, svd(a, k)
    rank = len(found.s)
    left, right = _part_norms(found.u, rank), _part_norms(found.v, rank)
    w_cols, h_cols = [], []
    for c in range(k):
        u, v = F.element_at("v", c + 1), F.element_at("v", c + 1)
        if c >= rank:
            w, h = F.lit(0.0), F.lit(0.0)
        elif c == 0:
            w, h = (F.abs(x) * F.lit(math.sqrt(found.s[0])) for x in (u, v))
        else:
            products = left[c] * right[c]
            side = int(products[1] > products[0])
            root = math.sqrt(found.s[c] * products[side])
            w, h = (F.greatest(-x if side else x, F.lit(0.0)) * F.lit(float(root / size[c, side] if size[c, side] else 0.0)) for x, size in ((u, left), (v, right)))
        w_cols.append(w)
        h_cols.append(h)

    def side_of(vectors: DataFrame, key: str, size: int, columns: list[Column], name: str) -> DataFrame:
        none = F.array(*[F.lit(0.0)] * rank).cast("array<double>")  # a row or column without entries
        every = spark.range(size).withColumnRenamed("id", key).join(vectors, key, "left").select(key, F.coalesce("v", none).alias("v"))
        return every.select(key, vec.clamp_small(F.array(*columns), TINY).alias(name))

    return side_of(found.u, "i", m, w_cols, "w"), side_of(found.v, "j", n, h_cols, "h")


def _part_norms(vectors: DataFrame, k: int) -> np.ndarray:
    """k x 2: the norms of each column's positive and negative part."""
    parts = [F.sqrt(F.sum(F.pow(F.greatest(sign * F.element_at("v", c + 1), F.lit(0.0)), 2))) for c in range(k) for sign in (F.lit(1.0), F.lit(-1.0))]
    return np.array([x or 0.0 for x in vectors.agg(*(p.alias(f"n{i}") for i, p in enumerate(parts))).first()] if parts else []).reshape(k, 2)


@dataclass
class Factors:
    w: DataFrame
    h: DataFrame
    loss: float
    rounds: int
    scratch: Scratch


def fit(a: DataFrame, k: int, m: int, n: int, err: float = 0.1, mode: str = "compat", start: tuple[DataFrame, DataFrame] | None = None, max_iter: int = 200) -> Factors:
    """Updates until the loss falls by no more than err, or is NaN."""
    check(a)
    scratch = Scratch(a.sparkSession, "nmf")
    a = scratch.write(a.where("x <> 0").select("i", "j", "x"), "a")
    w, h = start or nndsvd(a, k, m, n)
    w, h = scratch.write(w, "0-w"), scratch.write(h, "0-h")
    before, now, i = math.inf, loss(a, w, h, k), 0
    while not math.isnan(now) and before - now > err and i < max_iter:
        i += 1
        w, h = update(a, w, h, k, mode, scratch, str(i))
        before, now = now, loss(a, w, h, k)
        scratch.drop(f"{i - 1}-w", f"{i - 1}-h")
    return Factors(w, h, now, i, scratch)


def cell_folds(m: int, n: int, folds: int, spark, seed: int = 0) -> DataFrame:
    """(i, j, fold) of every cell, by a hash of the cell and the seed."""
    i, j = (F.col("id") / n).cast("long"), F.col("id") % n
    return spark.range(m * n).select(i.alias("i"), j.alias("j")).withColumn("fold", F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(folds)).cast("int"))


def masked_error(a: DataFrame, mask: DataFrame, k: int, m: int, n: int, masked_loss: bool = False, **how) -> float:
    """Squared error over the cells of mask (i, j) after a fit that sees them as zeros.

    masked_loss fits only what isn't masked: the cells take their own estimates
    in each of five refits.
    """
    hidden = mask.select("i", "j")
    seen = a.join(hidden, ["i", "j"], "left_anti")
    f = fit(seen, k, m, n, **how)
    for _ in range(5 if masked_loss else 0):
        guess = hidden.join(f.w, "i").join(f.h, "j").select("i", "j", vec.dot("w", "h").alias("x"))
        f = fit(seen.select("i", "j", "x").union(guess), k, m, n, start=(f.w, f.h), **how)
    cells = hidden.join(a, ["i", "j"], "left").join(f.w, "i").join(f.h, "j")
    got = cells.agg(F.sum(F.pow(F.coalesce("x", F.lit(0.0)) - vec.dot("w", "h"), 2))).first()[0] or 0.0
    f.scratch.clear()
    return float(got)


def cross_validate(a: DataFrame, m: int, n: int, ks: Iterable[int] = range(1, 51), folds: int = 10, fast: bool = False, seed: int = 0, fold_table: DataFrame | None = None, at_once: int = 4, **how) -> DataFrame:
    """(k, cve): masked squared error over the folds, over the number of cells; fast takes two folds and the same divisor."""
    spark = a.sparkSession
    table = (fold_table if fold_table is not None else cell_folds(m, n, folds, spark, seed)).persist()
    tasks = [(k, f) for k in ks for f in range(2 if fast else folds)]
    with ThreadPoolExecutor(at_once) as pool:
        got = list(pool.map(lambda t: (t[0], masked_error(a, table.where(F.col("fold") == t[1]), t[0], m, n, **how)), tasks))
    table.unpersist()
    rows = spark.createDataFrame(got, "k int, e double") if got else spark.createDataFrame([], "k int, e double")
    return rows.groupBy("k").agg((F.sum("e") / F.lit(float(m * n))).alias("cve"))
