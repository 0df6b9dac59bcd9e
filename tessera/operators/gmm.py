"""Gaussian mixtures by expectation-maximisation, and the choice of their number.

The model (K weights, means and covariances) stays on the driver; a pass over
the samples gives responsibilities, log-likelihood and the next moments at
once. Moments are taken around the previous means, which keeps the accuracy of
a centred second pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.operators import kmeans
from tessera.operators.linalg import dimension
from tessera.runtime import Scratch, ship

TOLERANCE = 1e-2
#: log-determinants under this count as degenerate
LEAST_LOG_DET = -300.0
TINY = float(np.finfo(float).tiny)


@dataclass
class Mixture:
    """Weights, means, covariances, and the inverses and log-determinants in use."""

    pi: np.ndarray
    means: np.ndarray
    cov: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray

    @classmethod
    def of(cls, pi: np.ndarray, means: np.ndarray, cov: np.ndarray, compat: bool = True) -> Mixture:
        """Degenerate covariances become the identity; compat stores their log-determinant as 1, else as 0."""
        cov = cov.copy()
        inverse, log_det = np.empty_like(cov), np.empty(len(pi))
        for k in range(len(pi)):
            sign, value = np.linalg.slogdet(cov[k])
            if sign == 0 or math.isnan(value) or value < LEAST_LOG_DET:
                cov[k], inverse[k], log_det[k] = np.eye(cov.shape[1]), np.eye(cov.shape[1]), 1.0 if compat else 0.0
            else:
                inverse[k], log_det[k] = np.linalg.inv(cov[k]), value
        return cls(pi, means, cov, inverse, log_det)

    def log_densities(self, x: np.ndarray, compat: bool = False) -> np.ndarray:
        """N x K; a negative quadratic form gives -Infinity, with compat the smallest positive double."""
        form = np.empty((len(x), len(self.pi)))
        for k in range(len(self.pi)):  # one matrix product a component
            diff = x - self.means[k]
            form[:, k] = ((diff @ self.inverse[k]) * diff).sum(1)
        out = -0.5 * (self.log_det + x.shape[1] * math.log(2 * math.pi) + form)
        return np.where(form < 0, TINY if compat else -np.inf, out)

    def responsibilities(self, x: np.ndarray, compat: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """N x K responsibilities and the N log-likelihoods; components of weight 0 take no part."""
        with np.errstate(divide="ignore"):
            logs = self.log_densities(x, compat) + np.log(self.pi)
        top = logs.max(1, keepdims=True)
        total = np.log(np.exp(logs - top).sum(1, keepdims=True)) + top
        return np.exp(logs - total), total[:, 0]

    def table(self, spark) -> DataFrame:
        rows = [(k, float(self.pi[k]), self.means[k].tolist(), self.cov[k].tolist(), float(self.log_det[k])) for k in range(len(self.pi))]
        return spark.createDataFrame(rows, "k int, pi double, mean array<double>, cov array<array<double>>, log_det double")

    def long_table(self, spark) -> DataFrame:
        """(part, k, i, j, x): pi, log_det, mean (i) and cov (i, j) of each component."""
        rows = [row for k in range(len(self.pi)) for row in (("pi", k, None, None, float(self.pi[k])), ("log_det", k, None, None, float(self.log_det[k])))]
        rows += [("mean", k, i, None, x) for k, mean in enumerate(self.means.tolist()) for i, x in enumerate(mean)]
        rows += [("cov", k, i, j, x) for k, cov in enumerate(self.cov.tolist()) for i, row in enumerate(cov) for j, x in enumerate(row)]
        return spark.createDataFrame(rows, "part string, k int, i long, j long, x double")


#: a dump leaves out responsibilities that aren't larger
LEAST_SHARE = 1e-5


def dump(df: DataFrame, mixture: Mixture, id_col: str = "id", v: str = "v", compat: bool = False) -> DataFrame:
    """(part, k, i, j, x): the model's numbers, and of each sample (i, its id) the responsibilities over LEAST_SHARE, as "gamma"."""
    shares = e_step(df.select(F.col(id_col).cast("long").alias("i"), F.col(v).alias("v")), mixture, compat=compat)
    gamma = shares.select(F.lit("gamma").alias("part"), "i", F.posexplode("gamma").alias("k", "x")).where(F.col("x") > LEAST_SHARE)
    return mixture.long_table(df.sparkSession).union(gamma.select("part", "k", "i", F.lit(None).cast("long").alias("j"), "x"))


def _moments(df: DataFrame, v: str, d: int, k: int, centre: np.ndarray, share) -> np.ndarray:
    """K x (1 + D + D*D): sums of shares, of centred values and of their products; one number more, the log-likelihood."""
    ship(df.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loglik = np.zeros((k, 1 + d + d * d)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("v").null_count:
                raise ValueError("a vector is null")
            x = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)
            g, ll = share(x, batch)
            loglik += float(ll.sum())
            for c in range(k):
                y = x - centre[c]
                w = y * g[:, c : c + 1]
                total[c] += np.concatenate([[g[:, c].sum()], w.sum(0), (w.T @ y).ravel()])
        flat = np.append(total.ravel(), loglik)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["cell", "x"])

    out = np.zeros(k * (1 + d + d * d) + 1)
    got = df.mapInArrow(partial, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
    out[got["cell"].to_numpy()] = got["x"].to_numpy()
    return out


def _m_step(sums: np.ndarray, centre: np.ndarray, compat: bool) -> tuple[Mixture, float]:
    k, d = centre.shape
    total = sums[:-1].reshape(k, -1)
    n = total[:, 0]
    pi, means, cov = np.zeros(k), np.zeros((k, d)), np.tile(np.eye(d), (k, 1, 1))
    for c in range(k):
        if n[c] > 0:
            shift = total[c, 1 : 1 + d] / n[c]
            means[c] = centre[c] + shift
            cov[c] = total[c, 1 + d :].reshape(d, d) / n[c] - np.outer(shift, shift)
            pi[c] = n[c] / n.sum()
    return Mixture.of(pi, means, cov, compat), float(sums[-1])


def m_step_labels(df: DataFrame, k: int, v: str = "v", label: str = "label", compat: bool = True) -> Mixture:
    """The mixture of hard labels 0..k-1; an empty component has weight 0, mean 0 and the identity."""
    d = dimension(df, v)
    r = df.agg(*(F.avg(F.element_at(F.col(v), i + 1)) for i in range(d))).first()
    centre = np.tile(np.array([x or 0.0 for x in r], float), (k, 1))

    def share(x: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return (batch.column("label").to_numpy(zero_copy_only=False)[:, None] == np.arange(k)).astype(float), np.zeros(len(x))

    return _m_step(_moments(df.select(F.col(v).cast("array<double>").alias("v"), F.col(label).alias("label")), "v", d, k, centre, share), centre, compat)[0]


def _pass(df: DataFrame, mixture: Mixture, compat: bool) -> tuple[Mixture, float]:
    """The next mixture, and the log-likelihood of this one: one job."""
    k, d = mixture.means.shape
    return _m_step(_moments(df, "v", d, k, mixture.means, lambda x, _: mixture.responsibilities(x, compat)), mixture.means, compat)


def log_likelihood(df: DataFrame, mixture: Mixture, v: str = "v", compat: bool = False) -> float:
    return _pass(df.select(F.col(v).cast("array<double>").alias("v")), mixture, compat)[1]


def e_step(df: DataFrame, mixture: Mixture, v: str = "v", compat: bool = False) -> DataFrame:
    """df with gamma, the responsibilities, and log_likelihood: one Arrow pass over the vectors alone."""
    ship(df.sparkSession)

    @pandas_udf("struct<gamma: array<double>, log_likelihood: double>")
    def shares(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"gamma": [], "log_likelihood": []})
        gamma, loglik = mixture.responsibilities(np.stack(vectors.to_numpy()).astype(float), compat)
        return pd.DataFrame({"gamma": list(gamma), "log_likelihood": loglik})

    kept = [c for c in df.columns if c not in ("gamma", "log_likelihood")]
    made = df.select(*kept, shares(F.col(v).cast("array<double>")).alias("_shares"))
    return made.select(*kept, "_shares.gamma", "_shares.log_likelihood")


def fit(df: DataFrame, k: int, v: str = "v", label: str = "label", tolerance: float = TOLERANCE, max_iter: int = 200, compat: bool = True) -> tuple[Mixture, float, int]:
    """Mixture, log-likelihood and iterations from hard labels.

    Stops when the log-likelihood changes by less than the tolerance. NaN
    raises. One job an iteration: the pass that gives a model's log-likelihood
    also gives the next model.
    """
    points = df.select(F.col(v).cast("array<double>").alias("v"), F.col(label).alias("label"))
    now = m_step_labels(points, k, compat=compat)
    points = points.select("v")  # labels are not made again in each pass
    following, loglik = _pass(points, now, compat)
    for i in range(1, max_iter + 1):
        before, now = loglik, following
        following, loglik = _pass(points, now, compat)
        if math.isnan(loglik):
            raise ValueError("the log-likelihood is NaN")
        if abs(loglik - before) < tolerance:
            return now, loglik, i
    return now, loglik, max_iter


def n_parameters(k: int, d: int) -> int:
    return k * d + k - 1 + k * d * (d + 1) // 2


def information_criterion(loglik: float, k: int, d: int, n: int, criterion: str = "aic") -> float:
    """2 p - 2 log L, or for "bic" p ln n - 2 log L."""
    return n_parameters(k, d) * (math.log(n) if criterion == "bic" else 2) - 2 * loglik


def _summed(points: DataFrame, partial: Callable[[np.ndarray], Iterator[tuple[int, int, np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
    """Of each (k, c) the sum over all vectors of the arrays that partial gives of some: one job, tasks add up their own first."""
    ship(points.sparkSession)
    schema = "k int, c int, x array<double>"

    def table(sums: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (k, c), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], ["k", "c", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("v").null_count:
                raise ValueError("a vector is null")
            for k, c, x in partial(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)):
                sums[k, c] = sums[k, c] + x if (k, c) in sums else x
        yield from table(sums)

    def add(t: pa.Table) -> pa.Table:
        x = np.asarray(t["x"].combine_chunks().flatten()).reshape(t.num_rows, -1).sum(0)
        return pa.Table.from_batches(table({(t["k"][0].as_py(), t["c"][0].as_py()): x}))

    parts = points.select("v").mapInArrow(run, schema)
    got = parts.groupBy("k", "c").applyInArrow(add, schema).toArrow()
    flat = got["x"].combine_chunks()
    values, edges = np.asarray(flat.values), flat.offsets.to_numpy()
    return {key: values[edges[i] : edges[i + 1]] for i, key in enumerate(zip(got["k"].to_pylist(), got["c"].to_pylist(), strict=True))}


def _starts(points: DataFrame, ks: list[int], turns: int) -> dict[int, np.ndarray]:
    """The centroids of kmeans.fit() from the first k samples for each k: all k in one job a turn, those in which no sample moves drop out."""
    first = kmeans.seeds(points, max(ks, default=0))
    now, before, going = {k: first[:k] for k in ks}, dict.fromkeys(ks), list(ks)
    for _ in range(turns):
        if not going:
            break
        asked = {k: (now[k], before[k]) for k in going}

        def partial(x: np.ndarray, asked=asked) -> Iterator[tuple[int, int, np.ndarray]]:
            for k, (centroids, old) in asked.items():
                label = _nearest(x, centroids)
                moved = len(x) if old is None else int((_nearest(x, old) != label).sum())
                yield k, -1, np.array([float(moved)])
                share = (label == np.arange(k)[:, None]).astype(float)
                for c, row in enumerate(np.concatenate([share.sum(1)[:, None], share @ x], 1)):
                    yield k, c, row

        got = _summed(points, partial)
        for k in going:
            if before[k] is None or got[k, -1][0]:
                before[k] = now[k]
                now[k] = np.array([got[k, c][1:] / got[k, c][0] if got[k, c][0] else now[k][c] for c in range(k)])
        going = [k for k in going if got[k, -1][0]]
    return now


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of each row's nearest centroid; of equals the lowest."""
    d2 = ((centroids**2).sum(1) - 2 * x @ centroids.T) + (x * x).sum(1)[:, None]
    near = d2 <= d2.min(1, keepdims=True) + 1e-9 * (1 + (x * x).sum(1)[:, None])
    rows = np.flatnonzero(near.sum(1) > 1)  # too near to tell by the product
    for c in np.flatnonzero(near[rows].any(0)):
        d2[rows, c] = ((x[rows] - centroids[c]) ** 2).sum(1)
    return np.where(near, d2, np.inf).argmin(1)


#: of some vectors the N x K shares and the N log-likelihoods
Shares = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _moments_all(points: DataFrame, centres: dict[int, np.ndarray], shares: dict[int, Shares], compat: bool) -> dict[int, tuple[Mixture, float]]:
    """The mixture of each k's shares, and the sum of log-likelihoods, all in one job."""
    d = next(iter(centres.values())).shape[1]
    at = np.tril_indices(d)

    def partial(x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        for k, share in shares.items():
            g, loglik = share(x)
            yield k, -1, np.array([float(loglik.sum())])
            for c in range(k):
                some = np.flatnonzero(g[:, c])  # the others add nothing
                if not len(some):
                    continue
                y, w = x[some] - centres[k][c], g[some, c]
                half = y * np.sqrt(w)[:, None]
                yield k, c, np.concatenate([[w.sum()], w @ y, (half.T @ half)[at]])

    got = _summed(points, partial)
    out = {}
    for k, centre in centres.items():
        full = np.zeros((k, 1 + d + d * d))
        for c in range(k):
            if (k, c) in got:
                product = np.zeros((d, d))
                product[at] = got[k, c][1 + d :]
                product += np.tril(product, -1).T
                full[c] = np.concatenate([got[k, c][: 1 + d], product.ravel()])
        loglik = got[k, -1] if (k, -1) in got else [0.0]
        out[k] = _m_step(np.append(full.ravel(), loglik), centre, compat)
    return out


def _pass_all(points: DataFrame, models: dict[int, Mixture], compat: bool) -> dict[int, tuple[Mixture, float]]:
    """_pass() of each mixture, all in one job."""
    used = {k: Mixture(m.pi, m.means, m.cov[:0], m.inverse, m.log_det) for k, m in models.items()}
    return _moments_all(points, {k: m.means for k, m in models.items()}, {k: lambda x, m=m: m.responsibilities(x, compat) for k, m in used.items()}, compat)


def _hard(centroids: np.ndarray) -> Shares:
    return lambda x: ((_nearest(x, centroids)[:, None] == np.arange(len(centroids))).astype(float), np.zeros(len(x)))


#: samples of a task at least, where all fits go through them together
LEAST_SAMPLES = 256


def select(df: DataFrame, labels: DataFrame | None = None, ks: Iterable[int] = range(1, 51), criterion: str = "aic", id_col: str = "id", v: str = "v", compat: bool = True, at_once: int = 4, max_iter: int = 200, start_turns: int = 100) -> DataFrame:
    """(k, ic, is_best, converged) for each number of components.

    labels holds (k, id, label); where it is missing, at most start_turns turns
    of k-means from the first k samples give them. A fit that max_iter ended is
    not converged. All fits take their turns together, one job a turn, and
    leave as they converge. Vectors and the labels of all K are joined once,
    and written; the turns read them from there.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "gmm")
    points = df.select(F.col(id_col).alias("id"), F.col(v).cast("array<double>").alias("v"))
    n, d, ks = points.count(), dimension(points), list(ks)
    if labels is not None:
        given = labels.where(F.col("k").isin(ks)).groupBy("id").agg(F.collect_list(F.struct("k", "label")).alias("given"))
        points = points.join(given, "id")
    points = scratch.write(points.repartition(max(min(spark.sparkContext.defaultParallelism, n // LEAST_SAMPLES), 1)), "points")

    def given_start(k: int) -> Mixture:
        mine = F.filter("given", lambda x: x["k"] == k)
        return m_step_labels(points.select("id", "v", F.explode(mine).alias("mine")).select("id", "v", "mine.label"), k, compat=compat)

    if labels is None:
        centroids = _starts(points, ks, start_turns)
        going = {k: m for k, (m, _) in _moments_all(points, centroids, {k: _hard(c) for k, c in centroids.items()}, compat).items()} if ks else {}
    else:
        with ThreadPoolExecutor(at_once) as pool:
            going = dict(zip(ks, pool.map(given_start, ks), strict=True))
    passed, found = _pass_all(points, going, compat) if going else {}, {}
    for i in range(1, max_iter + 1):
        if not going:
            break
        before, going = {k: passed[k][1] for k in going}, {k: passed[k][0] for k in going}
        passed = _pass_all(points, going, compat)
        for k in list(going):
            loglik = passed[k][1]
            if math.isnan(loglik):
                raise ValueError("the log-likelihood is NaN")
            if abs(loglik - before[k]) < TOLERANCE or i == max_iter:
                found[k] = loglik, i if abs(loglik - before[k]) < TOLERANCE else max_iter
                del going[k]
        scratch.release()
    found |= {k: (passed[k][1], max_iter) for k in going}
    got = [(k, information_criterion(found[k][0], k, d, n, criterion), found[k][1] < max_iter) for k in ks]
    scratch.clear()
    best = min(got, key=lambda x: (x[1], x[0]), default=(None,))[0]
    return spark.createDataFrame([(k, float(ic), k == best, done) for k, ic, done in got], "k int, ic double, is_best boolean, converged boolean")


def best_k(table: DataFrame) -> Column:
    """Aggregate over a criterion table: the k with the least criterion, the first of equals."""
    return F.min_by("k", F.struct("ic", "k"))
