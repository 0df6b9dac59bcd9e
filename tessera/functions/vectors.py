"""Vector expressions over ARRAY<DOUBLE> columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOr = Column | str


def _c(x: ColumnOr) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_vector(x: ColumnOr, dims: int | None = None) -> Column:
    """An array of numbers as doubles, with its first dims values only if asked for."""
    v = _c(x).cast("array<double>")
    return v if dims is None else F.slice(v, 1, dims)


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def total(x: ColumnOr) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(a: ColumnOr, b: ColumnOr) -> Column:
    """Sum of products; the vectors must have one length."""
    return total(_zip(_c(a), _c(b), lambda x, y: x * y))


def sq_dist(a: ColumnOr, b: ColumnOr) -> Column:
    """Squared Euclidean distance; the vectors must have one length."""
    return total(_zip(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def _zip(a: Column, b: Column, f) -> Column:
    same = F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.coalesce(same, F.raise_error(F.lit("vectors differ in length")).cast("array<double>")))


def norm(x: ColumnOr) -> Column:
    return F.sqrt(dot(x, x))


def positive_part(x: ColumnOr) -> Column:
    return F.transform(_c(x), lambda v: F.greatest(v, F.lit(0.0)))


def negative_part(x: ColumnOr) -> Column:
    return F.transform(_c(x), lambda v: F.greatest(-v, F.lit(0.0)))


def clamp_small(x: ColumnOr, limit: float = 1e-10) -> Column:
    """Values under the limit become 0."""
    return F.transform(_c(x), lambda v: F.when(v < limit, F.lit(0.0)).otherwise(v))


def scale(x: ColumnOr, by: ColumnOr) -> Column:
    return F.transform(_c(x), lambda v: v * _c(by))


def safe_log(x: Column) -> Column:
    """Natural logarithm with log(0) = -Infinity, where Spark's gives null."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def weighted_log_sum_exp(logs: ColumnOr, weights: Sequence[float] | Column) -> Column:
    """log of the sum of weight * exp(log), shifted by the largest log whose weight isn't 0."""
    w = literal(weights) if not isinstance(weights, Column) else weights
    used = F.filter(F.arrays_zip(_c(logs).alias("l"), w.alias("w")), lambda x: x["w"] > 0)
    top = F.array_max(F.transform(used, lambda x: x["l"]))
    return top + F.ln(F.aggregate(used, F.lit(0.0), lambda a, x: a + x["w"] * F.exp(x["l"] - top)))


def gaussian_affinity(squared: Column, sigma: float) -> Column:
    return F.exp(-squared / F.lit(2.0 * sigma * sigma))


def student_affinity(squared: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + squared)


def entropy_term(p: Column) -> Column:
    """p log2 p, 0 at p = 0."""
    return F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))


def kl_term(p: Column, q: Column) -> Column:
    """p (ln p - ln q), 0 at p = 0."""
    return F.when(p > 0, p * (F.ln(p) - safe_log(q))).otherwise(F.lit(0.0))


def huber_weight(residual: Column, c: float | Column) -> Column:
    """1 up to c, beyond it c / residual."""
    limit = c if isinstance(c, Column) else F.lit(float(c))
    return F.when(residual <= limit, F.lit(1.0)).otherwise(limit / residual)


def normal_log_density(x: ColumnOr, mean: Sequence[float], inverse: Sequence[Sequence[float]], log_det: float, compat: bool = False) -> Column:
    """Log density of a multivariate normal with the given inverse covariance.

    A negative quadratic form (the matrix isn't positive semidefinite) gives
    -Infinity, or, with compat, the smallest positive double.
    """
    d = len(mean)
    diff = [F.element_at(_c(x), i + 1) - F.lit(float(mean[i])) for i in range(d)]
    form = sum((diff[i] * diff[j] * F.lit(float(inverse[i][j])) for i in range(d) for j in range(d)), F.lit(0.0))
    import math

    bad = F.lit(2.2250738585072014e-308 if compat else float("-inf"))
    return F.when(form < 0, bad).otherwise(F.lit(-0.5) * (F.lit(float(log_det) + d * math.log(2 * math.pi)) + form))


def adapt_rate(rate: Column, bar: Column, gradient: Column) -> tuple[Column, Column]:
    """Delta-bar-delta: the new rate and the new averaged gradient (Jacobs 1988)."""
    agree = gradient * bar
    new = F.when(agree > 0, rate + 100.0).when(agree < 0, rate * 0.5).otherwise(rate)
    return new, gradient * 0.5 + bar * 0.5
