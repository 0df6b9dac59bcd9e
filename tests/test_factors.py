"""t-SNE, robust components and non-negative factors on hand-size inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import nmf, r1pca, svd, tsne

SQUARES = [(0, 0), (1, 0), (0, 1), (1, 1), (10, 10), (11, 10), (10, 11), (11, 11)]
A = np.array([[1, 2, 0], [0, 1, 3], [2, 0, 1]], float)
W0, H0 = np.array([[1, 0.5], [0.5, 1], [1, 1]]), np.array([[1, 1, 0.5], [0.5, 0.5, 1]])


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, [float(x), float(y)]) for i, (x, y) in enumerate(SQUARES)], "id long, v array<double>").coalesce(1).cache()


def test_sigma_and_affinities(points):
    x = np.array(SQUARES, float)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    assert abs(tsne.find_sigma_local(d2, 3) - 2.978896831686) < 1e-6
    d = tsne.pair_distances(points).cache()
    p = tsne.pairs_to_matrix(map(tuple, tsne.affinities(d, 2.978896831686, 8).collect()), 8)
    assert abs(p.sum() - 1) < 1e-12 and np.allclose(p, p.T)
    assert np.allclose(p[0], [0, 0.0424411, 0.0424411, 0.04011491, 5.7e-7, 1.8e-7, 1.8e-7, 5e-8], atol=5e-7)
    assert abs(tsne.perplexity(tsne.conditional(d, 2.978896831686)).first()[0] - 3) < 1e-4
    assert tsne.perplexity(tsne.conditional(d, 1e-5)).first()[0] == 1.0  # a row of zeros counts 2 ** 0


def test_blocks_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5)) + 1e6
    x[50], x[51] = x[7], x[7] + 1e-4  # equal and almost equal, far from the origin
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 5), (500, None), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = [tuple(r) for r in tsne.pair_distances(df, block=16).collect()]
    want = [(i, j, float(((x[i] - x[j]) ** 2).sum())) for j in range(120) for i in range(j)]
    want += [(min(i, 7), max(i, 7), float(((x[i] - x[7]) ** 2).sum())) for i in range(120) if i != 7]
    assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(want)]
    assert np.allclose([r[2] for r in sorted(got)], [r[2] for r in sorted(want)], rtol=1e-6, atol=1e-12)
    assert tsne.pair_distances(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="vectors of"):
        tsne.pair_distances(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], df.schema))
    monkeypatch.setattr(tsne, "SEQUENTIAL_POINTS", 100)
    with pytest.raises(ValueError, match="jacobi"):
        tsne.tsne(df.where("id < 120 and v is not null").dropDuplicates(["id"]))


def test_plans_have_no_nested_loops(points):
    d = tsne.pair_distances(points)
    y = points.select("id", F.col("v").alias("y"))
    p, q = tsne.affinities(d, 3.0, 8), tsne.joint_q(y)
    for df in (d, p, tsne.conditional(d, 3.0), q, tsne.kl(p, q), tsne.gradient(p, q, y)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_q_and_gradient(spark):
    y = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, y array<double>")
    q = {(r["i"], r["j"]): r["q"] for r in tsne.joint_q(y).collect()}
    assert q[0, 1] == q[2, 0] == 0.1875 and abs(q[1, 2] - 0.125) < 1e-15
    p = spark.createDataFrame([(i, j, 1 / 6) for i in range(3) for j in range(3) if i != j], "i long, j long, p double")
    assert abs(tsne.kl(p, tsne.joint_q(y)).first()[0] - sum(1 / 6 * math.log(1 / 6 / v) for v in q.values())) < 1e-12
    g = {r["i"]: r["grad"] for r in tsne.gradient(p, tsne.joint_q(y), y).collect()}
    assert np.allclose(g[0], [(1 / 6 - 0.1875) / 2 * -1] * 2)


def test_embedding(points, spark):
    init = tsne.start(points, seed=3)
    assert init.orderBy("id").collect() == tsne.start(points.repartition(5), seed=3).orderBy("id").collect()
    y = {r["id"]: np.array(r["y"]) for r in tsne.tsne(points, target=3, seed=3, max_iter=300).collect()}
    near = np.mean([np.linalg.norm(y[i] - y[j]) for i in range(4) for j in range(i)])
    far = np.mean([np.linalg.norm(y[i] - y[j]) for i in range(4) for j in range(4, 8)])
    assert len(y) == 8 and far > near
    rng = np.random.default_rng(0)
    p = np.ones((5, 5)) / 20 - np.eye(5) / 20
    _, _, n = tsne.descend(p, rng.normal(size=(5, 2)))
    assert (n - 1) % 100 == 0
    moved = tsne.tsne(points, target=3, seed=3, max_iter=2, mode="jacobi").collect()
    assert len(moved) == 8


def test_find_sigma_in_spark(points, monkeypatch):
    monkeypatch.setattr(tsne, "SIGMA_WIDTH", 30.0)
    assert tsne.find_sigma(tsne.pair_distances(points), 3) == (tsne.LOW_SIGMA + 50.000005) / 2


@pytest.fixture
def many(spark, monkeypatch):
    """300 points with an embedding, in blocks of some 32."""
    monkeypatch.setattr(tsne, "SMALL", 32)
    monkeypatch.setattr(tsne, "TILE", 500)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 6)), rng.normal(size=(300, 2))
    return x, y, spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(300)], "id long, v array<double>, y array<double>").cache()


def _written(monkeypatch):
    """The names of tables that t-SNE writes from here on."""
    names, write = [], tsne.Scratch.write
    monkeypatch.setattr(tsne.Scratch, "write", lambda self, df, name: names.append(name) or write(self, df, name))
    return names


def test_pairs_are_not_written(many, monkeypatch):
    x, y, df = many
    names = _written(monkeypatch)
    assert tsne.pair_distances(df).count() == tsne.joint_q(df).count() / 2 == 300 * 299 / 2
    q = tsne.pairs_to_matrix([(r["i"], r["j"], r["q"]) for r in tsne.joint_q(df).collect()], 300)
    a = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2)) - np.eye(300)
    assert np.allclose(q, a / a.sum(), rtol=1e-12) and not names


def test_affinities_of_points(many, monkeypatch):
    x, _, df = many
    want = tsne.pairs_to_matrix(map(tuple, tsne.affinities(tsne.pair_distances(df).cache(), 1.1, 300).collect()), 300)
    names = _written(monkeypatch)
    got = tsne.point_affinities(df, 1.1, 300).collect()
    assert len(got) == 300 * 299 and np.allclose(tsne.pairs_to_matrix(map(tuple, got), 300), want, rtol=1e-9, atol=0) and not names
    none = tsne.point_affinities(df, 1e-5, 300).collect()  # a row of zeros stays
    assert len(none) == 300 * 299 and not any(r["p"] for r in none)


def test_divergence_and_gradient_of_points(many, monkeypatch):
    _, _, df = many
    p, q = tsne.point_affinities(df, 1.1, 300).cache(), tsne.joint_q(df).cache()
    kl = tsne.kl(p, q).first()[0]
    want = {r["i"]: r["grad"] for r in tsne.gradient(p, q, df).collect()}
    names = _written(monkeypatch)
    assert abs(tsne.point_kl(df, 1.1, 300).first()[0] - kl) < 1e-11
    got = {r["i"]: r["grad"] for r in tsne.point_gradient(df, 1.1, 300).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], rtol=1e-9, atol=1e-14) for i in want) and not names


def test_perplexity_of_points(many):
    _, _, df = many
    d = tsne.pair_distances(df).cache()
    for sigma in (0.02, 0.3, 1.1, 40.0):
        assert abs(tsne.point_perplexity(df, sigma).first()[0] - tsne.perplexity(tsne.conditional(d, sigma)).first()[0]) < 1e-9
    assert tsne.point_perplexity(df, 1e-5).first()[0] == 1.0
    assert tsne.point_perplexity(df.limit(1), 1.0).first()[0] is None


def test_sigma_of_points(many, points, monkeypatch):
    x, _, df = many
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    asked, looked = [], tsne._perplexities
    monkeypatch.setattr(tsne, "_perplexities", lambda cells, sigmas: asked.append(sigmas) or looked(cells, sigmas))
    assert tsne.point_sigma(df, 10.0) == tsne.find_sigma_local(d2, 10.0)
    assert len(asked) < 16  # a bisection takes 30
    monkeypatch.setattr(tsne, "SIGMA_WIDTH", 30.0)
    assert tsne.point_sigma(points, 3) == tsne.find_sigma(tsne.pair_distances(points), 3)


def test_a_vector_goes_to_few_cells(spark):
    """Of a table that fits in small blocks a vector is shuffled eight times, not sixteen, and a cell is a task."""
    df = spark.range(5000).selectExpr("id", "array(double(id), 1D) as v")
    cells = tsne._cells(tsne._rows(df, "id", "v"))
    assert cells.rdd.getNumPartitions() == 36
    rows = cells.selectExpr("length(ids) div 8 as n", "length(ids2) div 8 as m").collect()
    assert len(rows) == 36 and sum(r.n for r in rows if r.m is None) == 5000 and sum(r.n + (r.m or 0) for r in rows) == 8 * 5000
    assert sum(r.n * r.m if r.m else r.n * (r.n - 1) // 2 for r in rows) == 5000 * 4999 // 2


def test_pairs_are_rounded_where_they_are_made(many):
    """As SQL rounds: the whole number over a power of ten, halves up; the plan has no decimal rounding of rows."""
    x = np.array([0.0, 4.9999995e-7, 5e-7, 0.1234565, 1.0000004999, 7.25])
    assert tsne.rounded(x, 6).tolist() == [0.0, 0.0, 1e-6, np.floor(0.1234565 * 1e6 + 0.5) / 1e6, 1.0, 7.25] and tsne.rounded(x, None) is x
    _, _, df = many
    for made, exact, c, times in (
        (tsne.pair_distances(df, digits=3), tsne.pair_distances(df), "d2", 1),
        (tsne.point_affinities(df, 1.1, 300, times=1000, digits=3), tsne.point_affinities(df, 1.1, 300), "p", 1000),
        (tsne.joint_q(df, times=1000, digits=3), tsne.joint_q(df), "q", 1000),
    ):
        got, want = ({(r["i"], r["j"]): r[c] for r in f.collect()} for f in (made, exact))
        assert got.keys() == want.keys() and all(abs(got[k] - times * want[k]) < 0.0005001 and round(got[k], 3) == got[k] for k in got)
    from tessera.plans import registry

    for name in ("sq_dist_pairs", "tsne_affinity", "tsne_q"):
        assert "round(" not in registry.QUERIES[name](df.sparkSession, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_bandwidths_of_near_and_far_points(spark):
    """Affinities that are 0 or denormal add what they are, in the pass that has them and in the quick one that has none."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(40, 2)), rng.normal(size=(40, 2)) + 40])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()
    d = tsne.pair_distances(df).cache()
    for sigma in (0.03, 0.7, 1.05, 50.0):
        assert abs(tsne.point_perplexity(df, sigma).first()[0] - tsne.perplexity(tsne.conditional(d, sigma)).first()[0]) < 1e-9


def test_many_points_are_embedded(points, monkeypatch):
    few = tsne.tsne(points, target=3, seed=3, max_iter=2, mode="auto").orderBy("id").collect()
    assert few == tsne.tsne(points, target=3, seed=3, max_iter=2).orderBy("id").collect()
    monkeypatch.setattr(tsne, "SEQUENTIAL_POINTS", 7)
    got = tsne.tsne(points, target=3, seed=3, max_iter=2, mode="auto").orderBy("id").collect()
    assert len(got) == 8 and got != few and np.isfinite([r["y"] for r in got]).all()


def test_robust_components(spark):
    x = [(3, 0.1), (2, -0.2), (-1, 0.1), (-2, 0.3), (0.5, 5)]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, v array<double>").cache()
    u = np.array([[1.0], [0.0]])
    r = [a["residual"] for a in r1pca.residuals(df, u).orderBy("id").collect()]
    assert np.allclose(r, [0.1, 0.2, 0.1, 0.3, 5])
    c = r1pca.weighted_covariance(df, u, 0.2)
    assert np.allclose(c, [[16.67666667, -0.5], [-0.5, 1.12]])
    step = r1pca.orthonormal(c @ u)
    assert np.allclose(np.abs(step.ravel()), [0.99955084, 0.02996854])
    got = r1pca.fit(df, 1)
    assert np.allclose(got.u.T @ got.u, 1) and got.errors[-1] >= got.errors[-2] or len(got.errors) > 100
    assert np.allclose([s["score"][0] for s in got.scores.orderBy("id").collect()], np.array(x) @ got.u[:, 0])
    with pytest.raises(ValueError, match="subspace"):
        r1pca.weighted_covariance(df.union(spark.createDataFrame([(9, [1.0, 0.0])], df.schema)), u, 0.2)
    with pytest.raises(ValueError, match="basis"):
        r1pca.residuals(df, np.ones((3, 1)))


def tables(spark):
    a = spark.createDataFrame([(i, j, float(A[i, j])) for i in range(3) for j in range(3) if A[i, j]], "i long, j long, x double")
    w = spark.createDataFrame([(i, W0[i].tolist()) for i in range(3)], "i long, w array<double>")
    h = spark.createDataFrame([(j, H0[:, j].tolist()) for j in range(3)], "j long, h array<double>")
    return a, w, h


def arrays(w, h):
    return np.array([r["w"] for r in w.orderBy("i").collect()]), np.array([r["h"] for r in h.orderBy("j").collect()]).T


def test_nmf_goldens(spark):
    a, w, h = tables(spark)
    assert abs(nmf.loss(a, w, h, 2) - 8.4375) < 1e-12
    for mode, want, end in (("compat", [[1.171875, 0.36737001], [0.54787593, 1.580959], [0.77454719, 0.70498915]], 5.572897002300), ("lee_seung", [[1.14085125, 0.26048336], [0.51561725, 1.72125288], [0.82838687, 0.70393416]], 5.215394510532)):
        w1, h1 = nmf.update(a, w, h, 2, mode)
        got_w, got_h = arrays(w1, h1)
        assert np.allclose(got_h, [[0.92307692, 0.76923077, 0.4], [0.4, 0.32, 1.23076923]]) and np.allclose(got_w, want)
        assert abs(nmf.loss(a, w1, h1, 2) - end) < 1e-9


def test_nndsvd_and_fit(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random((7, 4)) * (rng.random((7, 4)) > 0.3), 3)
    for m in (x, x.T):
        a = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, x double")
        w, h = arrays(*nmf.nndsvd(a, 3, *m.shape))
        u, s, vt = np.linalg.svd(m)
        assert np.allclose(w[:, 0], np.sqrt(s[0]) * np.abs(u[:, 0])) and np.allclose(h[0], np.sqrt(s[0]) * np.abs(vt[0]))
        assert (w >= 0).all() and (h >= 0).all()
        for c in (1, 2):
            pos, neg = np.maximum(u[:, c], 0), np.maximum(-u[:, c], 0)
            vp, vn = np.maximum(vt[c], 0), np.maximum(-vt[c], 0)
            t = max((np.linalg.norm(pos) * np.linalg.norm(vp), 0), (np.linalg.norm(neg) * np.linalg.norm(vn), 1))
            uu, vv = ((pos, vp), (neg, vn))[t[1]]
            assert np.allclose(w[:, c], np.sqrt(s[c] * t[0]) * uu / np.linalg.norm(uu)) and np.allclose(h[c], np.sqrt(s[c] * t[0]) * vv / np.linalg.norm(vv))
    f = nmf.fit(a, 2, *m.shape, err=1e-3, mode="lee_seung", max_iter=6)
    wf, hf = arrays(f.w, f.h)
    assert abs(f.loss - ((m - wf @ hf) ** 2).sum()) < 1e-9 and f.rounds >= 1 and (wf >= 0).all()
    one = nmf.fit(a, 1, *m.shape, max_iter=2)
    assert len(one.w.first()["w"]) == 1
    with pytest.raises(ValueError, match="negative"):
        nmf.fit(spark.createDataFrame([(0, 0, -1.0)], "i long, j long, x double"), 1, 1, 1)


def test_cross_validation(spark):
    a, _, _ = tables(spark)
    folds = nmf.cell_folds(3, 3, 2, spark)
    assert folds.count() == 9 and folds.select("i", "j").distinct().count() == 9
    got = nmf.cross_validate(a, 3, 3, ks=(1,), folds=2, max_iter=2, at_once=2).collect()
    assert len(got) == 1 and got[0]["cve"] > 0


def cells(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, x double")


def dense(df, key, n):
    rows = {r[key]: r["v"] for r in df.collect()}
    width = max(map(len, rows.values()), default=0)
    return np.array([rows.get(i, [0.0] * width) for i in range(n)])


def test_svd_equals_numpy(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 45)) * (rng.random((60, 45)) > 0.6)
    m[7] = 0
    low = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 40))
    for x, k in ((m, 5), (low, 4)):
        got = svd.svd(cells(spark, x), k)
        u, s, vt = np.linalg.svd(x)
        rank = min(k, np.linalg.matrix_rank(x))
        assert got.converged and len(got.s) == rank and np.allclose(got.s, s[:rank], rtol=1e-9)
        left, right = dense(got.u, "i", x.shape[0]), dense(got.v, "j", x.shape[1])
        assert np.allclose(left.T @ left, np.eye(rank), atol=1e-8) and np.allclose(right.T @ right, np.eye(rank), atol=1e-8)
        assert np.allclose(left * got.s @ right.T, u[:, :rank] * s[:rank] @ vt[:rank], atol=1e-5)


def test_svd_odd_matrices(spark):
    twice = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 1, 0.0), (1, 2, None)], "i long, j long, x double")
    assert np.allclose(svd.svd(twice, 2).s, [3.0])
    assert len(svd.svd(twice.limit(0), 2).s) == 0
    with pytest.raises(ValueError, match="at least one"):
        svd.svd(twice, 0)


def test_svd_of_many_columns(spark):
    """100,000 columns: their Gram matrix would have 10^10 cells."""
    n, rows = 100_000, 400
    # two blocks of rows and columns apart, so that two values stand out
    base = spark.range(n * 4).select((F.col("id") % n).alias("j"), (F.pmod(F.xxhash64("id"), F.lit(200)) + F.when(F.col("id") % n < 60_000, 0).otherwise(200)).alias("i"))
    a = base.groupBy("i", "j").agg(F.count("*").cast("double").alias("x")).cache()
    got = svd.svd(a, 2, tol=1e-3)
    table = a.toPandas()
    m = np.zeros((rows, n), np.float32)
    m[table["i"], table["j"]] = table["x"]
    want = np.sqrt(np.sort(np.linalg.eigvalsh(m.astype(float) @ m.T))[::-1][:2])
    assert np.allclose(got.s, want, rtol=1e-3) and got.v.count() == n
    w, h = nmf.nndsvd(a, 1, rows, n)
    assert w.count() == rows and h.count() == n
    a.unpersist()
