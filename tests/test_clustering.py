"""K-means and mixtures on hand-size inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import gmm, kmeans, linalg

SQUARES = [(0, 0), (1, 0), (0, 1), (1, 1), (10, 10), (11, 10), (10, 11), (11, 11)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, [float(x), float(y)], int(i > 3)) for i, (x, y) in enumerate(SQUARES)], "id long, v array<double>, label int").cache()


def test_kmeans(points, spark):
    centroids, rounds = kmeans.fit(points, 2)
    assert sorted(map(tuple, centroids.tolist())) == [(0.5, 0.5), (10.5, 10.5)] and rounds < 10
    first = kmeans.assign(points, kmeans.seeds(points, 2))
    after = kmeans.assign(points, centroids)
    assert kmeans.changed(first, after).first()[0] is True and kmeans.changed(after, after).first()[0] is False
    means = {r["label"]: (r["n"], r["mean"]) for r in kmeans.update(points, 2).collect()}
    assert means == {0: (4, [0.5, 0.5]), 1: (4, [10.5, 10.5])}
    tie = spark.createDataFrame([(0, [0.0])], "id long, v array<double>")
    assert kmeans.assign(tie, np.array([[1.0], [-1.0]])).first()["label"] == 0
    nan = np.array([[math.nan], [3.0]])
    assert kmeans.assign(tie, nan).first()["label"] == 1 and kmeans.assign(tie, nan, compat=True).first()["label"] == 0
    with pytest.raises(ValueError):
        kmeans.seeds(tie, 2)


def test_empty_cluster(spark):
    same = spark.createDataFrame([(i, [1.0]) for i in range(3)] + [(3, [5.0])], "id long, v array<double>")
    fixed, _ = kmeans.fit(same, 3)
    assert not np.isnan(fixed).any()
    assert np.isnan(kmeans.fit(same, 3, max_iter=1, compat=True)[0]).any()


def test_mixture_goldens(points):
    for k, loglik, aic, bic in ((1, -32.825881274552, 75.651762549104, 76.048970257503), (2, -17.157839086795, 56.315678173590, 57.189535132069)):
        m, got, rounds = gmm.fit(points.withColumn("label", F.col("label") % k), k)
        assert abs(got - loglik) < 1e-9 and rounds == 1
        assert abs(gmm.information_criterion(got, k, 2, 8) - aic) < 1e-9 and abs(gmm.information_criterion(got, k, 2, 8, "bic") - bic) < 1e-9
        assert abs(gmm.log_likelihood(points, m) - got) < 1e-9
        rows = gmm.e_step(points, m).collect()
        assert all(abs(sum(r["gamma"]) - 1) < 1e-12 for r in rows) and abs(sum(r["log_likelihood"] for r in rows) - got) < 1e-9
    table = gmm.select(points, ks=(1, 2, 3))
    assert table.agg(gmm.best_k(table)).first()[0] == table.where("is_best").first()["k"]
    ics = {r["k"]: r["ic"] for r in gmm.select(points, ks=(1, 2)).collect()}
    assert abs(ics[2] - 56.315678173590) < 1e-6 and abs(ics[1] - 75.651762549104) < 1e-6


def test_degenerate_and_empty_components(spark):
    same = spark.createDataFrame([(i, [2.0, 2.0], 0) for i in range(3)], "id long, v array<double>, label int")
    m = gmm.m_step_labels(same, 2)
    assert m.log_det[0] == 1.0 and (m.cov[0] == np.eye(2)).all() and m.means[0].tolist() == [2.0, 2.0]
    assert m.pi.tolist() == [1.0, 0.0] and m.means[1].tolist() == [0.0, 0.0]
    assert gmm.m_step_labels(same, 2, compat=False).log_det[0] == 0.0
    rows = gmm.e_step(same, m).collect()
    assert all(r["gamma"] == [1.0, 0.0] for r in rows)
    assert len(m.table(spark).collect()) == 2


def test_likelihood_never_falls(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (60, 2)), rng.normal(4, 0.5, (40, 2))])
    df = spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "id long, v array<double>, label int").coalesce(2).cache()
    seen = [gmm.fit(df, 2, max_iter=i, tolerance=0)[1] for i in (1, 2, 4, 8)]
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:], strict=False))


def test_dump(spark):
    x = [[0.0, 0.0], [0.2, 0.1], [0.1, 0.3], [9.0, 9.0], [9.2, 9.1], [9.1, 8.8]]
    df = spark.createDataFrame([(i + 10, v, i // 3) for i, v in enumerate(x)], "id long, v array<double>, label int")
    m = gmm.m_step_labels(df, 2)
    got = {(r.part, r.k, r.i, r.j): r.x for r in gmm.dump(df, m).collect()}
    gamma = {key: v for key, v in got.items() if key[0] == "gamma"}
    assert set(gamma) == {("gamma", i // 3, i + 10, None) for i in range(6)} and all(abs(v - 1) < 1e-4 for v in gamma.values())
    assert got["pi", 1, None, None] == 0.5 and np.isclose(got["cov", 0, 0, 1], m.cov[0, 0, 1]) and len(got) == 2 * (2 + 2 + 4) + 6
    table = gmm.select(df.drop("label"), df.selectExpr("2 as k", "id", "label"), ks=[2], max_iter=1)
    assert [r.converged for r in table.collect()] == [False]
    assert gmm.select(df.drop("label"), df.selectExpr("2 as k", "id", "label"), ks=[2]).first().converged


def test_labels_are_joined_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) + 4 * (np.arange(60) % 2)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    labels = spark.range(60).selectExpr("explode(array(1, 2, 3)) as k", "id").selectExpr("k", "id", "cast(id % k as int) as label")
    one = {k: gmm.information_criterion(gmm.fit(df.join(labels.where(f"k = {k}"), "id"), k, max_iter=4)[1], k, 3, 60) for k in (1, 2)}
    plans, moments = [], gmm._moments
    monkeypatch.setattr(gmm, "_moments", lambda df, *rest: plans.append((df._jdf.queryExecution().optimizedPlan().toString(), df.columns)) or moments(df, *rest))
    got = {r["k"]: r["ic"] for r in gmm.select(df, labels, ks=(1, 2), max_iter=4).collect()}
    assert got.keys() == one.keys() and all(abs(got[k] - one[k]) < 1e-8 for k in one)
    assert plans and not any("Join" in p for p, _ in plans)
    assert sum("label" in c for _, c in plans) == 2  # the first step of each fit alone reads labels


def test_log_densities_take_a_product_a_component():
    rng = np.random.default_rng(4)
    x, a = rng.normal(size=(50, 6)), rng.normal(size=(3, 6, 6))
    cov = a @ a.transpose(0, 2, 1) + np.eye(6)
    m = gmm.Mixture.of(np.ones(3) / 3, rng.normal(size=(3, 6)), cov)
    want = [[-0.5 * (m.log_det[k] + 6 * np.log(2 * np.pi) + (r - m.means[k]) @ m.inverse[k] @ (r - m.means[k])) for k in range(3)] for r in x]
    assert np.allclose(m.log_densities(x), want, rtol=1e-12)


def test_negative_form(spark):
    bad = gmm.Mixture(np.array([1.0]), np.zeros((1, 1)), np.eye(1)[None], -np.eye(1)[None], np.zeros(1))
    assert bad.log_densities(np.ones((1, 1)))[0, 0] == -np.inf
    assert bad.log_densities(np.ones((1, 1)), compat=True)[0, 0] == gmm.TINY


def test_linalg(spark, points):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "i long, j long, x double")
    assert sorted(map(tuple, linalg.matmul(a, linalg.transpose(a)).collect())) == [(0, 0, 5.0), (0, 1, 6.0), (1, 0, 6.0), (1, 1, 9.0)]
    assert sorted(map(tuple, linalg.elementwise(a, a, lambda x, y: x * y).collect())) == [(0, 0, 1.0), (0, 1, 4.0), (1, 1, 9.0)]
    x = np.array(SQUARES, float)
    assert np.allclose(linalg.gram(points), x.T @ x)
    u = linalg.left_vectors(points, 2)
    assert np.allclose(u.T @ u, np.eye(2)) and np.allclose(np.abs(u[:, 0] @ np.linalg.svd(x.T)[0][:, 0]), 1)
    got = points.select(linalg.project(F.col("v"), u).alias("p")).collect()
    assert np.allclose([r["p"] for r in got], x @ u)


def test_all_k_together_are_the_separate_fits(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(5 * c, 1, (40, 3)) for c in range(3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4).cache()
    starts = {k: kmeans.fit(df, k, 5)[0] for k in (1, 2, 4)}
    got = gmm._starts(df, [1, 2, 4], 5)
    assert all(np.allclose(got[k], starts[k], rtol=1e-12) for k in starts)
    table = {r["k"]: (r["ic"], r["converged"]) for r in gmm.select(df, ks=(1, 2, 4), start_turns=5, max_iter=30).collect()}
    for k, start in starts.items():
        _, loglik, rounds = gmm.fit(kmeans.assign(df, start), k, max_iter=30)
        assert abs(table[k][0] - gmm.information_criterion(loglik, k, 3, 120)) < 1e-6 and table[k][1] == (rounds < 30)


def test_choices_of_k_are_whole(spark, sf, monkeypatch):
    """All K from 1 to 50 are fitted, to the end."""
    from tessera.plans import registry

    asked = []
    monkeypatch.setattr(gmm, "select", lambda df, labels=None, **limits: asked.append((df, labels, limits)))
    registry.QUERIES["gmm_select_k"](spark, sf)
    registry.QUERIES["gmm_select_labels"](spark, sf)
    assert [limits for *_, limits in asked] == [{}, {}] and asked[0][1] is None
    each = {r["k"]: (r["n"], r["most"], r["kinds"]) for r in asked[1][1].groupBy("k").agg(F.count("*").alias("n"), F.max("label").alias("most"), F.countDistinct("label").alias("kinds")).collect()}
    assert each == {k: (asked[0][0].count(), k - 1, k) for k in range(1, 51)}
