"""Named queries over the driver's tables: one or more for each operator.

Vectors are the embeddings as doubles. Mixtures are fitted in all their
coordinates (gmm_mstep_all, gmm_fit, gmm_select_k, gmm_select_labels); the other
mixture queries are of the plane of the first two, where SQL can check every
number.
Sequences are the letters A, C, G and T of a whole text. Results are rounded to six
decimals, with +0.0 so that -0.0 doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing, sequences as sq, vectors as vec
from tessera.operators import alignment as al
from tessera.operators import gmm, kmeans, linalg, nmf, ordering, r1pca, svd, tsne
from tessera.runtime import Scratch, ship
from tessera.sources import fasta

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: coordinates, bandwidth, ranks
DIMS, SIGMA, RANK = 64, 0.17, 2


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def rounded_array(x: Column) -> Column:
    return F.transform(x, rounded)


def embeddings(spark: SparkSession, sf: str, dims: int | None = None) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vec.as_vector("embedding", dims).alias("v"), "label")


def plane(df: DataFrame) -> DataFrame:
    """Points with their first two coordinates as an embedding."""
    return df.select("id", F.slice("v", 1, 2).alias("y"))


def seqs(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    rows = table(spark, sf, name).select(F.col(key).alias("name"), sq.dna(F.col("text")).alias("seq"))
    return rows.where(F.length("seq") > 0)


# nearest centroids, k-means


@query
def nn_centroid_assign(spark, sf):
    df = embeddings(spark, sf)
    d = F.array(*(vec.sq_dist("v", vec.literal(c)) for c in kmeans.seeds(df, 10)))
    return df.select("id", (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("label"), rounded(F.array_min(d)).alias("distance"))


@query
def kmeans_update_step(spark, sf):
    df = embeddings(spark, sf)
    got = kmeans.update(kmeans.assign(df.drop("label"), kmeans.seeds(df, 10)), 64)
    return got.select("label", "n", F.posexplode("mean").alias("dim", "x")).select("label", "n", "dim", rounded(F.col("x")).alias("x"))


@query
def kmeans_changed(spark, sf):
    df = embeddings(spark, sf).drop("label")
    first = kmeans.seeds(df, 5)
    second, _ = kmeans.fit(df, 5, 1)
    return kmeans.changed(kmeans.assign(df, first), kmeans.assign(df, second))


@query
def kmeans_fit_3iter(spark, sf):
    df = embeddings(spark, sf).drop("label")
    centroids, _ = kmeans.fit(df, 3, 3)
    rows = [(k, d, float(centroids[k, d])) for k in range(3) for d in range(DIMS)]
    return spark.createDataFrame(rows, "k int, dim int, x double").withColumn("x", rounded(F.col("x")))


# vectors, sequences, hashes, orders


@query
def sq_dist_pairs(spark, sf):
    return tsne.pair_distances(embeddings(spark, sf), digits=6)


@query
def vector_parts(spark, sf):
    v = F.col("v")
    return embeddings(spark, sf).select("id", rounded(vec.norm(v)).alias("norm"), rounded(vec.norm(vec.positive_part(v))).alias("positive"), rounded(vec.norm(vec.negative_part(v))).alias("negative"), rounded(vec.total(vec.clamp_small(v))).alias("clamped"))


@query
def log_sum_exp(spark, sf):
    return embeddings(spark, sf).select("id", rounded(vec.weighted_log_sum_exp(F.col("v"), [(i + 1) / (DIMS * (DIMS + 1) / 2) for i in range(DIMS)])).alias("lse"))


@query
def adaptive_rates(spark, sf):
    """The rate and the averaged gradient after every coordinate of a vector, taken as gradients."""
    start = F.struct(F.lit(100.0).alias("rate"), F.lit(0.0).alias("bar"))

    def step(s: Column, g: Column) -> Column:
        rate, bar = vec.adapt_rate(s["rate"], s["bar"], g)
        return F.struct(rate.alias("rate"), bar.alias("bar"))

    done = embeddings(spark, sf).select("id", F.aggregate("v", start, step).alias("s"))
    return done.select("id", rounded(F.col("s.rate")).alias("rate"), rounded(F.col("s.bar")).alias("bar"))


@query
def seq_encode(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", sq.encode(F.col("text")).alias("codes"))


@query
def seq_revcomp(spark, sf):
    seq = sq.dna(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", sq.reverse_complement(seq).alias("rc"), sq.reverse_complement_codes(sq.encode(seq)).alias("rc_codes"), sq.reverse_prefix(seq, 10).alias("prefix"))


@query
def match_scores(spark, sf):
    """Of each text the sums of plain and coded scores of all neighbouring characters."""
    return al.neighbour_scores(table(spark, sf, "documents"), "doc_id")


@query
def hash64_keys(spark, sf):
    return hashing.hash_64_table(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query
def sort_pairs(spark, sf):
    """Rank of each pair in unsigned order; ranks come from a range sort, not from one task."""
    pairs = table(spark, sf, "orders").select((F.col("o_orderkey") - 1000).alias("x"), F.col("o_custkey").alias("y"))
    return ordering.ranked(pairs, ordering.unsigned(F.col("x")), F.col("y"))


@query
def kth_smallest(spark, sf):
    return ordering.kth_smallest(table(spark, sf, "lineitem"), "l_extendedprice", 1000)


@query
def top_k(spark, sf):
    df = table(spark, sf, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return ordering.smallest(df, 25, "l_extendedprice", "l_orderkey", "l_linenumber")


@query
def median_exact(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(rounded(ordering.median("l_extendedprice")).alias("median"))


# alignment


@query
def sw_linear_score(spark, sf):
    hits = al.linear_scores(seqs(spark, sf, "benchmark", "item_id"), seqs(spark, sf, "documents", "doc_id"))
    return hits.groupBy("t_name").agg(F.count("*").alias("pairs"), F.sum("score").cast("long").alias("total"), F.max("score").alias("best"))


@query
def sw_linear_hits(spark, sf):
    return al.align_local_linear(seqs(spark, sf, "benchmark", "item_id"), seqs(spark, sf, "documents", "doc_id"))


@query
def sw_linear_fold(spark, sf):
    """The score as a JVM fold, each benchmark item against the next."""
    return _neighbours(spark, sf).select("item_id", al.linear_score_expression(F.col("t"), F.col("q")).alias("score"))


def _neighbours(spark, sf):
    items = seqs(spark, sf, "benchmark", "item_id")
    after = items.select((F.col("name") - 1).alias("name"), F.col("seq").alias("q"))
    return items.select("name", F.col("seq").alias("t")).join(after, "name").withColumnRenamed("name", "item_id")


@query
def sw_affine_hits(spark, sf):
    return al.align_local_affine(seqs(spark, sf, "benchmark", "item_id"), seqs(spark, sf, "documents", "doc_id"), min_score=6)


@query
def sw_affine_score(spark, sf):
    ship(spark)
    return _neighbours(spark, sf).select("item_id", al.affine_udf()("t", "q")["score"].alias("score"))


@query
def align_global_cigar(spark, sf):
    ship(spark)
    hit = _neighbours(spark, sf).withColumn("hit", al.global_udf()("t", "q"))
    return hit.select("item_id", "hit.score", "hit.cigar")


@query
def align_global_score(spark, sf):
    ship(spark)
    return _neighbours(spark, sf).select("item_id", al.global_udf(cigar=False)("t", "q")["score"].alias("score"))


@query
def align_extend(spark, sf):
    ship(spark)
    hit = _neighbours(spark, sf).withColumn("hit", al.extend_udf(h0=20)("t", "q"))
    return hit.select("item_id", "hit.*")


# mixtures


@query
def gmm_mstep_labels(spark, sf):
    df = embeddings(spark, sf, 2)
    m = gmm.m_step_labels(df, 10)
    rows = [(k, float(m.pi[k]), float(m.means[k, 0]), float(m.means[k, 1]), float(m.cov[k, 0, 0]), float(m.cov[k, 0, 1]), float(m.cov[k, 1, 1])) for k in range(10)]
    out = spark.createDataFrame(rows, "k int, pi double, m0 double, m1 double, c00 double, c01 double, c11 double")
    return out.select("k", *(rounded(F.col(c)).alias(c) for c in out.columns[1:]))


def _mixture(spark, sf):
    df = embeddings(spark, sf, 2)
    return df, gmm.m_step_labels(df, 10)


@query
def gmm_estep_2d(spark, sf):
    df, m = _mixture(spark, sf)
    return gmm.e_step(df, m).select("id", F.posexplode("gamma").alias("k", "g")).select("id", "k", rounded(F.col("g")).alias("g"))


@query
def gmm_loglik(spark, sf):
    df, m = _mixture(spark, sf)
    return spark.createDataFrame([(gmm.log_likelihood(df, m),)], "loglik double").select(rounded(F.col("loglik"), 4).alias("loglik"))


@query
def gmm_ic(spark, sf):
    df, m = _mixture(spark, sf)
    ll, n = gmm.log_likelihood(df, m), df.count()
    rows = [(c, gmm.information_criterion(ll, 10, 2, n, c)) for c in ("aic", "bic")]
    return spark.createDataFrame(rows, "criterion string, ic double").select("criterion", rounded(F.col("ic"), 4).alias("ic"))


@query
def gmm_em_1iter(spark, sf):
    df, m = _mixture(spark, sf)
    after, _ = gmm._pass(df.select("v"), m, True)
    rows = [(k, float(after.pi[k]), float(after.means[k, 0]), float(after.means[k, 1]), float(after.cov[k, 0, 0]), float(after.cov[k, 0, 1]), float(after.cov[k, 1, 1])) for k in range(10)]
    out = spark.createDataFrame(rows, "k int, pi double, m0 double, m1 double, c00 double, c01 double, c11 double")
    return out.select("k", *(rounded(F.col(c)).alias(c) for c in out.columns[1:]))


@query
def gmm_dump(spark, sf):
    """The whole model in long form, responsibilities included."""
    df, m = _mixture(spark, sf)
    return gmm.dump(df, m).select("part", "k", "i", "j", rounded(F.col("x")).alias("x"))


@query
def gmm_mstep_all(spark, sf):
    """The mixture of the given labels in all coordinates; a component of no more rows than coordinates is degenerate."""
    df = embeddings(spark, sf)
    m = gmm.m_step_labels(df, 10)
    return m.long_table(spark).where("part in ('pi', 'mean', 'cov')").select("part", "k", "i", "j", rounded(F.col("x")).alias("x"))


@query
def gmm_fit(spark, sf):
    m, _, _ = gmm.fit(embeddings(spark, sf), 10, max_iter=10)
    return m.table(spark)


@query
def gmm_select_k(spark, sf):
    """The choice of K from 1 to 50, each fit to its end (200 turns at most)."""
    return gmm.select(embeddings(spark, sf).drop("label"))


@query
def gmm_select_labels(spark, sf):
    """The choice of K from 1 to 50 from labels that are given: label modulo K; ten labels are too few for K over 10, so each is dealt by id."""
    df = embeddings(spark, sf)
    k, label = F.col("k"), F.col("label")
    labels = df.select(F.explode(F.sequence(F.lit(1), F.lit(50))).alias("k"), "id", "label").select("k", "id", ((label + 10 * F.pmod(F.col("id"), F.ceil(k / 10))) % k).cast("int").alias("label"))
    return gmm.select(df.drop("label"), labels)


@query
def argmin_criterion(spark, sf):
    """The first k with the least value, on a table of criteria."""
    counts = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).cast("int").alias("k")).agg(F.count("*").cast("double").alias("ic"))
    return counts.agg(gmm.best_k(counts).alias("k"))


# t-SNE


@query
def tsne_affinity(spark, sf):
    df = embeddings(spark, sf)
    return tsne.point_affinities(df, SIGMA, df.count(), times=1000, digits=6)


@query
def tsne_perplexity(spark, sf):
    return tsne.point_perplexity(embeddings(spark, sf), SIGMA).select(rounded(F.col("perplexity")).alias("perplexity"))


@query
def tsne_sigma(spark, sf):
    return spark.createDataFrame([(round(tsne.point_sigma(embeddings(spark, sf), 10.0), 5),)], "sigma double")


@query
def tsne_q(spark, sf):
    return tsne.joint_q(plane(embeddings(spark, sf)), times=1000, digits=6)


def _with_plane(spark, sf):
    """Points with their first two coordinates as an embedding, and how many they are."""
    df = embeddings(spark, sf)
    return df.select("id", "v", F.slice("v", 1, 2).alias("y")), df.count()


@query
def tsne_kl(spark, sf):
    df, n = _with_plane(spark, sf)
    return tsne.point_kl(df, SIGMA, n).select(rounded(F.col("kl")).alias("kl"))


@query
def tsne_gradient(spark, sf):
    df, n = _with_plane(spark, sf)
    g = tsne.point_gradient(df, SIGMA, n)
    return g.select("i", rounded(F.element_at("grad", 1) * 1000).alias("g0"), rounded(F.element_at("grad", 2) * 1000).alias("g1"))


@query
def tsne_embed(spark, sf):
    return tsne.tsne(embeddings(spark, sf), target=10.0, seed=1, mode="auto").select("id", F.element_at("y", 1).alias("y0"), F.element_at("y", 2).alias("y1"))


# robust components

_AXES = np.eye(DIMS)[:, :2]


@query
def r1pca_residual(spark, sf):
    return r1pca.residuals(embeddings(spark, sf), _AXES).select("id", rounded(F.col("residual")).alias("residual"))


@query
def r1pca_weights(spark, sf):
    df = embeddings(spark, sf).withColumn("r", r1pca.difference_norm(F.col("v"), _AXES))
    return df.select("id", rounded(vec.huber_weight(F.col("r"), 0.9)).alias("weight"))


@query
def r1pca_gram(spark, sf):
    c = r1pca.weighted_covariance(embeddings(spark, sf), _AXES, 0.9)
    return spark.createDataFrame([(i, j, float(c[i, j])) for i in range(DIMS) for j in range(DIMS)], "i int, j int, x double").select("i", "j", rounded(F.col("x")).alias("x"))


@query
def r1pca_fit(spark, sf):
    got = r1pca.fit(embeddings(spark, sf), 2)
    return got.scores.select("id", F.element_at("score", 1).alias("s0"), F.element_at("score", 2).alias("s1"))


# non-negative factors: quantity by part brand and customer segment


def quantities(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(i, j, x) with brands and segments numbered in order, and both lists."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    who = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "c_mktsegment")
    sold = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_quantity").join(part, "l_partkey").join(who, "l_orderkey").groupBy("p_brand", "c_mktsegment").agg(F.sum("l_quantity").alias("x"))
    sold = Scratch(spark, "nmf").write(sold, "sold")
    brands = [r[0] for r in sold.select("p_brand").distinct().orderBy("p_brand").collect()]
    segments = [r[0] for r in sold.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    b = spark.createDataFrame(list(enumerate(brands)), "i long, p_brand string")
    s = spark.createDataFrame(list(enumerate(segments)), "j long, c_mktsegment string")
    return sold.join(b, "p_brand").join(s, "c_mktsegment").select("i", "j", "x"), b, s


def _start(spark, sf):
    """Fixed factors of rank 2: 1 + (i + r) mod 3 and 1 + (j + 2 r) mod 4."""
    a, b, s = quantities(spark, sf)
    w = b.select("i", F.array(*((1 + (F.col("i") + r) % 3).cast("double") for r in range(RANK))).alias("w"))
    h = s.select("j", F.array(*((1 + (F.col("j") + 2 * r) % 4).cast("double") for r in range(RANK))).alias("h"))
    return a, w, h


@query
def nmf_matrix(spark, sf):
    return quantities(spark, sf)[0].select("i", "j", rounded(F.col("x")).alias("x"))


@query
def matrix_product(spark, sf):
    a = quantities(spark, sf)[0]
    return linalg.matmul(a, linalg.transpose(a)).select("i", "j", rounded(F.col("x"), 2).alias("x"))


@query
def matrix_elementwise(spark, sf):
    a = quantities(spark, sf)[0]
    return linalg.elementwise(a, a, lambda x, y: x * x / (y + 1)).select("i", "j", rounded(F.col("x")).alias("x"))


@query
def svd_rebuild(spark, sf):
    """The cells of the matrix of quantities from all its singular values and vectors."""
    a, _, s = quantities(spark, sf)
    got = svd.svd(a, s.count())
    each = F.zip_with(F.zip_with("u", "v", lambda x, y: x * y), F.array(*map(F.lit, got.s.tolist())), lambda x, y: x * y)
    return a.select("i", "j").join(got.u.withColumnRenamed("v", "u"), "i").join(got.v, "j").select("i", "j", rounded(F.aggregate(each, F.lit(0.0), lambda t, x: t + x), 3).alias("x"))


@query
def nmf_products(spark, sf):
    a, w, h = _start(spark, sf)
    left = nmf.at_times(a, w, RANK).select(F.lit("atw").alias("side"), F.col("j").alias("at"), F.posexplode("p").alias("r", "x"))
    right = nmf.a_times(a, h, RANK).select(F.lit("ah").alias("side"), F.col("i").alias("at"), F.posexplode("p").alias("r", "x"))
    return left.union(right).select("side", "at", "r", rounded(F.col("x"), 4).alias("x"))


@query
def nmf_update_step(spark, sf):
    w, h = nmf.update(*_start(spark, sf), RANK)
    return w.select(F.lit("w").alias("side"), F.col("i").alias("at"), F.posexplode("w").alias("r", "x")).union(h.select(F.lit("h").alias("side"), F.col("j").alias("at"), F.posexplode("h").alias("r", "x"))).select("side", "at", "r", rounded(F.col("x"), 4).alias("x"))


@query
def nmf_loss(spark, sf):
    return spark.createDataFrame([(nmf.loss(*_start(spark, sf), RANK),)], "loss double").select(F.round("loss", 0).alias("loss"))


@query
def nmf_nndsvd(spark, sf):
    a, b, s = quantities(spark, sf)
    w, h = nmf.nndsvd(a, RANK, b.count(), s.count())
    return w.select(F.lit("w").alias("side"), F.col("i").alias("at"), F.col("w").alias("x")).union(h.select(F.lit("h").alias("side"), F.col("j").alias("at"), F.col("h").alias("x")))


@query
def nmf_fit(spark, sf):
    a, b, s = quantities(spark, sf)
    f = nmf.fit(a, RANK, b.count(), s.count(), err=1000.0, max_iter=4)
    return f.w.select(F.col("i"), F.element_at("w", 1).alias("w0"), F.element_at("w", 2).alias("w1"))


@query
def nmf_folds(spark, sf):
    """The arithmetic folds of the cross-validation query."""
    _, b, s = quantities(spark, sf)
    return _folds(spark, b.count(), s.count())


def _folds(spark, m: int, n: int) -> DataFrame:
    return spark.range(m * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j")).withColumn("fold", ((F.col("i") * 31 + F.col("j") * 17) % 10).cast("int"))


@query
def nmf_cv(spark, sf):
    a, b, s = quantities(spark, sf)
    m, n = b.count(), s.count()
    return nmf.cross_validate(a, m, n, ks=(1, 2), fast=True, fold_table=_folds(spark, m, n), err=1000.0, max_iter=2)


# files


@query
def fasta_roundtrip(spark, sf):
    """Benchmark items written as FASTA to the shared folder and read back."""
    scratch = Scratch(spark, "fasta")
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("name"), sq.dna(F.col("text")).alias("seq"))
    fasta.write_fasta(items, f"{scratch.root}/items")
    return fasta.read_fasta(spark, f"{scratch.root}/items").select("name", "seq")
