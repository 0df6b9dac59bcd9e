"""Held-out accuracy of both classifiers, their contracts, and misspelt words."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import classifier, toxicity
from tessera.llm.classifier import score_quality
from tessera.llm.classify import labelled_sample
from tessera.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.1"


def learn():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0


@pytest.mark.parametrize(("run", "label", "least"), [(score_quality, "quality", 0.98), (score_toxicity, "toxic", 0.96)])
def test_held_out_accuracy(spark, run, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = run(docs.select("doc_id", "text"), labels, learn())
    held = labels.where(~learn()).join(got, "doc_id").collect()
    assert len(held) > 500
    assert sum(r[label] == r["predicted"] for r in held) / len(held) >= least


@pytest.mark.parametrize("run", [score_quality, score_toxicity])
def test_edge_cases(spark, run):
    texts = [None, "", " ", "a", "word " * 30_000, "é" * 100_000]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (1, "again")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (3, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    got = run(docs, labels, F.lit(True)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (0, 2)}) == 1
    assert {r["score"] for r in run(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert run(docs.limit(0), labels, F.lit(True)).collect() == []


def test_misspellings_share_character_vectors(spark):
    rng = random.Random(2)
    plain = ["river", "stone", "lantern", "morning", "under", "bridge", "walks", "quiet", "garden", "winter"]
    bad = ["disgusting", "worthless", "pathetic"]
    docs, labels = [], []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            w[rng.randrange(60)] = rng.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    probe = {1000: "disgustting", 1001: "worthlesss", 1002: "patheticc", 1003: "stonne", 1004: "gardens"}
    docs += [(k, " ".join([rng.choice(plain) for _ in range(30)] + [w] + [rng.choice(plain) for _ in range(30)])) for k, w in probe.items()]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)).collect()}
    assert [got[k] for k in probe] == [1, 1, 1, 0, 0]


def test_ftrl_matches_plain_updates():
    """Follow-the-regularised-leader, weight by weight."""
    rng = random.Random(6)
    examples = [(sorted(rng.sample(range(40), rng.randrange(0, 9))), rng.random() < 0.4) for _ in range(80)]
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= classifier.L1:
            return 0.0
        return -(z[i] - math.copysign(classifier.L1, z[i])) / ((classifier.BETA + math.sqrt(n[i])) / classifier.ALPHA + classifier.L2)

    for _ in range(3):
        for idx, y in examples:
            x = {**{i: 0.5 for i in idx}, "bias": 1.0}
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - y
            for i in x:
                old = n.get(i, 0.0)
                n[i] = old + (g * x[i]) ** 2
                z[i] = z.get(i, 0.0) + g * x[i] - (math.sqrt(n[i]) - math.sqrt(old)) / classifier.ALPHA * w[i]
    got, bias = classifier.train([(np.array(idx, np.int64), np.full(len(idx), 0.5), float(y)) for idx, y in examples], 3)
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in range(40)) and abs(bias - weight("bias")) < 1e-9
    assert not got[40:].any()


def test_toxicity_step_matches_plain_gradients():
    """One joint update of the table, u and the bias, text by text and word by word."""
    texts, labels = ["bad words here bad", "a fine day", "", "words of a fine river"], [1.0, 0.0, 0.0, 1.0]
    rows, start, number, first, counts = toxicity.bag(pa.array(texts))
    table = np.random.default_rng(7).normal(0, 1 / toxicity.DIM, (1 << toxicity.BITS, toxicity.DIM)).astype(np.float32).astype(float)
    u, grad, grad_bias = np.full(toxicity.DIM, 1 / toxicity.DIM**0.5), {}, 0.0
    for d, y in enumerate(labels):
        words = [rows[start[w] : start[w + 1]] for w in number[first[d] : first[d + 1]]]
        mean = sum(float(table[w].mean(0) @ u) for w in words) / max(len(words), 1)
        g = (1 / (1 + math.exp(-toxicity.WHOLE_GAIN * mean)) - y) / len(labels)  # both classes have two examples
        grad_bias += g
        for w in words:
            for r in w.tolist():
                grad[r] = grad.get(r, 0.0) + toxicity.WHOLE_GAIN * g / len(words) / len(w)
    grad_u = sum(g * table[r] for r, g in grad.items())
    for r, g in grad.items():
        table[r] -= 0.5 * g / math.sqrt(1e-8 + g * g * float(u @ u)) * u
    u = u - 0.05 * grad_u / math.sqrt(1e-8 + float(grad_u @ grad_u))
    got, bias = toxicity.train([(rows, start, number, first, counts)], [np.array(labels)], (1, 0))
    assert np.allclose(got[list(grad)], toxicity.SPAN_GAIN * (table[list(grad)] @ u), atol=1e-4)
    assert abs(bias + 0.5 * grad_bias / math.sqrt(1e-8 + grad_bias**2)) < 1e-6


def test_sample_of_repeated_ids_is_reproducible(spark):
    rows = [(1, f"text {i}") for i in range(50)] + [(2, "other")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = [sorted(r["text"] for r in labelled_sample(spark.createDataFrame(random.Random(k).sample(rows, 51), "doc_id long, text string").repartition(k), labels, "quality", F.lit(True), "doc_id", "text", 10).rows.collect()) for k in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 2
