"""Counts and add-one scores against plain Python; the model by its sums and its gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.lm import CLASSES, FREQUENCIES, maximised, score_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def train_col():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


def brute(rows):
    c = Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return {d: (zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, v, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t))) for d, t in rows}


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    got = score_texts(docs, train_col()).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert tuple(r)[1:6] == w[:5]
        assert abs(r["base_score"] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert r["score"] <= 0
    return got


def test_documents(spark, sf):
    got = check(spark.read.parquet(f"{sf}/documents.parquet"))
    held = [r for r in got if not r["train"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a É é"), (4, "x " * 30_000), (None, "a b"), (5, "w" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit("clash"))
    check(docs)
    assert score_texts(docs.limit(0), train_col()).collect() == []
    unknown = score_texts(docs, F.lit(None).cast("boolean")).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in unknown)


def model(rows, train, held, rounds=12):
    """The interpolated model in plain Python: a function of text, and its probability function."""
    texts = [["<", "<", *tokens(t)] for d, t in rows]

    def counted(pick):
        c = [Counter(), Counter(), Counter()]
        for w, p in zip(texts, pick, strict=True):
            for i in range(2, len(w)) if p else ():
                c[0][w[i]] += 1
                c[1][w[i - 1], w[i]] += 1
                c[2][w[i - 2], w[i - 1], w[i]] += 1
        return c

    every, rest = counted(train), counted([t and not h for t, h in zip(train, held, strict=True)])
    uniform = 1 / (len(every[0]) + 1)

    def parts(u, v, w, c):
        n, ends = sum(c[0].values()), c[0][None]
        word = ends if v == "<" else c[0][v]
        pair = ends if v == "<" else c[1][u, v]
        kind = (2, pair) if pair else (1, word) if word else (0, 0)
        k = kind[1] if kind[1] <= 4 else 4 + int(math.log2(kind[1]))
        return (kind[0], k), [c[2][u, v, w] / pair if pair else 0, c[1][v, w] / word if word else 0, c[0][w] / n if n else 0, uniform]

    def weights_of(kind, sums):
        s = [x + 0.1 if i >= 2 - kind[0] else 0 for i, x in enumerate(sums)]
        return [x / sum(s) for x in s]

    start = {}
    for kind in (0, 1, 2):
        s = [x if i >= 2 - kind else 0 for i, x in enumerate((0.4, 0.3, 0.2, 0.1))]
        start[kind] = [x / sum(s) for x in s]
    weights = {}
    found = [parts(w[i - 2], w[i - 1], w[i], rest) for w, h in zip(texts, held, strict=True) if h for i in range(2, len(w))]
    for _ in range(rounds):
        sums = {}
        for kind, f in found:
            share = [a * b for a, b in zip(weights.get(kind, start[kind[0]]), f, strict=True)]
            total = sums.setdefault(kind, [0.0] * 4)
            for i in range(4):
                total[i] += share[i] / sum(share)
        weights = {k: weights_of(k, s) for k, s in sums.items()}

    def p(u, v, w):
        kind, f = parts(u, v, w, every)
        return sum(a * b for a, b in zip(weights.get(kind) or weights_of(kind, [0.0] * 4), f, strict=True))

    def score(text):
        w = ["<", "<", *tokens(text)]
        return sum(math.log10(p(w[i - 2], w[i - 1], w[i])) for i in range(2, len(w)))

    return score, p, every


def held_of(docs, train):
    held = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(16)) == 0) & train
    return [(r["doc_id"], r["text"], r["t"], r["h"]) for r in docs.select("doc_id", "text", train.alias("t"), held.alias("h")).collect()]


def test_scores_match_a_plain_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = held_of(docs, train_col())
    assert sum(h for *_, h in found) > 3
    score, _, _ = model([r[:2] for r in found], [r[2] for r in found], [r[3] for r in found])
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, train_col()).collect()}
    for d, t, *_ in found:
        assert abs(got[d] - score(t)) < 1e-4 * max(1, abs(got[d]))


def test_probabilities_sum_to_one(spark):
    """After seen and unseen contexts, over the known words, the end and one unknown word."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12)))) for i in range(120)]
    found = held_of(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True))
    score, p, every = model(rows, [True] * len(rows), [r[3] for r in found])
    for u, v in [("<", "<"), ("<", "a"), ("a", "b"), ("e", "e"), ("?", "a"), ("a", "?"), ("?", "?")]:
        assert abs(sum(p(u, v, w) for w in [*every[0], "?"]) - 1) < 1e-9
    # the operator gives these probabilities
    probe = [(1000 + i, t) for i, t in enumerate(["", "a", "a b", "e e e e", "? a", "a ?", "? ? b"])]
    docs = spark.createDataFrame(rows + probe, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, F.col("doc_id") < 1000).collect()}
    assert all(abs(got[i] - score(t)) < 1e-5 for i, t in probe)


def test_unseen_contexts_have_no_weight():
    weights = maximised(np.random.default_rng(0).random((CLASSES, 4)) * 50)
    assert np.allclose(weights.sum(1), 1) and (weights[FREQUENCIES:, 0] == 0).all() and weights[-1, 1] == 0 and (weights[:FREQUENCIES] > 0).all()
