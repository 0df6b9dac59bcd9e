import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives
from tessera.runtime import Scratch

SCHEMA = "id long, label int, v array<double>"


def brute(rows, scale=256.0, k=5):
    """rows (id, label, v) with every id once."""
    kept = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, y, v in kept:
        if i % 10:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in kept if j != i))
        for s, j, _ in [x for x in scored if x[2] == y][:k]:
            fits = [(t, n) for t, n, z in scored if z != y and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out |= {(i, j, r, n, -s, -t) for r, (t, n) in enumerate(fits, 1)}
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("search", F.lit("x"))
    got = [tuple(r) for r in negatives.mine(df, F.col("id") % 10 == 0, **more).collect()]
    assert len(got) == len(set(got))
    return set(got)


def table(n, dims, labels, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(i, int(rng.integers(labels)), (centres[rng.integers(12)] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.fixture
def small(monkeypatch):
    """Blocks, searches and samples so small that several rounds are needed."""
    for name, value in (("BLOCK", 16), ("SEARCHES", 4), ("SAMPLE", 64), ("HELD", 8)):
        monkeypatch.setattr(negatives, name, value)


def test_equals_brute_force(spark, small):
    rows = table(700, 12, 4, 1)
    assert mined(spark, rows) == brute(rows)


def test_ties_copies_and_a_hot_vector(spark, small):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [0.5, 0.5, 0.0] if i % 3 == 0 else [rng.choice([0.0, 0.25, 0.5]) for _ in range(3)]) for i in range(400)]
    assert mined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = table(60, 3, 2, 3) + [(100, 0, None), (110, None, [1.0, 1.0, 1.0]), (120, 0, [1.0, None, 0.0]), (130, 1, [nan, 0.0, 0.0]), (140, 1, [inf, 0.0, 0.0]), (None, 1, [1.0, 0.0, 0.0]), (150, 0, []), (160, 1, [0.5]), (170, 9, [0.5, 0.5, 0.5]), (180, 1, [0.0, 0.0, 0.0])]
    assert mined(spark, rows) == brute(rows)


def test_repeated_rows_count_each(spark):
    rows = [(0, 1, [1.0, 0.0])] * 2 + [(1, 1, [0.5, 0.0]), (2, 2, [1.0, 0.0]), (2, 2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.positive_id, r.rank, r.negative_id) for r in negatives.mine(df, F.col("id") == 0).collect())
    # each copy of the anchor has the other one and row 1; both copies of row 2 follow; 0.5 lies below every negative
    assert got == sorted([(0, 1, 2), (0, 2, 2)] * 2)


def test_few_or_no_rows(spark):
    assert mined(spark, []) == set()
    one = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [-1.0])]
    assert mined(spark, one) == brute(one) == set()
    two = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (3, 2, [0.7])]
    assert mined(spark, two) == brute(two) and len(brute(two)) == 1


def test_beyond_exact_floats(spark):
    rows = [(0, 1, [3e5, 1.0]), (1, 1, [3e5, 2.0]), (2, 2, [3e5, 1.5]), (3, 2, [3e5, 1.0])]
    assert mined(spark, rows, scale=2.0**12) == brute(rows, 2.0**12) != set()
    with pytest.raises(ValueError, match="64-bit"):
        mined(spark, [(0, 1, [1e300])])


def test_searches_leave_blocks_unread(spark, small):
    rows = spark.createDataFrame(table(2000, 2, 3, 4, 0.02), SCHEMA)
    scratch = Scratch(spark, "test")
    nodes = scratch.write(negatives.nodes_of(negatives.quantised(rows, F.lit(True), 4096.0, "id", "label", "v"), 6), "nodes")
    space = negatives.fit(nodes)
    blocks = negatives.index(scratch, nodes, space)
    keys = blocks.orderBy("block").collect()
    assert all(r.lo <= r.hi for r in keys) and sum(1 for _ in keys) >= 2000 / 16
    one = nodes.limit(1).select(F.lit(1).cast("long").alias("search"), "v", "label", F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    part = one.toArrow().combine_chunks().to_batches()[0]
    s = negatives.Searches(part, space, True, 6)
    lo, hi = s.intervals(s.first_radius())
    met = sum(1 for r in keys if r.hi >= lo[r.pivot] and r.lo <= hi[r.pivot])
    assert 0 < met < len(keys) / 2
