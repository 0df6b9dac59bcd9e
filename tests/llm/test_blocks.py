"""The exchange: sums and firsts against plain counts, at every depth; and how many rows it takes."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_substring import brute

from tessera.llm import blocks as bl
from tessera.llm.core import mix64, spark_hash
from tessera.llm.substring import removal
from tessera.runtime import Scratch, ship


def test_hash_is_that_of_spark(spark):
    x = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 500)
    got = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "a long").select(F.hash("a")).collect()]
    assert got == spark_hash(x).tolist()


def asked(exchange, blocks, buckets):
    def question(batch):
        v = np.array(batch.column("v").to_pylist(), np.uint64)
        keys = bl.Keys(mix64(v), bl.bucket_of(mix64(v + np.uint64(7)), buckets))
        return [(keys, [keys.size])]

    return question, exchange.ask(blocks, question)


def rows(spark, values, parts):
    ship(spark)
    return spark.createDataFrame([(str(v), int(v)) for v in values], "text string, v long").repartition(parts)


@pytest.mark.parametrize("sizes", [bl.Sizes(200, 100, 1024), bl.Sizes(200, 100, 4, 300), bl.Sizes(50, 10, 2, 50)])
def test_sums_and_firsts(spark, sizes):
    rng = random.Random(1)
    values = [rng.randrange(400) for _ in range(3000)] + [5] * 500
    scratch = Scratch(spark, "t")
    blocks = bl.pack(scratch, rows(spark, values, 3), "text", sizes)
    exchange = bl.Exchange(scratch, [60], sizes=sizes)
    question, sent = asked(exchange, blocks, 60)

    def last(batch, got):
        keys = question(batch)[0][0]
        yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(keys.back(got[0].sums[0]).astype(np.int64)), pa.array(keys.back(got[0].first) & keys.firsts())], ["v", "n", "first"])

    answers = exchange.answer(sent)
    got = exchange.finish(blocks, answers, last, "v long, n long, first boolean").collect()
    want = Counter(values)
    assert sorted((r["v"], r["n"]) for r in got) == sorted((v, want[v]) for v in values)
    assert Counter(r["v"] for r in got if r["first"]) == Counter(set(values))
    total = answers.agg(F.sum("news"), F.sum("sum0")).first()
    assert tuple(total) == (len(want), len(values))


def test_rows_for_each_key_do_not_rise_with_the_buckets(spark):
    """Eight times the keys and the buckets: one level more, and no more rows a key in the others."""
    counts = []
    for keys, buckets in ((8000, 64), (64_000, 512)):
        sizes = bl.Sizes(2500, 125, 8, 1000)
        scratch = Scratch(spark, "t")
        blocks = bl.pack(scratch, rows(spark, range(keys), 2), "text", sizes)
        exchange = bl.Exchange(scratch, [buckets], sizes=sizes)
        exchange.answer(asked(exchange, blocks, buckets)[1])
        assert exchange.asked[0].count() <= blocks.count() * sizes.fanout
        counts.append([x.count() / keys for x in exchange.asked])
    assert len(counts[0]) == 2 and len(counts[1]) == 3
    assert all(b <= 1.3 * a for a, b in zip(*counts)) and counts[1][2] <= 1.3 * counts[1][1], counts


def test_substrings_through_several_levels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    found = [tuple(r) for r in docs.collect()]
    got = removal(spark.createDataFrame(found, docs.schema), width=9, sizes=bl.Sizes(20_000, 300, 3, 2000)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(found, 9)


def test_blocks_meet_their_answers_without_a_shuffle(spark):
    values = list(range(5000))
    scratch = Scratch(spark, "t")
    blocks = bl.pack(scratch, rows(spark, values, 5), "text", bl.Sizes(1000))
    exchange = bl.Exchange(scratch, [16])
    answers = exchange.answer(asked(exchange, blocks, 16)[1])
    plan = exchange.finish(blocks, answers, lambda b, g: iter([b]), "text string, v long")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1, plan
