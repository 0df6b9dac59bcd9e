"""The permutation's inverse, and the laws of shards and slots."""

import zlib

import numpy as np

from tessera.llm.sharding import number_at, permute, place, shard_rows


def test_permutation():
    for n in (1, 2, 3, 16, 17, 1000, 4097):
        at = np.arange(n)
        p = permute(at, n, seed=3)
        assert sorted(p.tolist()) == list(range(n))
        assert (permute(p, n, seed=3, inverse=True) == at).all()
        shard, slot = place(at, n, 5, seed=3)
        assert (number_at(shard, slot, n, 5, seed=3) == at).all()
    assert (permute(np.arange(1000), 1000, 1) != permute(np.arange(1000), 1000, 2)).any()


def check(rows, got, shards):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted(r["number"] for r in got) == list(range(len(rows)))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = shard_rows(docs).collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], got, 16)
    again = shard_rows(docs.repartition(5).orderBy("text")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_edge_cases(spark):
    rows = [(None, None), (None, "é"), (1, ""), (1, ""), (1, "x"), (2, "z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, shard_rows(docs, 4).collect(), 4)
    assert shard_rows(docs.limit(0)).collect() == []


def plain_place(number, n, shards, seed=0):
    """The network on Python integers."""
    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    half = 1
    while 4**half < n:
        half += 1
    p = number
    while True:
        left, right = p >> half, p % 2**half
        for r in range(6):
            left, right = right, left ^ mix((right + mix(seed * 6 + r + 1)) % 2**64) % 2**half
        p = left << half | right
        if p < n:
            return p % shards, p // shards


def test_shard_and_slot_are_those_of_the_number(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = shard_rows(docs, 7, seed=5).collect()
    assert all((r["shard"], r["slot"]) == plain_place(r["number"], len(got), 7, 5) for r in got)
    order = sorted(got, key=lambda r: r["number"])
    assert [(r["doc_id"], r["text_crc32"]) for r in order] == sorted((r["doc_id"], r["text_crc32"]) for r in got)


def test_copies_and_clashing_columns(spark):
    docs = spark.createDataFrame([(7, "same", 1, "x")] * 500 + [(8, "other", 2, "y")], "doc_id long, text string, number int, shard string").repartition(5)
    check([(7, "same")] * 500 + [(8, "other")], shard_rows(docs, 16).collect(), 16)
