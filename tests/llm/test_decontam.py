"""Hits against brute force over every window."""

import hashlib
import random
import re

from tessera.llm.decontam import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, size=10):
    windows = {}
    for name, text in items:
        w = words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(name)
    widths = {len(x) for x in windows}
    out = []
    for d, text in docs:
        w, hit, names = words(text), set(), set()
        for k in widths:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    names |= found
        ids = ",".join(sorted(map(str, names)))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(docs, items):
    return sorted((tuple(r)[:6] for r in contamination(docs, items).collect()), key=str)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = run(docs, items)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sum(r[5] for r in got) > 3


def test_random_sequences(spark):
    rng = random.Random(4)
    text = lambda lo, hi: " ".join(rng.choice("abc") for _ in range(rng.randrange(lo, hi)))
    items = [(i, text(1, 30)) for i in range(60)]
    docs = [(i, text(0, 60)) for i in range(200)]
    got = run(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(docs, items)


def test_edge_cases(spark):
    items = [(1, "one two three"), (2, None), (3, "-- !"), (4, "É x"), (5, "one two three"), (6, " ".join(f"w{i}" for i in range(15)))]
    docs = [(1, None), (2, ""), (3, "ONE, two... three"), (4, "é x"), (None, "É X"), (5, "a " * 50_000 + " ".join(f"W{i}" for i in range(3, 14))), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert run(d, spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)
    assert contamination(d.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in contamination(d, none).collect())


def test_cut_texts(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Keep: ONE, two\n three! And this.", 5), (2, "clean  Text.", 6), (3, None, 7)], "doc_id long, text string, item_id long")
    got = {r["doc_id"]: r for r in decontaminate(docs, items).collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == ["Keep: And this.", "clean  Text.", None]
    assert got[1]["item_id"] == 5
