"""Substring dedup against a brute-force count of every window."""

import hashlib
import re
from collections import Counter

from tessera.llm.substring import dedup_substrings, removal

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] > 1:
                gone.update(range(s, s + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_removal_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted((tuple(r)[:4] for r in removal(docs).collect()), key=str)
    assert got == brute(rows, 35)
    assert any(r[2] for r in got)


def test_edge_cases(spark):
    run = " ".join(f"w{i}" for i in range(12))
    rows = [(1, run), (1, run), (None, f"x {run}\n\ttail"), (2, None), (3, ""), (4, "a " * 40), (5, "é ß \x1cb"), (6, "z" * 100_000), (7, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in removal(docs, width=5).collect()), key=str)
    assert got == brute(rows, 5)
    assert removal(docs.limit(0)).collect() == []


def test_texts_keep_what_is_not_removed(spark):
    run = " ".join(f"w{i}" for i in range(6))
    docs = spark.createDataFrame([(1, f"one\n two  {run} \n three ", "k"), (2, f"four {run}", "k"), (3, "clean \n text ", "k"), (4, None, None)], "doc_id long, text string, blob string").withColumn("n_words", docs_col())
    got = {r["doc_id"]: r for r in dedup_substrings(docs, width=5).collect()}
    assert got[1]["text"] == "one\n two  three "
    assert got[2]["text"] == "four "
    assert got[3]["text"] == "clean \n text "
    assert got[4]["text"] is None
    assert got[1]["blob"] == "k" and got[1]["n_words"] == 7


def docs_col():
    from pyspark.sql import functions as F

    return F.lit(7)
