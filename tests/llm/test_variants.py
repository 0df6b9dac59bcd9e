import random
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import variants


def neighbours(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}) - {word}


def brute(counts, ratio=5):
    alphabet, out = {c for w in counts for c in w}, {}
    for w, n in counts.items():
        near = [v for v in neighbours(w, alphabet) if v in counts]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best and counts[best] >= ratio * n else None, n, len(near))
    rows = set()
    for w, (form, n, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, counts[form] if form else None))
    return rows


def grouped(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_candidates_are_the_distinct_neighbours():
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint32)
    for word in ("a", "aab", "abcabc", "éééé", "cab" * 9):
        codes = variants._codes([word, word])
        got = list(variants.Neighbourhood(codes, alphabet).candidates(lambda key: np.ones(len(key), bool)))
        keys = [(int(a), int(b)) for w, k, m in got for i, a, b in zip(w, k, m, strict=True) if i == 1]
        want = [tuple(int(k[0]) for k in variants.keys_of(variants._codes([v]))) for v in sorted(neighbours(word, "abcé")) if v]
        if len(word) == 1:
            want.append((0, 0))  # the empty word
        assert sorted(keys) == sorted(want)


def test_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    stems = ["".join(rng.choices("abcdéß", k=rng.randint(6, 9))) for _ in range(40)]
    counts = Counter({w: rng.choice([200, 1000]) for w in stems})
    for w in stems * 3:
        v = rng.choice(sorted(neighbours(w, "abcdéß")))
        if len(v) >= 6:
            counts.setdefault(v, rng.choice([5, 6, 40, 41]))
    for w in list(counts)[40:90]:
        counts.setdefault(rng.choice(sorted(neighbours(w, "ab"))), 7)
    long = "ab" * 4000
    counts |= {long: 100, long[:-1]: 5, "x" + long: 6, long[:50] + "z" + long[51:]: 500}
    monkeypatch.setattr(variants, "AT_ONCE", 5000)
    words = {w: n for w, n in counts.items() if len(w) < 1000}
    rows = brute(words)
    last = long[:50] + "z" + long[51:]
    rows |= {(last, None, last, 500, 1, None), (long, last, last, 100, 3, 500), (long[:-1], long, last, 5, 1, 100), ("x" + long, long, last, 6, 1, 100)}
    got = grouped(variants.group(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == rows
    assert any(f and r != f for _, f, r, *_ in rows)


def test_texts(spark):
    rng = random.Random(5)
    words = ["Meadow", "forest", "Überweg", "grün-weiss", "kettle", "lantern", "lanterns", "×÷ÿabc"]
    texts = [(i, " ".join(rng.choices(words, weights=range(1, 9), k=60))) for i in range(40)] + [(None, "forest " * 60), (None, "forest " * 60), (7, None), (8, "")]
    count = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 11 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    want = brute({w: n for w, n in count.items() if len(w) >= 6 and n >= 5})
    docs = spark.createDataFrame([(i, t, 1, None) for i, t in texts], "doc_id long, text string, word int, n string")
    got = grouped(variants.spelling_variants(docs, slips=11))
    assert got == want and any(r[1] for r in want)


def test_filter_that_lets_all_through_changes_nothing(spark, monkeypatch):
    words = spark.createDataFrame([("lantern", 50), ("lanterns", 5), ("lanten", 5), ("kettle", 9)], "word string, n long")
    plain = grouped(variants.group(words))
    monkeypatch.setattr(variants, "FILTER_BYTES", 8)
    assert grouped(variants.group(words)) == plain and {r[4] for r in plain} == {0, 1, 2}


def test_empty(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert variants.spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []
