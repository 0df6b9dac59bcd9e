"""Near-duplicates against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.llm.components import components
from tessera.llm.minhash import drop_near_duplicates, near_duplicates, packed, unpacked
from tessera.runtime import Scratch, ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def brute(rows, width=4, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for i, s in enumerate(sets):
        same = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    same[j] = same.get(j, 0) + 1
        for j, n in same.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_matches_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(tuple(r)[:4] for r in near_duplicates(docs, width=4).collect())
    assert got == brute(rows)
    assert sum(not r[3] for r in got) > 10


def test_close_and_dense_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows, n = [], 0
    for _ in range(300):  # a dense region: one text with a few words changed in each
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((n := n + 1, " ".join(w)))
    for _ in range(150):  # pairs just about the threshold
        w = [f"p{rng.randrange(10**6)}" for _ in range(60)]
        v = list(w)
        v[rng.randrange(4, 50)] = "changed"
        v[-1] = rng.choice(["end", w[-1]])
        rows += [(n := n + 1, " ".join(w)), (n := n + 1, " ".join(v).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in near_duplicates(docs, width=4).collect()) == brute(rows)


def template(rng, rows, pairs, shared):
    """Texts that have `shared` words of 100 in common; those of a pair four more."""
    base = [f"w{i}" for i in range(shared)]
    texts = [base + [f"u{i}_{j}" for j in range(100 - shared)] for i in range(rows)]
    for i in range(0, 2 * pairs, 2):
        texts[i + 1][shared : shared + 4] = texts[i][shared : shared + 4]
    rng.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def test_links_in_a_template_region(spark):
    rows = template(random.Random(9), 320, 50, 87)  # similarity 0.77 of any two, 0.83 of a pair
    got = sorted(tuple(r)[:4] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect())
    assert got == brute(rows, width=1)
    assert sum(not r[3] for r in got) == 50


def test_links_in_a_large_template_region(spark):
    """15,000 texts of similarity 0.75 hold 300 pairs of similarity 0.82: all are found, and nothing else."""
    rows = template(random.Random(8), 15_000, 300, 86)
    seen, want = {}, {}
    for i, text in rows:
        want[i] = seen.setdefault(text.split()[86], i)  # a pair shares its first own word
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), width=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert sum(not r["kept"] for r in got) == 300


def test_prefixes_of_similar_sets_meet():
    """Whatever the order, sets similar enough share a shingle among the first n - ceil(0.8 n) + 1."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, max(1, int(len(x) * 0.9)), replace=False), rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)]))
        same = len(np.intersect1d(x, y))
        if 100 * same >= 80 * (len(x) + len(y) - same):
            order = rng.permutation(np.union1d(x, y)).tolist()
            ends = [set(sorted(s.tolist(), key=order.index)[: len(s) - -(-80 * len(s) // 100) + 1]) for s in (x, y)]
            assert ends[0] & ends[1]
        assert (unpacked(packed(x)) == x).all()


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (5, "one two"), (6, "one two three four five"), (7, "é" * 9), (8, "É" * 9), (9, "a " * 50_000), (10, "a a a a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in near_duplicates(docs, width=4).collect()) == brute(rows)
    assert near_duplicates(docs.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, "one two"), (3, "one two"), (None, "only this")], "doc_id long, text string")
    assert sorted([(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(nulls).collect()], key=str) == [(3, 3, True), (None, 3, False), (None, None, True)]
    clash = spark.createDataFrame([(2, "one two", "x"), (1, "one two", "y"), (None, None, "z")], "doc_id long, text string, nid string")
    assert sorted(r["nid"] for r in drop_near_duplicates(clash).collect()) == ["y", "z"]


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (1, "A b c", "z"), (2, "a b c", "x"), (None, "n m", "p"), (None, "n m", "p"), (None, "n m", "q"), (3, None, "u"), (3, None, "u"), (3, "", "u"), (4, "only", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone0_id string").withColumnRenamed("gone0_id", "_gone_id")
    got = sorted([(r["doc_id"], r["text"]) for r in drop_near_duplicates(docs).collect()], key=str)
    assert len([r for r in got if r[0] == 1]) == 1 and len([r for r in got if r[0] is None]) == 1
    assert [r for r in got if r[0] not in (1, None)] == [(3, ""), (3, None), (3, None), (4, "only")]
    assert drop_near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("at_once", [0, 300_000])
def test_components(spark, at_once):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    extra = [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)]
    links = spark.createDataFrame(chain + extra + [(5, 5), (None, 1)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components(Scratch(spark, "t"), links, "cc", at_once=at_once).collect()}
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in chain + extra:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in top if any(x in p and p[0] != p[1] for p in chain + extra)}


def test_near_copies_hand_on_few_candidates(spark):
    """Of one large group of near copies a text hands on two candidates a tree at most, and the group is one component."""
    ship(spark)
    rng = random.Random(12)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(120)], []
    for i in range(1500):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "id long, text string").repartition(8)
    scratch = Scratch(spark, "t")
    nodes = scratch.write(minhash._sketches(docs.withColumn("row_key", F.xxhash64("text")), 4), "nodes")
    pairs = minhash._candidates(scratch, nodes, 0.8, 8)
    assert 15 * len(rows) < pairs.count() < 32 * len(rows) and pairs.where("not crowded").count() < len(rows)
    assert sorted(tuple(r)[:4] for r in near_duplicates(docs.withColumnRenamed("id", "doc_id"), width=4).collect()) == brute(rows)


def cell_rows(texts, main):
    """Rows of one cell, width 1: texts before main on the left, each a component of its own, the others one component on the right."""
    rows = []
    for i, s in enumerate(texts):
        values = np.array(sorted(s), np.uint64)
        sketch = np.zeros(32, np.uint8).tobytes()
        rows.append((7, 1, 0, 0, int(i >= main), i if i < main else -1, i.to_bytes(16, "big"), sketch, len(s), len(s), packed(values)))
    return rows


CELL_ROWS = "grp long, kind int, x long, y long, side int, root long, nid binary, sketch binary, n long, left long, shingles binary"


@pytest.mark.parametrize("group", [100, 200])
def test_a_cell_of_the_exact_join_hands_on_no_pairs(spark, group):
    """40 texts that are apart from a group: a row each, however large the group is; their links connect what all pairs do."""
    ship(spark)
    rng = random.Random(group)
    base = list(range(1, 101))
    texts = [frozenset(rng.sample(base, 100 - k % 30) + [1000 * i + j for j in range(1, 5)]) for i, k in enumerate(range(1, 41 + group))]
    dealt = spark.createDataFrame(cell_rows(texts, 40), CELL_ROWS).coalesce(1)
    near = minhash._across(dealt.drop("shingles"), 80).collect()
    assert 0 < len(near) <= 40
    assert minhash._open_rows(dealt, 80).count() <= 40 + group

    def joined(pairs):
        top = {i: i if i < 40 else 40 for i in range(len(texts))}
        for a, b in pairs:
            x, y = top[a], top[b]
            top = {k: y if v == x else v for k, v in top.items()}
        return len(set(top.values()))

    links = [tuple(int.from_bytes(x, "big") for x in r) for r in minhash._links_in_cells(dealt, 80).collect()]
    similar = [(i, j) for i in range(40) for j in range(40, len(texts)) if 100 * (n := len(texts[i] & texts[j])) >= 80 * (len(texts[i]) + len(texts[j]) - n)]
    assert len(links) <= 40 and set(links) <= set(similar)
    assert joined(links) == joined(similar) < 41


def test_what_the_best_candidates_leave_is_found(spark, monkeypatch):
    """Without any best candidate the cells alone find the same components."""
    rows = template(random.Random(10), 320, 50, 87)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "_across", lambda dealt, percent: dealt.where("false").selectExpr("nid a", "nid b"))
    monkeypatch.setattr(minhash, "_candidates", lambda scratch, nodes, *rest: nodes.where("false").selectExpr("nid a", "nid b", "0 agree", "false crowded"))
    monkeypatch.setattr(minhash, "_regions", lambda nodes: nodes.selectExpr("0L grp", *[c for c in ("nid", "root") if c in nodes.columns]))
    got = sorted(tuple(r)[:4] for r in near_duplicates(docs, width=1).collect())
    assert got == brute(rows, width=1)
    assert sum(not r[3] for r in got) == 50
