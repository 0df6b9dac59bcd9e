"""Goldens, and cell-by-cell recurrences written independently."""

import random
import re
import time

import numpy as np
import pytest
import scalar_kernels as scalar
from pyspark.sql import functions as F

from tessera.functions.sequences import score_matrix
from tessera.operators import alignment as al
from tessera.operators import kernels as k
from tessera.streaming import alignment as stream

LINEAR = [("ACGTACGTTT", "CGTACG", (1, 7, 0, 6, 6)), ("GGATTACA", "GATACA", (4, 8, 2, 6, 4)), ("ACACAC", "ACAC", (0, 4, 0, 4, 4)), ("NNNN", "NNNN", (0, 4, 0, 4, 4)), ("acgt", "ACGT", (None,) * 4 + (0,)), ("AAAA", "CCC", (None,) * 4 + (0,)), ("ACGTACGTACGTGGACGTACGTACGT", "ACGTACGTACGTACGTACGTACGT", (0, 26, 0, 24, 14))]
TWENTY = "A" * 20 + "C" * 20
AFFINE = [
    ("ACGTACGTTT", "CGTACG", (1, 7, 0, 6, 6, -1, -1), (1, 7, 6, 0, 6, -1, -1)),
    ("GGATTACA", "GATACA", (4, 8, 2, 6, 4, 1, 0), (2, 4, 3, 1, 2, 1, 0)),
    ("AAAA", "CCC", (0, 0, 0, 1, 0, 0, 0), (0, 0, 3, 2, 0, 0, 0)),
    ("TTTTGATTACATTTTTTTTTTTTTTTTGATTACATT", "GATTACA", (4, 11, 0, 7, 7, 7, 33), (3, 5, 7, 5, 2, 2, 8)),
    ("ACGTNACGT", "ACGTAACGT", (0, 9, 0, 9, 8, -1, -1), (0, 9, 9, 0, 8, -1, -1)),
    (TWENTY + "GGGG" + "T" * 20 + "A" * 20, TWENTY + "T" * 20 + "A" * 20, (0, 84, 0, 80, 67, -1, -1), (44, 84, 80, 40, 40, 20, 19)),
]


def test_linear_goldens(spark):
    df = spark.createDataFrame([(t, q) for t, q, _ in LINEAR], "t string, q string")
    got = df.select("t", "q", al.linear_udf()("t", "q").alias("h")).collect()
    assert {(r["t"], r["q"]): tuple(r["h"]) for r in got} == {(t, q): w for t, q, w in LINEAR}


def test_affine_goldens(spark):
    for t, q, fwd, rev in AFFINE:
        one = lambda s: spark.createDataFrame([("x", s)], "name string, seq string")
        got = {r["strand"]: tuple(r[c] for c in ("t_start", "t_end", "q_start", "q_end", "score", "score2", "t_end2")) for r in al.align_local_affine(one(t), one(q)).collect()}
        assert got == {"+": fwd, "-": rev}, (t, q)


def slow_linear(t, q, match, mismatch, gap):
    h = [[0] * (len(q) + 1) for _ in range(len(t) + 1)]
    best = (0, 0, 0)
    for i in range(1, len(t) + 1):
        for j in range(1, len(q) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if t[i - 1] == q[j - 1] else -mismatch), h[i - 1][j] - gap, h[i][j - 1] - gap)
            if h[i][j] > best[0]:
                best = (h[i][j], i, j)
    s, i, j = best
    a, b = i, j
    while h[a][b]:
        if h[a][b] == h[a - 1][b - 1] + (match if t[a - 1] == q[b - 1] else -mismatch):
            a, b = a - 1, b - 1
        elif h[a][b] == h[a - 1][b] - gap:
            a -= 1
        else:
            b -= 1
    return (a, i, b, j, s) if s else (0, 0, 0, 0, 0)


def rand(rng, lo, hi, letters="ACGTN"):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(lo, hi)))


def test_linear_matches_cells():
    rng = random.Random(1)
    for costs in ((1, 3, 5), (2, 1, 1), (5, 4, 2), (1, 1, 1)):
        pairs = [(rand(rng, 1, 30, "ACG"), rand(rng, 1, 30, "ACG")) for _ in range(150)]
        got = k.local_linear(*k.pack([t for t, _ in pairs]), *k.pack([q for _, q in pairs]), k.equality(*costs[:2]), costs[2])
        assert [tuple(r) for r in got.tolist()] == [slow_linear(t, q, *costs) for t, q in pairs]


def slow_affine(t, q, mat, od, ed, oi, ei, min_score):
    n = len(q)
    h, e = [0] * (n + 1), [0] * (n + 1)
    best, te, qe, rows = 0, -1, 0, []
    for i, x in enumerate(t):
        new, f = [0] * (n + 1), -(10**9)
        for j in range(1, n + 1):
            e[j] = max(e[j] - ed, h[j] - od - ed)
            f = max(f - ei, new[j - 1] - oi - ei)
            new[j] = max(0, h[j - 1] + mat[x][q[j - 1]], e[j], f)
        h = new
        top = max(h[1:])
        if top >= min_score:
            if not rows or rows[-1][1] + 1 != i:
                rows.append((top, i))
            elif rows[-1][0] < top:
                rows[-1] = (top, i)
        if top > best:
            best, te, qe = top, i, h[1:].index(top)
    reach = -(-best // max(map(max, mat)))
    s2, t2 = -1, -1
    for s, i in rows:
        if (i < te - reach or i > te + reach) and s > s2:
            s2, t2 = s, i
    return best, te, qe, s2, t2


def test_affine_matches_cells_and_keeps_scores_reversed():
    rng = random.Random(2)
    mat = np.array(score_matrix())
    for gaps in ((5, 2, 5, 2), (1, 1, 2, 1), (0, 1, 0, 1), (4, 3, 2, 5)):
        pairs = [(rand(rng, 1, 40), rand(rng, 1, 40)) for _ in range(120)]
        t, tn = k.pack([t for t, _ in pairs], k.NUCLEOTIDES)
        q, qn = k.pack([q for _, q in pairs], k.NUCLEOTIDES)
        for floor in (0, 3):
            got = k.local_affine(t, tn, q, qn, mat, gaps, floor)
            want = [slow_affine(t[i, : tn[i]].tolist(), q[i, : qn[i]].tolist(), mat.tolist(), *gaps, floor) for i in range(len(pairs))]
            assert [tuple(r[:5]) for r in got.tolist()] == want
            for r in got.tolist():
                if r[0] >= floor:
                    assert 0 <= r[5] <= r[1] + 1 and 0 <= r[6] <= r[2] + 1
        flipped = k.local_affine(q, qn, t, tn, mat, (gaps[2], gaps[3], gaps[0], gaps[1]), 0)
        assert (flipped[:, 0] == got[:, 0]).all()


def test_byte_mode_saturates():
    t, tn = k.pack(["ACGT" * 80], k.NUCLEOTIDES)
    got = k.local_affine(t, tn, t, tn, np.array(score_matrix()), (5, 2, 5, 2), 0, byte_mode=True)[0]
    assert got[0] == 255 and got[2] == -1
    assert k.local_affine(t, tn, t, tn, np.array(score_matrix()), (5, 2, 5, 2), 0)[0][0] == 320


def slow_global(t, q, mat, od, ed, oi, ei):
    low = -(10**9)
    m, n = len(t), len(q)
    H = [[low] * (n + 1) for _ in range(m + 1)]
    M = [[low] * (n + 1) for _ in range(m + 1)]
    E = [[low] * (n + 1) for _ in range(m + 2)]
    H[0][0] = 0
    for j in range(1, n + 1):
        H[0][j] = -(oi + ei * j)
    for i in range(1, m + 1):
        H[i][0], f = -(od + ed * i), low
        for j in range(1, n + 1):
            M[i][j] = H[i - 1][j - 1] + mat[t[i - 1]][q[j - 1]]
            H[i][j] = max(M[i][j], E[i][j], f)
            E[i + 1][j] = max(M[i][j] - od - ed, E[i][j] - ed)
            f = max(M[i][j] - oi - ei, f - ei)
    return H[m][n]


def price(runs, t, q, mat, od, ed, oi, ei):
    i = j = total = 0
    for op, n in runs:
        if op == "M":
            total += sum(mat[t[i + x]][q[j + x]] for x in range(n))
            i, j = i + n, j + n
        elif op == "D":
            total -= od + ed * n
            i += n
        else:
            total -= oi + ei * n
            j += n
    assert (i, j) == (len(t), len(q))
    return total


def one_global(q, t, mat, gaps, band, cigar=True):
    score, text = k.global_affine(t[None], np.array([len(t)]), q[None], np.array([len(q)]), mat, gaps, band, cigar)
    return int(score[0]), [(op, int(n)) for n, op in re.findall(r"(\d+)([MDI])", text[0])] if cigar else None


def one_extend(q, t, *more):
    return tuple(k.extend(t[None], np.array([len(t)]), q[None], np.array([len(q)]), *more)[0].tolist())


def test_global_scores_and_paths():
    rng = random.Random(3)
    mat = np.array(score_matrix())
    for gaps in ((5, 2, 5, 2), (1, 1, 3, 2), (4, 1, 4, 1)):
        for _ in range(120):
            t, q = (k.pack([rand(rng, 1, 25)], k.NUCLEOTIDES)[0][0] for _ in range(2))
            score, runs = one_global(q, t, mat, gaps, 1000)
            assert score == slow_global(t.tolist(), q.tolist(), mat.tolist(), *gaps)
            assert score == price(runs, t, q, mat, *gaps)
            assert one_global(q, t, mat, gaps, 1000, cigar=False)[0] == score
    assert one_global(*(k.pack([s], k.NUCLEOTIDES)[0][0] for s in ("ACCAGGA", "ACCATTGGA")), mat, (1, 1, 1, 1), 50)[1] == [("M", 4), ("D", 2), ("M", 3)]


def slow_extend(q, t, mat, od, ed, oi, ei, h0, trim):
    """Cell by cell, gaps from the diagonal; trim leaves out columns where the row above died out."""
    n = len(q)
    above = [h0] + [max(h0 - oi - ei * j, 0) for j in range(1, n + 1)]  # by column edge
    e = [0] * (n + 1)
    best, bi, bj, gi, gs, off = h0, -1, -1, -1, -1, 0
    cols = range(n)
    for i, x in enumerate(t):
        left, f, row = (max(h0 - od - ed * (i + 1), 0) if cols.start == 0 else 0), 0, {}
        for j in cols:
            d = above[j] + mat[x][q[j]] if above[j] else 0
            above[j] = left
            left = row[j] = max(d, e[j], f)
            e[j] = max(e[j] - ed, d - od - ed, 0)
            f = max(f - ei, d - oi - ei, 0)
        above[cols.stop], e[cols.stop] = left, 0
        if max(cols.start, cols.stop) == n and left >= gs:
            gi, gs = i, left
        top = max(row.values(), default=0)
        if top == 0:
            break
        if top > best:
            j = max(j for j in row if row[j] == top)
            best, bi, bj, off = top, i, j, max(off, abs(j - i))
        if trim:
            alive = [j for j in range(cols.start, cols.stop + 1) if above[j] or e[j]]
            start = next((j for j in alive if j < cols.stop), cols.stop)
            cols = range(start, min(max((j for j in alive if j >= start), default=start - 1) + 2, n))
    return best, bj + 1, bi + 1, gi + 1, gs, off


def test_extension():
    rng = random.Random(5)
    mat = np.array(score_matrix(2, 3))
    for _ in range(400):
        q = k.pack([rand(rng, 1, 20, "ACG")], k.NUCLEOTIDES)[0][0]
        t = k.pack([rand(rng, 1, 24, "ACG")], k.NUCLEOTIDES)[0][0]
        gaps = rng.choice([(5, 2, 5, 2), (2, 1, 2, 1), (1, 2, 3, 1)])
        h0 = rng.randrange(1, 30)
        got = one_extend(q, t, mat, gaps, 10**6, 10**6, 0, h0)
        assert got == slow_extend(q.tolist(), t.tolist(), mat.tolist(), *gaps, h0, True)
        assert got[0] <= slow_extend(q.tolist(), t.tolist(), mat.tolist(), *gaps, h0, False)[0]
    a = k.pack(["ACGTACGT"], k.NUCLEOTIDES)[0][0]
    assert one_extend(a, a, np.array(score_matrix()), (5, 2, 5, 2), 100, 0, 0, 10) == (18, 8, 8, 8, 18, 0)
    far = k.pack(["ACGTCCCCCCCCCCACGTACGTACGTACGT"], k.NUCLEOTIDES)[0][0]
    near = k.pack(["ACGTGGGGGGGGGGACGTACGTACGTACGT"], k.NUCLEOTIDES)[0][0]
    assert one_extend(near, far, np.array(score_matrix()), (5, 2, 5, 2), 100, 0, 8, 40)[2] == 4
    with pytest.raises(ValueError):
        one_extend(a, a, mat, (5, 2, 5, 2), 100, 0, 0, 0)


def test_batches_equal_single_pairs():
    rng = random.Random(11)
    for mat, gaps in ((np.array(score_matrix()), (5, 2, 5, 2)), (np.array(score_matrix(2, 3)), (1, 2, 3, 1)), (np.array(score_matrix(1, 1)), (0, 1, 2, 1))):
        pairs = [(rand(rng, 0, 40), rand(rng, 0, 40)) for _ in range(80)]
        for _ in range(80):  # related pairs: few edits
            t = list(rand(rng, 1, 40))
            q = [c for c in t if rng.random() > 0.1]
            for _ in range(rng.randrange(4)):
                q.insert(rng.randrange(len(q) + 1), rng.choice("ACGT"))
            pairs.append(("".join(t), "".join(q)))
        t, tn = k.pack([t for t, _ in pairs], k.NUCLEOTIDES)
        q, qn = k.pack([q for _, q in pairs], k.NUCLEOTIDES)
        for band in (1, 4, 1000):
            score, text = k.global_affine(t, tn, q, qn, mat, gaps, band)
            for i in range(len(pairs)):
                if abs(tn[i] - qn[i]) <= band:
                    want, runs = scalar.global_affine(q[i, : qn[i]], t[i, : tn[i]], mat, gaps, band)
                    assert (score[i], text[i]) == (want, "".join(f"{n}{op}" for op, n in runs)), (pairs[i], band)
                else:
                    assert score[i] <= scalar.NEVER // 2
        for band, bonus, drop, h0 in ((100, 0, 0, 5), (3, 5, 0, 20), (100, 0, 4, 12), (8, 2, 1, 40)):
            got = k.extend(t, tn, q, qn, mat, gaps, band, bonus, drop, h0)
            want = [scalar.extend(q[i, : qn[i]], t[i, : tn[i]], mat, gaps, band, bonus, drop, h0) for i in range(len(pairs))]
            assert [tuple(r) for r in got.tolist()] == want


def test_udfs_of_odd_pairs(spark):
    df = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", None), (None, "A"), ("", "ACG"), ("ACG", ""), ("", "")], "t string, q string")
    got = df.select(al.global_udf()("t", "q").alias("g"), al.extend_udf(h0=3)("t", "q").alias("x"), al.global_udf(cigar=False)("t", "q").alias("s")).collect()
    assert [(r.g.score, r.g.cigar) for r in got] == [(4, "4M"), (None, None), (None, None), (-11, "3I"), (-11, "3D"), (0, "")]
    assert [r.s.score for r in got] == [4, None, None, -11, -11, 0] and all(r.s.cigar is None for r in got)
    assert [r.x.score for r in got] == [7, None, None, 3, 3, 3]


def test_stop_score():
    rng = random.Random(12)
    mat, gaps = np.array(score_matrix()), (5, 2, 5, 2)
    pairs = [(rand(rng, 30, 60), rand(rng, 10, 30)) for _ in range(60)]
    t, tn = k.pack([t for t, _ in pairs], k.NUCLEOTIDES)
    q, qn = k.pack([q for _, q in pairs], k.NUCLEOTIDES)
    whole = k.local_affine(t, tn, q, qn, mat, gaps, 2)
    for stop in (2, 4, 6, 1000):
        got = k.local_affine(t, tn, q, qn, mat, gaps, 2, stop_score=stop)
        for i in range(len(pairs)):
            # the same as a target that ends with the first row of a score of stop or more
            ends = next((m for m in range(1, tn[i] + 1) if k.local_affine(t[i : i + 1, :m], np.array([m]), q[i : i + 1], qn[i : i + 1], mat, gaps, 2)[0, 0] >= stop), tn[i])
            assert (got[i] == k.local_affine(t[i : i + 1, :ends], np.array([ends]), q[i : i + 1], qn[i : i + 1], mat, gaps, 2)[0]).all()
    assert (got == whole).all()
    golden = k.local_affine(*k.pack(["TTACGTTTACGTACGT"], k.NUCLEOTIDES), *k.pack(["ACGTACGT"], k.NUCLEOTIDES), mat, gaps, 1, stop_score=4)[0].tolist()
    assert golden[:3] == [4, 4, 6] and golden[5:] == [1, 3]

    def rows(stops):
        seen = []
        k._best_rows(k._affine_rows(t, tn, q, qn, mat, gaps), len(pairs), np.full(len(pairs), stops), lambda i, pairs, top: seen.append(len(pairs)))
        return sum(seen)

    assert rows(3) < rows(5) < rows(1 << 60) == tn.sum()


def test_lanes_agree_and_narrow_ones_are_faster():
    rng = random.Random(14)
    same = "".join(rng.choices("ACGT", k=320))
    pairs = [(rand(rng, 1, 60), rand(rng, 1, 60)) for _ in range(40)] + [(rand(rng, 100, 300), rand(rng, 100, 300)) for _ in range(20)]
    pairs += [(same, same), (same[:150], same), (same[:126], same[:126]), (same[:127], same[:127]), ("", "A"), ("A", "")]
    t, tn = k.pack([t for t, _ in pairs], k.NUCLEOTIDES)
    q, qn = k.pack([q for _, q in pairs], k.NUCLEOTIDES)
    for mat, gaps in ((np.array(score_matrix()), (5, 2, 5, 2)), (np.array(score_matrix(120, 100)), (3, 1, 4, 0)), (np.array(score_matrix(2, 3)), (200, 1, 5, 2))):
        for more in ({}, {"stop_score": 9}, {"byte_mode": True}):
            want = k.local_affine(t, tn, q, qn, mat, gaps, 3, lanes="int32", **more)
            for lanes in ("auto", "int8", "int16"):
                assert (k.local_affine(t, tn, q, qn, mat, gaps, 3, lanes=lanes, **more) == want).all()
    assert k.local_affine(t, tn, q, qn, np.array(score_matrix(120, 100)), (3, 1, 4, 0), 3)[:, 0].max() > 2**15
    with pytest.raises(ValueError, match="lanes"):
        k.local_affine(t, tn, q, qn, mat, gaps, lanes="int64")
    t, tn = k.pack(["".join(rng.choices("ACGT", k=300)) for _ in range(200)], k.NUCLEOTIDES)
    q, qn = k.pack(["".join(rng.choices("ACGT", k=300)) for _ in range(200)], k.NUCLEOTIDES)

    def seconds(lanes):
        began = time.perf_counter()
        k.local_affine(t, tn, q, qn, np.array(score_matrix()), (5, 2, 5, 2), 3, lanes=lanes)
        return time.perf_counter() - began

    narrow, wide = (min(seconds(x) for _ in range(3)) for x in ("int8", "int32"))
    print(f"int8 {narrow:.3f} s, int32 {wide:.3f} s")
    assert narrow < wide


def test_scoring_function(spark):
    rng = random.Random(15)
    df = spark.createDataFrame([(rand(rng, 1, 20), rand(rng, 1, 20)) for _ in range(30)], "t string, q string")

    def transitions(t, q):
        """A and G, and C and T, half match."""
        kind = np.isin(t, [ord("A"), ord("G")]) == np.isin(q, [ord("A"), ord("G")])
        return np.where(t == q, 2, np.where(kind, 1, -3))

    mine = al.linear_udf(score=lambda t, q: np.where(t == q, 1, -3))
    got = df.select(al.linear_udf()("t", "q").alias("a"), mine("t", "q").alias("b"), al.linear_udf(score=transitions)("t", "q").alias("c")).collect()
    assert all(r.a == r.b for r in got) and any(r.c.score > 2 * r.a.score for r in got)
    one = df.sparkSession.createDataFrame([("x", "AGAG")], "name string, seq string"), df.sparkSession.createDataFrame([("y", "GGGG")], "name string, seq string")
    assert al.align_local_linear(*one, score=transitions).first().score == 6


def test_any_characters_and_alphabets(spark):
    rng = random.Random(13)
    pairs = [("".join(rng.choices("中文字é?aß🦀", k=rng.randint(1, 12))), "".join(rng.choices("中文字é?aß🦀", k=rng.randint(1, 12)))) for _ in range(60)]
    df = spark.createDataFrame([*pairs, ("中", "文")], "t string, q string")
    for r in df.select("t", "q", al.linear_udf()("t", "q").alias("u"), al.linear_score_expression(F.col("t"), F.col("q")).alias("fold")).collect():
        assert r.u.score == r.fold
    letters = "ARND"
    mat = [[4, -1, -2, -2, -5], [-1, 5, 0, -2, -5], [-2, 0, 6, 1, -5], [-2, -2, 1, 6, -5], [-5] * 5]
    hits = al.align_local_affine(df.sparkSession.createDataFrame([("t", "xxARNDRNxx")], "name string, seq string"), df.sparkSession.createDataFrame([("q", "arndn")], "name string, seq string"), scoring=mat, alphabet=letters, gap_open=3, gap_ext=1, ins_open=9, ins_ext=1, min_score=1).collect()
    # A R N D match, then R is deleted for N: 4 + 5 + 6 + 6 - 4 + 6
    assert [(r.score, r.t_start, r.t_end, r.q_start, r.q_end, r.strand) for r in hits] == [(23, 2, 8, 0, 5, "+")]
    turned = al.align_local_affine(df.sparkSession.createDataFrame([("t", "xxARNDRNxx")], "name string, seq string"), df.sparkSession.createDataFrame([("q", "arndn")], "name string, seq string"), scoring=mat, alphabet=letters, gap_open=9, gap_ext=1, ins_open=3, ins_ext=1, min_score=1).collect()
    assert turned[0].score == 21
    assert al.global_udf(scoring=mat, alphabet=letters).func is not None
    with pytest.raises(ValueError, match="5 x 5"):
        al.affine_udf(scoring=[[1]], alphabet=letters)
    with pytest.raises(ValueError, match="scoring"):
        al.affine_udf(alphabet=letters)
    with pytest.raises(ValueError, match="twice"):
        k.Coding("AA")


def test_jvm_fold_and_sql_functions(spark):
    al.register(spark)
    rng = random.Random(7)
    pairs = [(rand(rng, 0, 12), rand(rng, 0, 12)) for _ in range(40)]
    df = spark.createDataFrame(pairs, "t string, q string")
    df.createOrReplaceTempView("pairs")
    rows = spark.sql("SELECT t, q, align_linear(t, q).score AS s, align_affine(t, q).score AS a, align_global(t, q).cigar AS c, align_extend(t, q).score AS x FROM pairs").join(df.select("t", "q", al.linear_score_expression(F.col("t"), F.col("q")).alias("fold")), ["t", "q"]).collect()
    for r in rows:
        assert r["fold"] == (slow_linear(r["t"], r["q"], 1, 3, 5)[4] if r["t"] and r["q"] else 0) == r["s"]
    assert tuple(spark.sql("SELECT hash_64(42L), sq_dist(array(1D, 2D), array(3D, 2D))").first()) == (-5311628559764806219, 4.0)


def test_all_pairs_filters_and_stream(spark, tmp_path):
    targets = spark.createDataFrame([("t1", "ACGTACGTTT"), ("t2", "CCCC"), ("t0", "")], "name string, seq string")
    queries = spark.createDataFrame([("q1", "CGTACG"), ("q2", "GATTACA")], "name string, seq string")
    assert al.align_local_linear(targets, queries).count() == 4
    strong = al.align_local_affine(targets, queries, min_score=6, forward_only=True).collect()
    assert [(r["t_name"], r["q_name"], r["score"]) for r in strong] == [("t1", "q1", 6)]
    queries.coalesce(1).write.parquet(str(tmp_path / "in"))
    for run, name, n in ((stream.linear_hits, "lin", 4), (stream.affine_hits, "aff", 8)):
        hits = run(targets, spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in")))
        q = hits.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n


def test_neighbour_scores(spark):
    texts = ["", None, "A", "AaCC", "gGtT xx", "", "\u00e9\u00e9A\U0001f600\U0001f600", "TTTT", None, "A\nA"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = al.neighbour_scores(df, "id")
    matrix, codes = score_matrix(), ["ACGT".find(c.upper()) % 5 for c in map(chr, range(128))]

    def code(c):
        return codes[ord(c)] if ord(c) < 128 else 4

    want = []
    for i, x in enumerate(texts):
        pairs = list(zip(x or "", (x or "")[1:], strict=False))
        want.append((i, sum(1 if a == b else -3 for a, b in pairs), sum(matrix[code(a)][code(b)] for a, b in pairs)))
    assert sorted(map(tuple, got.collect())) == want
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_linear_ends_then_origins(monkeypatch):
    """The narrow pass and the stretch give what the whole matrix gives, and the whole is not walked."""
    rng = np.random.default_rng(8)
    cells, whole = [], k.local_linear
    monkeypatch.setattr(k, "local_linear", lambda t, tn, q, *rest: cells.append(t.shape[1] * q.shape[1]) or whole(t, tn, q, *rest))
    for letters, (match, mismatch, gap) in (("ACGT", (1, 3, 5)), ("AC", (1, 1, 1)), ("AC", (2, 1, 1)), ("A\u00e9\U0001f600", (3, 2, 4)), ("AC", (5, 0, 2)), ("AC\0", (1, 3, 5))):
        t = ["".join(rng.choice(list(letters), rng.integers(1, 40))) for _ in range(200)]
        q = ["".join(rng.choice(list(letters), rng.integers(1, 300))) for _ in range(200)]
        q[:50] = [a[:60] + x[5:-3] + a[60:90] + x[-9:] for x, a in zip(t[:50], q[:50], strict=True)]
        sides = *k.pack(t), *k.pack(q)
        cells.clear()
        assert (k.local_linear_equal(*sides, match, mismatch, gap) == whole(*sides, k.equality(match, mismatch), gap)).all()
        assert gap < match * 2 or len(cells) == 1 and cells[0] < 39 * 120
    assert (k.local_linear_equal(*k.pack(["AAAA"]), *k.pack(["TTT"]), 1, 3, 5) == 0).all()
    assert (k.local_linear_equal(*k.pack(["A" * 9000]), *k.pack(["A" * 40]), 5, 3, 5) == whole(*k.pack(["A" * 9000]), *k.pack(["A" * 40]), k.equality(5, 3), 5)).all()


def test_paths_of_long_targets(monkeypatch):
    """A long target's paths are looked for near their ends, unless they can come from further away."""
    rng = np.random.default_rng(9)
    cells, whole = [], k.local_linear
    monkeypatch.setattr(k, "local_linear", lambda t, tn, q, *rest: cells.append((len(tn), t.shape[1], q.shape[1])) or whole(t, tn, q, *rest))
    for letters, costs in (("ACGT", (1, 3, 5)), ("AC", (1, 1, 1)), ("ACG", (2, 2, 3))):
        t = ["".join(rng.choice(list(letters), 500)) for _ in range(60)]
        q = ["".join(rng.choice(list(letters), rng.integers(1, 300))) for _ in range(60)]
        q[:20] = [a[:30] + x[100:160] + x[162 : 162 + 10 * i] + a[30:60] for i, (x, a) in enumerate(zip(t[:20], q[:20], strict=True))]
        sides = *k.pack(t), *k.pack(q)
        cells.clear()
        assert (k.local_linear_equal(*sides, *costs) == whole(*sides, k.equality(*costs[:2]), costs[2])).all()
        if letters == "ACGT":
            assert max(cells)[0] >= 30 and max(cells)[1:] == k.NEAR


def test_gaps_cell_by_cell_and_a_short_way_back(monkeypatch):
    """Narrow lanes give what 32 bits give, whether gaps are computed cell by cell or row by row; the way back holds no more of a query than the path can."""
    rng = random.Random(31)
    pairs = []
    for _ in range(300):
        q = rand(rng, 1, 500, "AACGT")
        at, part = rng.randrange(len(q)), rng.randrange(5, 30)
        t = q[at : at + part] + rand(rng, 0, 4, "ACGT") + q[at + part + rng.randrange(0, 3) : at + 2 * part]
        pairs.append((rand(rng, 1, 12) + t, q))
    packed = [*k.pack([t for t, _ in pairs], k.NUCLEOTIDES), *k.pack([q for _, q in pairs], k.NUCLEOTIDES)]
    for scores, gaps in (((1, 3), (5, 2, 5, 2)), ((2, 2), (3, 1, 4, 2)), ((1, 1), (1, 1, 0, 1)), ((1, 4), (6, 1, 2, 1))):
        mat = np.array(score_matrix(*scores))
        want = k.local_affine(*packed, mat, gaps, 6, lanes="int32")
        for sparse in (0, 10**9, 32):
            monkeypatch.setattr(k, "SPARSE", sparse)
            assert (k.local_affine(*packed, mat, gaps, 6) == want).all()
            assert (k.local_affine(*packed, mat, gaps, 6, lanes="int16", stop_score=9) == k.local_affine(*packed, mat, gaps, 6, lanes="int32", stop_score=9)).all()
    widths, rows = [], k._rows
    monkeypatch.setattr(k, "_rows", lambda lane, t, tn, q, *rest: widths.append(q.shape[1]) or rows(lane, t, tn, q, *rest))
    one = [*k.pack(["ACGTTGCAAC"] * 3, k.NUCLEOTIDES), *k.pack(["T" * 400 + "ACGTTGCAAC"] * 3, k.NUCLEOTIDES)]
    assert k.local_affine(*one, np.array(score_matrix(1, 3)), (5, 2, 5, 2), 6)[0].tolist() == [10, 9, 409, -1, -1, 0, 400]
    assert widths == [410, 10]


def test_wide_batches_hold_every_pair_once():
    rng = random.Random(4)
    lengths = [(rng.randrange(1, 90), rng.randrange(1, 3000)) for _ in range(2000)]
    groups = list(k.wide_batches(lengths))
    assert sorted(i for g in groups for i in g.tolist()) == list(range(2000))
    for g in groups:
        wide = [lengths[i][1] for i in g]
        assert len(g) * (max(wide) + 1) <= k.WIDE_ROW and max(wide) + 1 <= 1.25 * min(wide) + 16


def test_blocks_equal_pairs(monkeypatch):
    rng = random.Random(17)
    mat = np.array(score_matrix())
    protein = k.Coding("ACDE")
    odd = np.array([[4, -1, 0, -2, 0], [-1, 5, -3, 1, 0], [0, -3, 6, -1, 0], [-2, 1, -1, 3, 0], [0, 0, 0, 0, 1]])
    t = [rand(rng, 1, 90) for _ in range(6)] + [rand(rng, 150, 200)]
    q = [rand(rng, 1, 60) for _ in range(12)] + [t[-1][:70] + "GG" + t[-1][70:150] + t[-1][158:], "N", t[0]]
    for kept in (k.KEPT, 1):  # all rows at once, and two at a time
        monkeypatch.setattr(k, "KEPT", kept)
        for costs in ((1, 3, 5), (2, 1, 1), (5, 4, 3), (60, 40, 30)):
            want = [k.local_linear_equal(*k.pack([a]), *k.pack([b]), *costs)[0].tolist() for a in t for b in q]
            assert k.linear_block(t, q, *costs).tolist() == want
            assert k.linear_block(t, q, *costs, places=False)[:, 4].tolist() == [w[4] for w in want]
        for coding, scores, gaps, least in ((k.NUCLEOTIDES, mat, (5, 2, 5, 2), 6), (k.NUCLEOTIDES, mat, (1, 1, 2, 1), 0), (k.NUCLEOTIDES, 2 * mat, (0, 1, 3, 2), 3), (protein, odd, (4, 2, 3, 1), 9), (k.NUCLEOTIDES, 40 * mat, (90, 30, 90, 30), 60)):
            want = np.array([k.local_affine(*k.pack([a], coding), *k.pack([b], coding), scores, gaps, least)[0] for a in t for b in q])
            got = k.affine_block(t, q, coding, scores, gaps, least)
            seen = want[:, 0] >= least
            assert (got[:, 0] == want[:, 0]).all() and (got[seen] == want[seen]).all(), gaps


def test_all_pairs_are_aligned_in_blocks(spark, monkeypatch):
    """A target is aligned with all queries of a block at once: no pair goes through the functions of pairs."""
    monkeypatch.setattr(al, "_pairs", None)
    t = spark.createDataFrame([("a", "ACGTACGTTT"), (None, "GGATTACA"), ("b", ""), ("c", None)], "name string, seq string")
    q = spark.createDataFrame([(1, "CGTACG"), (2, "GATACA"), (3, None), (4, "CCCNCC")], "name int, seq string")
    got = {(r.t_name, r.q_name): tuple(r)[1:3] + tuple(r)[4:] for r in al.align_local_linear(t, q).collect()}
    assert len(got) == 6 and got["a", 1] == (1, 7, 0, 6, 6) and got[None, 2] == (4, 8, 2, 6, 4) and got["a", 4] == (1, 2, 0, 1, 1)
    assert {(r.t_name, r.q_name): r.score for r in al.linear_scores(t, q).collect()} == {key: v[-1] for key, v in got.items()}
    assert {(r.t_name, r.q_name, r.strand) for r in al.align_local_affine(t, q, min_score=4).collect()} >= {("a", 1, "+"), ("a", 1, "-"), (None, 2, "+")}


def test_a_target_row_is_cheap():
    rng = random.Random(5)
    t, q = [rand(rng, 35, 40, "AT") for _ in range(30)], [rand(rng, 400, 450, "AT") for _ in range(100)]

    def seconds(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    pairs = [(a, b) for a in t[:3] for b in q]
    one = seconds(lambda: k.local_linear_equal(*k.pack([a for a, _ in pairs]), *k.pack([b for _, b in pairs]), 1, 3, 5))
    assert seconds(lambda: k.linear_block(t, q, 1, 3, 5, False)) < 0.3 * 10 * one
