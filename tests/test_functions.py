"""Expressions, sorts and readers on hand-size inputs."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, sequences as sq, vectors as v
from tessera.operators import ordering as o
from tessera.sources import fasta, matrix


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_hash_64_goldens(spark):
    want = {0: 7654268697807496793, 1: 2320827452992767577, 42: -5311628559764806219, 123456789: 1734215268924325803}
    df = spark.createDataFrame([(k,) for k in [*want, -1, 2**63 - 1, -(2**63)]], "k long")
    rows = hashing.hash_64_table(df, "k").select("k", "hash", hashing.hash_64(F.col("k")).alias("direct")).collect()

    def plain(x):
        m = 2**64 - 1
        x &= m
        for kind, n in hashing.STEPS:
            if kind == "xor":
                x ^= x >> n
            else:
                s = x << n & m
                x = x + (s ^ m if kind == "add_not" else s) & m
        return x - 2**64 if x >> 63 else x

    for r in rows:
        assert r["hash"] == r["direct"] == plain(r["k"]) and r["hash"] == want.get(r["k"], r["hash"])


def test_sequences(spark):
    got = one(spark, sq.encode(F.lit("ACGTacgtNUx-")), sq.reverse_complement(F.lit("AACGN")), sq.reverse_complement_codes(F.lit("00124")), sq.reverse_prefix(F.lit("abcdef"), 4), sq.dna(F.lit("a-Cxg t"), 3))
    assert got == ("012301234444", "NCGTT", "42133"[::1] if False else "41233", "dcbaef", "ACG")
    m = sq.score_matrix()
    assert m[0][0] == 1 and m[0][1] == -3 and m[4][4] == 0 and m[2][4] == 0


def test_vectors(spark):
    a, b = v.literal([1, 2, 3]), v.literal([2, 0, 3])
    d, n, pos, neg = one(spark, v.sq_dist(a, b), v.norm(v.literal([3, 4])), v.positive_part(v.literal([1, -2])), v.negative_part(v.literal([1, -2])))
    assert (d, n, pos, neg) == (5.0, 5.0, [1.0, 0.0], [0.0, 2.0])
    with pytest.raises(Exception, match="differ in length"):
        one(spark, v.sq_dist(a, v.literal([1])))
    lse, none = one(spark, v.weighted_log_sum_exp(v.literal([-1000, -1001, 5]), [0.5, 0.5, 0.0]), v.clamp_small(v.literal([1e-11, 1])))
    assert abs(lse - (-1000 + math.log(0.5 + 0.5 * math.exp(-1)))) < 1e-12 and none == [0.0, 1.0]
    rate, bar = F.lit(100.0), F.lit(0.0)
    seen = []
    for g in (0.5, 0.25, -1.0):
        rate, bar = v.adapt_rate(rate, bar, F.lit(g))
        seen.append(one(spark, rate, bar))
    assert seen == [(100.0, 0.25), (200.0, 0.25), (100.0, -0.375)]


def test_orders(spark):
    df = spark.createDataFrame([(-1, 1), (1, 5), (0, 2), (1, -7), (-(2**63), 0)], "x long, y long")
    assert [tuple(r) for r in o.sort_unsigned(df, "x", "y").collect()] == [(0, 2), (1, 5), (1, -7), (-(2**63), 0), (-1, 1)]
    assert [o.kth_smallest(df, "x", k).first()["x"] for k in range(5)] == [-(2**63), -1, 0, 1, 1]
    assert o.kth_smallest(df, "x", 5).collect() == []
    assert [r["x"] for r in o.smallest(df, 2, "x", "y").collect()] == [-(2**63), -1]
    assert spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double").agg(o.median("x")).first()[0] == 2.5
    assert one(spark, o.sort_array_by(F.array(F.lit(3), F.lit(1), F.lit(2)), lambda a, b: a > b))[0] == [3, 2, 1]
    ties = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, 2.0)], "k int, d double")
    assert ties.agg(o.arg_min(F.col("k"), F.col("d"))).first()[0] == 1


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">one two\nAC\nGT\n>three\nNN >x\n>empty\n>last\nTT")
    got = [tuple(r)[1:] for r in fasta.read_fasta(spark, str(p)).orderBy("rec").collect()]
    assert got == [(0, "one two", "ACGT"), (1, "three", "NN >x"), (2, "empty", ""), (3, "last", "TT")]
    assert [r["name"] for r in fasta.read_fasta(spark, str(p), header="word").orderBy("rec").collect()] == ["one", "three", "empty", "last"]
    (tmp_path / "b.fa").write_text("oops")
    with pytest.raises(Exception, match="must start with"):
        fasta.read_fasta(spark, str(tmp_path / "b.fa")).collect()
    with pytest.raises(Exception):
        fasta.read_fasta(spark, str(tmp_path / "missing.fa")).collect()


def test_fastx_and_roundtrip(spark, tmp_path):
    with gzip.open(tmp_path / "r.fq.gz", "wt") as f:
        f.write("junk\n@r1 some comment\r\nACG\r\nT\r\n+\r\nII@I\r\n>f1\nAC GT\n@r2\n\n+\n\n@r3\nA\n+x\n>\n")
    got = [tuple(r)[1:] for r in fasta.read_fastx(spark, str(tmp_path / "r.fq.gz")).orderBy("rec").collect()]
    assert got == [(0, "r1", "some comment", "ACGT", "II@I"), (1, "f1", "", "ACGT", None), (2, "r2", "", "", ""), (3, "r3", "", "A", ">")]
    df = spark.createDataFrame([("a b", "ACGT"), ("c", "")], "name string, seq string").coalesce(1)
    fasta.write_fasta(df, str(tmp_path / "out"))
    assert sorted((r["name"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()) == [("a b", "ACGT"), ("c", "")]


def test_matrix_and_labels(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text("3 2\n1 2\n3 4.5\n-1e3 6\n 0 0 0 \n0 1 1\n")
    assert [tuple(r) for r in matrix.read_matrix(spark, str(p)).orderBy("id").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.5]), (2, [-1000.0, 6.0])]
    assert sorted(tuple(r) for r in matrix.read_labels(spark, str(p)).collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 0, 0), (2, 1, 1), (2, 2, 1)]
    p.write_text("3 2\n1 2\n")
    with pytest.raises(Exception, match="shorter"):
        matrix.read_matrix(spark, str(p)).collect()
    assert matrix.embedding_text(spark.createDataFrame([([1.0, 0.123456789],)], "y array<double>")).first()[0] == "1.00000\t0.123457\t"
