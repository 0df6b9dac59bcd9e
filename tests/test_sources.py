"""Files split into ranges read as one."""

import random

import pytest

from tessera.sources import fasta, fastx, matrix


def read(path, size):
    reader = fastx.FastxReader({"path": path, "splitBytes": str(size)})
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    return [tuple(r[c] for c in ("name", "comment", "seq", "qual")) for r in rows], len(parts)


def fastq(rng, n, long=12):
    """Records whose quality lines look like headers, plus lines and FASTA headers."""
    out = []
    for i in range(n):
        size = rng.randint(1, long)
        seq = "".join(rng.choices("ACGTN", k=size))
        qual = "".join(rng.choices("@>+I#A", k=size))
        out.append(f"@r{i} c{i}\n{seq}\n+{rng.choice(['', f'r{i} c{i}'])}\n{qual}\n")
    return "".join(out)


def test_every_split_of_fastq(tmp_path):
    rng = random.Random(8)
    for k in range(6):
        path, text = tmp_path / f"{k}.fq", fastq(rng, 30)
        if k % 2:
            text = text.replace("\n", "\r\n")
        path.write_bytes(text.encode())
        want = list(fasta.parse_records(text))
        assert len(want) == 30
        for size in (1, 7, 16, 33, 64, 100, 400, 10**6):
            got, parts = read(str(path), size)
            assert got == want and parts == max(1, -(-len(text.encode()) // size))


def test_lines_over_several_reads_and_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(fastx, "_READ", 5)
    path = tmp_path / "m.fq"
    text = "@a x\nACGT\nACG\n+\n@III\n@II\n@b\nAC\nGT\n+b\n>@\n+I\n" * 5
    path.write_text(text)
    for size in (3, 10, 40):
        assert read(str(path), size)[0] == list(fasta.parse_records(text))


def test_fasta_ranges_and_long_records(tmp_path):
    path = tmp_path / "g.fa"
    text = ">one a\n" + "ACGTACGT\n" * 400 + ">two\nNNNN\n>three\n\n>four\nAC GT\n"
    path.write_text(text)
    for size in (50, 500, 3600):
        assert read(str(path), size)[0] == list(fasta.parse_records(text))


def test_mixed_files_raise_or_agree(tmp_path):
    """A record that hides a record of its kind can't be told apart: the read raises, and is whole without splits."""
    path = tmp_path / "odd.fq"
    text = "@r\nACGT\nACGTACGTAC\n+\n@q1x\nAC\n+\nII\n@z\nIIII\n@s\nA\n+\nI\n"  # the quality of r spells a record
    path.write_text(text)
    whole = None
    try:
        whole = list(fasta.parse_records(text))
    except ValueError:
        pass
    for size in range(1, len(text)):
        try:
            assert read(str(path), size)[0] == whole
        except ValueError as e:
            assert "told apart" in str(e) or "differ in length" in str(e)


def test_spark_reads_ranges(spark, tmp_path):
    text = fastq(random.Random(9), 400, 80)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fq").write_text(text)
    (tmp_path / "in" / "empty.fq").write_text("")
    (tmp_path / "in" / "b.fa").write_text(">x y\nAC\n")
    fastx.register(spark)
    raw = spark.read.format("fastx").option("splitBytes", 2000).load(str(tmp_path / "in"))
    assert raw.rdd.getNumPartitions() > 10
    got = fasta.read_fastx(spark, f"file://{tmp_path}/in", split_bytes=2000)
    rows = [(r.rec, r.name, r.comment, r.seq, r.qual) for r in got.where("file like '%a.fq'").orderBy("rec").collect()]
    assert rows == [(i, *r) for i, r in enumerate(fasta.parse_records(text))]
    assert got.where("file like '%b.fa'").count() == 1 and got.count() == 401
    assert fasta.read_fastx(spark, f"{tmp_path}/in/*.fa").count() == 1
    with pytest.raises(Exception, match="missing"):
        fasta.read_fastx(spark, f"{tmp_path}/missing.fq").collect()


def test_strict_fasta_splits(spark, tmp_path):
    text = "".join(f">n{i} x\n" + "ACgt \r\n" * (i % 7) for i in range(300))
    (tmp_path / "a.fa").write_bytes(text.encode())
    want = [(i, f"n{i} x", "ACgt \r" * (i % 7)) for i in range(300)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            df = fasta.read_fasta(spark, str(tmp_path / "a.fa"))
            assert [(r.rec, r.name, r.seq) for r in df.orderBy("rec").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "none.fa").write_text("")
    assert fasta.read_fasta(spark, str(tmp_path / "none.fa")).count() == 0


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "10")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("layout", ["rows", "header apart", "any lines"])
def test_matrix_over_many_splits(spark, tmp_path, small_splits, layout):
    rng = random.Random(10)
    n, d, ks = 120, 7, 3
    rows = [[round(rng.uniform(-9, 9), 3) for _ in range(d)] for _ in range(n)]
    labels = [[rng.randrange(k) for _ in range(n)] for k in range(1, ks + 1)]
    numbers = [str(x) for r in rows for x in r] + [str(x) for b in labels for x in b]
    if layout == "any lines":
        text = f" {n}"
        for x in [str(d), *numbers]:
            text += rng.choice([" ", "\t", "\n", "\n\n  ", " "]) + x
    else:
        head = f"{n}\n{d}\n" if layout == "header apart" else f"{n} {d}\n"
        text = head + "".join(" ".join(map(str, r)) + "\n" for r in rows) + "".join(" ".join(map(str, b)) + "\n" for b in labels)
    path = tmp_path / "m.txt"
    path.write_text(text + " 0 0")  # a block that isn't whole
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 4
    got = matrix.read_matrix(spark, str(path)).orderBy("id").collect()
    assert [r.id for r in got] == list(range(n)) and [r.v for r in got] == rows
    found = {(r.k, r.id): r.label for r in matrix.read_labels(spark, str(path)).collect()}
    assert found == {(k + 1, i): x for k, b in enumerate(labels) for i, x in enumerate(b)}
    plan = matrix.read_matrix(spark, str(path))._jdf.queryExecution().toString()
    assert "wholetext" not in plan.lower()


def test_matrix_errors(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("0 3\n")
    assert matrix.read_matrix(spark, str(path)).count() == 0 and matrix.read_labels(spark, str(path)).count() == 0
    path.write_text("2 1\n5\n6\n0 0\n1 9\n")
    assert matrix.read_matrix(spark, str(path)).count() == 2
    with pytest.raises(Exception, match="out of range"):
        matrix.read_labels(spark, str(path)).collect()
