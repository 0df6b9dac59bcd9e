"""FASTA and FASTQ readers and the FASTA writer; the source that splits FASTQ files is in fastx.py."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.fastx import numbered, read_fastx, records

__all__ = ["fasta_text", "parse_records", "read_fasta", "read_fastx", "tokens", "write_fasta"]


def read_fasta(spark: SparkSession, path: str, header: str = "full") -> DataFrame:
    """(file, rec, name, seq) of FASTA files, gzip by extension.

    Strict: a file must start with >. The name is the whole header line after
    >, or its first word with header="word". Sequence lines are joined as they
    are: case, blanks and carriage returns stay. rec counts records from 0 in
    each file. Spark splits files between records (lines that start with >); a
    missing path raises when it is resolved; an empty file has no records.
    """
    text = spark.read.option("lineSep", "\n>").text(path)
    rows = text.select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), "value")
    records = numbered(rows, "file", "part", "at")
    opening = F.when(F.col("value").startswith(">"), F.expr("substr(value, 2)")).otherwise(F.raise_error(F.lit("a FASTA file must start with >")).cast("string"))
    records = records.select("file", "rec", F.when(F.col("rec") == 0, opening).otherwise(F.col("value")).alias("body"))
    name = F.substring_index("body", "\n", 1)
    if header == "word":
        name = F.regexp_extract(name, r"^(\S*)", 1)
    seq = F.when(F.instr("body", "\n") > 0, F.regexp_replace(F.expr("substr(body, instr(body, '\\n') + 1)"), "\n", "")).otherwise(F.lit(""))
    return records.select("file", "rec", name.alias("name"), seq.alias("seq"))


def parse_records(text: str) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, seq, qual) of mixed FASTA and FASTQ text: see fastx.records()."""
    lines = ((0, line.rstrip("\r").encode()) for line in text.split("\n"))
    for _, *parts in records(lines):
        yield tuple(p if p is None else p.decode() for p in parts)


def fasta_text(name: Column, seq: Column) -> Column:
    """A record as FASTA text, without a closing line feed."""
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(fasta_text(F.col(name), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def tokens(df: DataFrame, column: str, separator: str = r"\s+") -> DataFrame:
    """Tokens of each line: (pos, token), a closing carriage return dropped."""
    clean = F.regexp_replace(F.col(column), "\r$", "")
    return df.select(*[c for c in df.columns if c != column], F.posexplode(F.split(clean, separator)).alias("pos", "token"))
