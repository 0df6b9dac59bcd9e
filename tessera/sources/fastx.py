"""A data source of FASTA and FASTQ files that splits them: spark.read.format("fastx").

A file is dealt into byte ranges. The task of a range finds the first record
that starts in it, and reads on to the first record that starts past it. That
place is looked up in the same way as the next range's task looks for its first
record, and the two must agree, or the read raises: so the ranges together are
the file read from its start, or nothing is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.runtime import ship

SCHEMA = "file string, part long, at long, name string, comment string, seq string, qual string"
SPLIT_BYTES = 32 << 20
_COLUMNS = ("file", "part", "at", "name", "comment", "seq", "qual")
_READ, _BATCH_BYTES = 1 << 20, 2 << 20
_PACKED = (".gz", ".bz2", ".zst", ".lz4")


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of each file: one file, those of a folder and its folders, or those that a pattern in the last part of the path fits."""
    system, place = _located(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    found = system.get_file_info(place)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    pattern = None
    if found.type == fs.FileType.NotFound and any(c in place.rpartition("/")[2] for c in "*?["):
        place, _, pattern = place.rpartition("/")
        found = system.get_file_info(place)
    if found.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    inside = [f for f in system.get_file_info(fs.FileSelector(place, recursive=pattern is None)) if f.is_file and f.base_name[0] not in "._" and (pattern is None or fnmatch(f.base_name, pattern))]
    if not inside and pattern is not None:
        raise FileNotFoundError(path)
    return sorted((prefix + f.path, f.size) for f in inside)


class Lines:
    """(first byte, line) from a byte on; a closing carriage return is dropped."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.rest = file, at, b""

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        read_from, pieces, begin = self.at, [], self.at
        while chunk := self._read(read_from):
            read_from += len(chunk)
            lines = chunk.split(b"\n")
            for line in lines[:-1]:
                whole = b"".join([*pieces, line])
                pieces = []
                yield begin, whole.removesuffix(b"\r")
                begin += len(whole) + 1
            if lines[-1]:
                pieces.append(lines[-1])
        if pieces:
            yield begin, b"".join(pieces).removesuffix(b"\r")

    def _read(self, at: int) -> bytes:
        return self.file.read(_READ) if not self.file.seekable() else self.file.read_at(_READ, at)


def records(lines: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes, bytes, bytes, bytes | None]]:
    """(first byte, name, comment, sequence, quality) of records of either kind.

    What comes before the first > or @ is skipped. Sequence and quality may
    span lines. A quality that differs from its sequence in length raises.
    """
    lines = iter(lines)
    place, line = next(lines, (0, None))
    while line is not None and line[:1] not in (b">", b"@"):
        place, line = next(lines, (0, None))
    while line is not None:
        first, head = place, line[1:].split(None, 1) if not line[1:2].isspace() else [b"", line[1:].strip()]
        seq: list[bytes] = []
        place, line = next(lines, (0, None))
        while line is not None and line[:1] not in (b">", b"@", b"+"):
            seq.append(b"".join(line.split()))
            place, line = next(lines, (0, None))
        bases, qual = b"".join(seq), None
        if line is not None and line[:1] == b"+":
            got: list[bytes] = []
            size = 0
            while size < len(bases) and (more := next(lines, None)) is not None:
                got.append(more[1])
                size += len(more[1])
            if size != len(bases):
                raise ValueError(f"quality and sequence of {(head[0] if head else b'').decode(errors='replace')} differ in length")
            qual = b"".join(got)
            place, line = next(lines, (0, None))
            while line is not None and line[:1] not in (b">", b"@"):
                place, line = next(lines, (0, None))
        yield first, head[0] if head else b"", head[1] if len(head) > 1 else b"", bases, qual


def _whole(lines: Iterator[tuple[int, bytes]]) -> bool:
    """Whether a FASTQ record starts here: letters, a + line with no name or the same, as many quality characters, then a record or the end."""
    lines = iter(lines)
    head, seq, plus = next(lines)[1][1:], 0, None
    for _, line in lines:
        if line[:1] == b"+":
            plus = line[1:]
            break
        if line[:1] in (b">", b"@") or not line.isalpha():
            return False
        seq += len(line)
    if not seq or plus is None or plus not in (b"", head):
        return False
    got = 0
    while got < seq and (more := next(lines, None)) is not None:
        got += len(more[1])
    if got != seq:
        return False
    after = next((line for _, line in lines if line), b"@")
    return after[:1] in (b">", b"@")


def first_record(file: pa.NativeFile, at: int, end: int | None, kind: bytes) -> int | None:
    """The first byte of the first record of a file's kind that starts in [at, end); None without one."""
    if at == 0:
        return 0
    for place, line in Lines(file, at - 1):
        if place < at:  # the rest of a line that began before
            continue
        if end is not None and place >= end:
            return None
        if line[:1] == kind and (kind == b">" or _whole(Lines(file, place))):
            return place
    return None


def kind_of(file: pa.NativeFile) -> bytes:
    return next((line[:1] for _, line in Lines(file, 0) if line[:1] in (b">", b"@")), b">")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int | None


class FastxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        if "path" not in options:
            raise ValueError("fastx needs a path")
        self.path = options["path"]
        self.size = int(options.get("splitbytes", SPLIT_BYTES))
        self.split = options.get("split", "true").lower() != "false"

    def partitions(self) -> list[Range]:
        found = []
        for file, size in _files(self.path):
            cuts = range(0, max(size, 1), self.size) if self.split and not file.endswith(_PACKED) else [0]
            found += [Range(file, a, a + self.size if a + self.size < size and len(cuts) > 1 else None) for a in cuts]
        return found or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.file:
            system, place = _located(part.file)
            if place.endswith(_PACKED):
                with system.open_input_stream(place) as file:
                    yield from self._batches(part, records(Lines(file, 0)))
            else:
                with system.open_input_file(place) as file:
                    yield from self._batches(part, self._own(file, part))

    def _own(self, file: pa.NativeFile, part: Range) -> Iterator[tuple]:
        kind = kind_of(file) if part.start or part.end is not None else b""
        at = first_record(file, part.start, part.end, kind)
        if at is None:
            return
        following = None
        for r in records(Lines(file, at)):
            if part.end is not None and r[0] >= part.end:
                following = r[0]
                break
            yield r
        if part.end is not None and first_record(file, part.end, None, kind) != following:
            raise ValueError(f"the records of {part.file} can't be told apart from byte {part.end} on: read it with the option split=false")

    def _batches(self, part: Range, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, 0
        for _, name, comment, seq, qual in found:
            held.append((part.file, part.start, at, *(x if x is None else x.decode("utf-8", "replace") for x in (name, comment, seq, qual))))
            at, size = at + 1, size + len(seq) + len(qual or b"") + 64
            if size >= _BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(_COLUMNS))


class FastxSource(DataSource):
    """spark.read.format("fastx").load(path): file, part (first byte of the range), at (place in the range), name, comment, seq, qual.

    Options: splitBytes, bytes of a range; split=false reads a file in one task.
    Files packed by gzip and others, by extension, are one range. A path is a
    file, a folder or a pattern, local or of a file system that pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FastxSource)


def numbered(df: DataFrame, file: str, part: str, at: str) -> DataFrame:
    """df with `rec`: the number of each row in its file, from its place in a part; parts are counted first, so no task sees a whole file."""
    parts = df.groupBy(file, part).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(file).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(parts.select(file, part, "_first", before.alias("_before")), [file, part]).withColumn("rec", F.col("_before") + F.col(at) - F.col("_first")).drop("_first", "_before")


def read_fastx(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, split: bool = True) -> DataFrame:
    """(file, rec, name, comment, seq, qual) of FASTA or FASTQ files, gzip by extension; rec counts from 0 in each file.

    Files are split into ranges. Anything before a file's first record is
    skipped, an empty file has no records, a quality that differs from its
    sequence in length raises. qual is null for FASTA records.
    """
    register(spark)
    rows = spark.read.format("fastx").option("splitBytes", split_bytes).option("split", str(split).lower()).load(path)
    return numbered(rows, "file", "part", "at").select("file", "rec", "name", "comment", "seq", "qual")
