"""Vectorised tokenising and hashing over Arrow text columns.

A batch of texts is one byte buffer with offsets. Words are found by a byte
class table, and hashed all at once from prefix sums of a polynomial modulo
2**64, so no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
SLICE_BYTES = 3 << 20
_BASE = U(0x9E3779B97F4A7C15)
_BASE2 = U(0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (Steele, Lea and Flood 2014)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spark_hash(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash() of BIGINT values (32-bit Murmur3): what deals rows to partitions and table buckets."""

    def turned(v: np.ndarray, bits: int) -> np.ndarray:
        return v << np.uint32(bits) | v >> np.uint32(32 - bits)

    u = x.astype(np.int64).view(U)
    h = np.full(len(u), seed, np.uint32)
    for half in (u.astype(np.uint32), (u >> U(32)).astype(np.uint32)):
        h = turned(h ^ turned(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def _separators(*spans: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for lo, hi in spans:
        t[lo : hi + 1] = True
    return t


#: bytes between words: blanks and \t..\r
BLANKS = _separators((0x20, 0x20), (0x09, 0x0D))
#: bytes between words of letters, digits and non-ASCII characters
MARKS = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORDS_AT_ONCE = 1 << 15
_BYTE = mix64(np.arange(1, 257, dtype=U) * _BASE2)


@cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    inv = pow(base, -1, 1 << 64)
    p, q = np.full(n, base, U), np.full(n, inv, U)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if n > 1 << 24:  # one very long text: too large to keep
        return _powers.__wrapped__(int(base), int(n - 1).bit_length())
    p, q = _powers(int(base), max(12, int(max(n, 1) - 1).bit_length()))
    return p[:n], q[:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Rabin-Karp hash of values[s:e] for each span, from prefix sums."""
    if not len(starts):
        return np.zeros(0, U)
    p, q = powers(base, len(values) + 1)
    s = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[: len(values)], out=s[1:])
    return mix64((s[ends] - s[starts]) * q[starts] + (ends - starts).astype(U))


def window_hash(values: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return span_hash(values, at, at + width, base)


def second_hash(values: np.ndarray, width: int) -> np.ndarray:
    """As window_hash, with another base: independent of it."""
    return window_hash(values ^ _BASE2, width, _BASE2)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a text column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
        col = pc.fill_null(col, b"") if col.null_count else col
    else:
        col = col.cast(pa.large_string())
        col = pc.fill_null(col, "") if col.null_count else col
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, o - o[0]


class Words:
    """Words of a batch of texts: byte spans, and the first word of each text."""

    __slots__ = ("buf", "ends", "first", "offsets", "starts")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        self.offsets = offsets
        gap = separators[self.buf]
        n = len(buf)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0] = after[-1] = True
        before[1:], after[:-1] = gap[:-1], gap[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        before[edge] = after[edge - 1] = True
        self.starts = np.flatnonzero(before & ~gap)
        self.ends = np.flatnonzero(after & ~gap) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, some ten thousand words at a time to keep the prefix sums small."""
        out = np.empty(len(self), U)
        for a in range(0, len(self), _WORDS_AT_ONCE):
            s, e = self.starts[a : a + _WORDS_AT_ONCE], self.ends[a : a + _WORDS_AT_ONCE]
            out[a : a + len(s)] = span_hash(_BYTE[self.buf[s[0] : e[-1]]], s - s[0], e - s[0])
        return out

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, width: int) -> np.ndarray:
        """Positions where a window of `width` words of one text starts."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        doc = self.doc()
        return np.flatnonzero(doc[:n] == doc[width - 1 :])

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Of each text, the kept words joined by one space."""
        s, e = self.starts[keep], self.ends[keep]
        size = e - s + 1
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        at = np.arange(total) + np.repeat(s - (to - size), size)
        at[to - 1] = 0
        out = self.buf[at] if total else np.zeros(0, np.uint8)
        out[to - 1] = 32
        count = np.concatenate([[0], np.cumsum(keep)])[self.first]
        cut = np.concatenate([[0], to])[count]
        raw = out.tobytes()
        return [raw[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
    part = (np.cumsum(size) - size) // limit
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield batch.slice(a, b - a)


def within_repeats(key: np.ndarray) -> np.ndarray:
    """Which entries of key have an equal one elsewhere in it."""
    if len(key) < 2:
        return np.zeros(len(key), bool)
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a span of `width` from one of the starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:-1]) > 0


def squeeze(a: np.ndarray, level: int = 1) -> bytes:
    """An integer array as zstd-compressed byte planes: sorted keys lose their shared high bytes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(raw: bytes, dtype: type) -> np.ndarray:
    b = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    w = np.dtype(dtype).itemsize
    return np.ascontiguousarray(b.reshape(w, -1).T).view(dtype).ravel() if len(b) else np.zeros(0, dtype)


_resident: dict[str, Callable[[], None]] = {}


def resident(owner: str, clear: Callable[[], None]) -> None:
    """Name what an operator keeps in a Python worker from task to task, and how it is let go."""
    _resident[owner] = clear


def make_room(owner: str | None = None) -> None:
    """Let go what operators other than the owner keep in this worker, and give freed memory back.

    Workers live on from query to query, so that models of earlier stages would
    stay in memory beside those of the next.
    """
    for other, clear in _resident.items():
        if other != owner:
            clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def row_key(text: Column, *also: Column) -> Column:
    """A 64-bit hash of a text and of further columns, null or not."""
    return F.xxhash64(text.cast("string"), *(part for c in also for part in (c.cast("string"), c.isNull())))


def unmatched(docs: DataFrame, rows: DataFrame, id_col: str, column: str, how: str = "left_anti", also: Sequence[str] = ()) -> DataFrame:
    """docs without (or with "left_semi" only with) what `rows` (id, row_key) names: an id, null equal to null, and row_key() of a text and of the columns in `also`."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in (f"gone{i}" for i in range(len(taken) + 1)) if not any(c.startswith(n) for c in taken))
    rows = rows.select(F.col("id").alias(f"{name}_id"), F.col("row_key").alias(f"{name}_key")).distinct()
    return docs.join(rows, docs[id_col].eqNullSafe(F.col(f"{name}_id")) & (row_key(docs[column], *(docs[c] for c in also)) == F.col(f"{name}_key")), how)
