"""Blocks of documents, and questions that they ask of hash buckets.

Corpus-wide counts of millions of keys for each text would shuffle a row a key.
Here a block (some MB of text, written once to the shared folder as an Arrow
batch with all its columns) sorts its distinct keys by bucket and asks about
them in a few messages, and each message is answered in its own order. A key is
sent once a block, so a key that a third of all rows hold is pre-aggregated.
The bucket is chosen by hash bits that the key doesn't hold, and the number of
buckets follows the number of keys, so buckets stay bounded and the odds of two
keys meeting by chance don't grow.

A block sends at most `fanout` messages, however many buckets there are: beyond
that a message covers a range of buckets. Messages of one range are merged into
chunks of bounded size, and a chunk asks the parts of its range as a block asks
the ranges, until a part is one bucket. So the rows exchanged for each byte
stay the same as the corpus grows, and only the number of such steps rises,
with the logarithm of the number of buckets to the base `fanout`.

Block ids are drawn so that Spark's hash deals a task's blocks to one bucket of
the written table: joins of blocks with their answers shuffle the answers only.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.core import slices, spark_hash, squeeze, unsqueeze
from tessera.runtime import Scratch


@dataclass(frozen=True)
class Sizes:
    """Bytes of text in a block, keys in a bucket, messages of a block at most, keys from which on a chunk takes no more messages."""

    block_bytes: int = 3 << 20
    bucket_keys: int = 2_000_000
    fanout: int = 1024
    chunk_keys: int = 1 << 20


_FAMILY = 48


def _dump(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def bundle(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def unbundle(raw: bytes, n: int) -> list[bytes]:
    size = struct.unpack_from(f"<{n}q", raw)
    cut = np.cumsum([8 * n, *size]).tolist()
    return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class _Ids:
    """Random ids that Spark's hash deals to one of `tables` buckets, the one of this task."""

    def __init__(self, tables: int, negative: bool):
        self.tables, self.sign, self.ready = tables, -1 if negative else 1, []
        context = TaskContext.get()
        self.mine = (context.partitionId() if context else 0) % tables

    def next(self) -> int:
        while not self.ready:
            drawn = self.sign * (1 + (np.frombuffer(os.urandom(64 * self.tables), np.uint64) >> np.uint64(2)).astype(np.int64))
            self.ready = drawn[spark_hash(drawn) % self.tables == self.mine].tolist()
        return self.ready.pop()


def _write(scratch: Scratch, df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], name: str, negative: bool = False) -> DataFrame:
    """(block_id, size, blob): the batches that a function makes of df, as they are, for good."""
    tables = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(tables, negative)
        for part in batches(found):
            part = pa.RecordBatch.from_arrays([pa.concat_arrays([part.column(i)]) for i in range(part.num_columns)], schema=part.schema)
            yield pa.RecordBatch.from_pydict({"block_id": pa.array([ids.next()]), "size": pa.array([part.nbytes]), "blob": pa.array([_dump(part)], pa.binary())})

    return scratch.write_dealt(df.mapInArrow(run, "block_id long, size long, blob binary"), name, "block_id", tables)


def pack(scratch: Scratch, docs: DataFrame, column: str, sizes: Sizes = Sizes(), name: str = "blocks", negative: bool = False, fill: bool = False) -> DataFrame:
    """(block_id, size, blob): every row and column of docs, in blocks that stay as written.

    Ids are random; negative ones tell one table's blocks from another's. With
    fill a block goes on over Arrow batches until it is full, so that more of
    its keys are repeats.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not fill:
                yield from slices(batch, column, sizes.block_bytes)
                continue
            for part in slices(batch, column, max(sizes.block_bytes // 8, 1)):
                n = part.column(part.schema.get_field_index(column)).nbytes
                if held and size + n > sizes.block_bytes:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
                held.append(part)
                size += n
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return _write(scratch, docs, cut, name, negative)


def buckets_for(blocks: DataFrame, keys_per_byte: float, sizes: Sizes = Sizes()) -> int:
    """How many buckets keep each at about bucket_keys keys."""
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return max(16, int(total * keys_per_byte / sizes.bucket_keys) + 1)


def bucket_of(spread: np.ndarray, n: int) -> np.ndarray:
    """A bucket below n from the high half of an independent 64-bit hash."""
    return ((spread >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Keys:
    """The distinct keys of a block in the order of bucket and key, and where each entry stands among them."""

    def __init__(self, key: np.ndarray, bucket: np.ndarray):
        self.order = np.lexsort((key, bucket))
        k, b = key[self.order], bucket[self.order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, len(k)))
        self.key, self.bucket = k[new], b[new]

    def __len__(self) -> int:
        return len(self.start)

    def sum(self, weights: np.ndarray) -> np.ndarray:
        """Of each key, the sum over its entries."""
        return np.add.reduceat(weights[self.order], self.start) if len(self) else weights[:0]

    def back(self, values: np.ndarray) -> np.ndarray:
        """Of each entry, its key's value."""
        out = np.empty(len(self.order), values.dtype)
        out[self.order] = np.repeat(values, self.size)
        return out

    def firsts(self) -> np.ndarray:
        """Which entries are the earliest of their key."""
        out = np.zeros(len(self.order), bool)
        out[self.order[self.start]] = True
        return out


#: of each family of a block: its distinct keys, and the values of each that are to be summed
Question = Callable[[pa.RecordBatch], Sequence[tuple[Keys, Sequence[np.ndarray]]]]


@dataclass
class Reply:
    """Of each key that was asked about, in order: its sums over all blocks (empty if the block isn't told), and whether this block is the first to ask."""

    sums: list[np.ndarray]
    first: np.ndarray


class Exchange:
    """Questions of blocks about keys, answered with sums over all blocks.

    families: how many buckets the keys of each family have. values: how many
    numbers go with a key. With cap, sums are answered only up to it. Blocks with
    ids above 0 are told the first `shared` sums only (all by default).
    """

    def __init__(self, scratch: Scratch, families: Sequence[int], values: int = 1, cap: int | None = None, sizes: Sizes = Sizes(), shared: int | None = None):
        self.scratch, self.families, self.values, self.cap, self.sizes = scratch, tuple(families), values, cap, sizes
        self.shared = values if shared is None else shared
        self.depth = tuple(self._levels(n) for n in self.families)
        self.schema = "block_id long, place long, reply binary, news long" + "".join(f", sum{i} long" for i in range(values))
        #: messages of each level, as sent
        self.asked: list[DataFrame] = []

    def __getstate__(self) -> dict:
        """What executors need: not the driver's tables."""
        return self.__dict__ | {"scratch": None, "asked": []}

    def _levels(self, n: int) -> int:
        k = 1
        while self.sizes.fanout**k < n:
            k += 1
        return k

    def _width(self, family: int, level: int) -> int:
        """Buckets that a message of a level covers."""
        return self.sizes.fanout ** (self.depth[family] - level)

    # messages and replies

    def _messages(self, family: int, level: int, before: int, keys: Keys, values: Sequence[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """(place, message) of each range of buckets; `before` ranges of this level come before the first."""
        if not len(keys):
            return
        width = self._width(family, level)
        found, at = np.unique(keys.bucket // width, return_index=True)
        for r, lo, hi in zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
            sub = squeeze((keys.bucket[lo:hi] - r * width).astype(np.uint64)) if width > 1 else b""
            yield family << _FAMILY | before + r, bundle(sub, squeeze(np.diff(keys.key[lo:hi], prepend=np.uint64(0))), *(squeeze(v[lo:hi].astype(np.uint64)) for v in values))

    def _entries(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Buckets within the range, keys and values of a message."""
        sub, key, *values = unbundle(raw, 2 + self.values)
        k = np.cumsum(unsqueeze(key, np.uint64), dtype=np.uint64)
        return unsqueeze(sub, np.uint64).astype(np.int64) if sub else np.zeros(len(k), np.int64), k, [unsqueeze(v, np.uint64) for v in values]

    def _gathered(self, messages: list[bytes]) -> tuple[Keys, list[np.ndarray], np.ndarray]:
        """Keys of several messages, each entry's values, and where each message's entries begin."""
        parts = [self._entries(m) for m in messages]
        bucket, key = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return Keys(key, bucket), [np.concatenate([p[2][i] for p in parts]) for i in range(self.values)], np.cumsum([0, *(len(p[1]) for p in parts)])

    def _answers(self, block_id: pa.Array, place: pa.Array, sums: list[np.ndarray], first: np.ndarray, at: np.ndarray, level: int) -> pa.RecordBatch:
        """Rows of the answers to several messages of a level, from the sums and firsts of their entries.

        news counts the keys first asked about in a message whose first sum isn't 0; sum0.. are the sums of all its first keys.
        """
        kind = np.uint64 if self.cap is None else np.uint8
        sums = [s if self.cap is None else np.minimum(s, self.cap) for s in sums]
        spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        told = [self.shared if level == 1 and i > 0 else self.values for i in block_id.to_pylist()]  # chunks of messages need all
        replies = [bundle(*(squeeze(s[a:b].astype(kind)) if k < m else b"" for k, s in enumerate(sums)), squeeze(np.packbits(first[a:b]))) for (a, b), m in zip(spans, told, strict=True)]
        parts = [[int((first[a:b] & (sums[0][a:b] > 0)).sum()) for a, b in spans], *([int(s[a:b][first[a:b]].sum()) for a, b in spans] for s in sums)]
        return pa.RecordBatch.from_arrays([block_id, place, pa.array(replies, pa.binary()), *(pa.array(p, pa.int64()) for p in parts)], ["block_id", "place", "reply", "news", *(f"sum{i}" for i in range(self.values))])

    def _unpacked(self, batch_replies: list[dict]) -> list[Reply]:
        """Replies by family, in the order of the keys."""
        kind = np.uint64 if self.cap is None else np.uint8
        out, none = [], [np.zeros(0, kind)]
        for f in range(len(self.families)):
            mine = [unbundle(r["reply"], self.values + 1) for r in sorted((r for r in batch_replies if r["place"] >> _FAMILY == f), key=lambda r: r["place"])]
            sums = [[unsqueeze(m[i], kind) if m[i] else none[0] for m in mine] for i in range(self.values)]
            first = [np.unpackbits(unsqueeze(m[-1], np.uint8), count=len(s)).astype(bool) for m, s in zip(mine, sums[0], strict=True)]
            out.append(Reply([np.concatenate(s or none) for s in sums], np.concatenate(first or [np.zeros(0, bool)])))
        return out

    # levels

    _SENT = "place long, block_id long, keys binary"

    def ask(self, blocks: DataFrame, question: Question) -> DataFrame:
        """(place, block_id, keys): the messages of the blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block_id, blob in zip(batch.column("block_id").to_pylist(), batch.column("blob"), strict=True):
                    sent = [m for f, (keys, values) in enumerate(question(load(blob.as_buffer()))) for m in self._messages(f, 1, 0, keys, values)]
                    yield self._sent(block_id, sent)

        return blocks.select("block_id", "blob").mapInArrow(run, self._SENT)

    @staticmethod
    def _sent(block_id: int, sent: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"place": pa.array([p for p, _ in sent], pa.int64()), "block_id": pa.array([block_id] * len(sent), pa.int64()), "keys": pa.array([k for _, k in sent], pa.binary())})

    def answer(self, asked: DataFrame, name: str = "answers") -> DataFrame:
        """(block_id, place, reply, news, sum0..) of every message, written once (see _answers)."""
        self.asked = []
        return self.scratch.write(self._solve(asked, 1), name)

    def _solve(self, asked: DataFrame, level: int) -> DataFrame:
        self.asked.append(asked)
        family = F.shiftright("place", _FAMILY)
        flat = [f for f, d in enumerate(self.depth) if d == level]
        deep = [f for f, d in enumerate(self.depth) if d > level]
        parts = []
        if flat:
            parts.append(self._flat(asked.where(family.isin(flat)) if deep else asked, level))
        if deep:
            parts.append(self._deep(asked.where(family.isin(deep)) if flat else asked, level))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _flat(self, asked: DataFrame, level: int) -> DataFrame:
        """Answers of places that are one bucket each."""

        def run(table: pa.Table) -> pa.Table:
            keys, values, at = self._gathered(table["keys"].to_pylist())
            block_id, place = (table[c].combine_chunks() for c in ("block_id", "place"))
            return pa.Table.from_batches([self._answers(block_id, place, [keys.back(keys.sum(v)) for v in values], keys.firsts(), at, level)])

        return asked.groupBy("place").applyInArrow(run, self.schema)

    def _deep(self, asked: DataFrame, level: int) -> DataFrame:
        """Answers of places that are ranges: by way of chunks, each of which asks the parts of its range."""
        partitions = max(int(self.scratch.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        places = min(sum(self.families), len(self.families) * self.sizes.fanout**level)
        # a range's messages are dealt over tasks, so that no task holds a whole range
        deal = F.pmod(F.xxhash64("block_id"), F.lit(partitions // places + 1))
        dealt = asked.repartition(partitions, "place", deal).sortWithinPartitions("place")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for batch in batches:
                for row in batch.to_pylist():
                    n = len(self._entries(row["keys"])[1])
                    if rows and (row["place"] != rows[0]["place"] or size >= self.sizes.chunk_keys):
                        yield pa.RecordBatch.from_pylist(rows, batch.schema)
                        rows, size = [], 0
                    rows.append(row)
                    size += n
            if rows:
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

        chunks = _write(self.scratch, dealt, cut, f"chunks-{level}")

        def question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, blob in zip(batch.column("block_id").to_pylist(), batch.column("blob"), strict=True):
                    members = load(blob.as_buffer())
                    place = members.column("place")[0].as_py()
                    family, at = place >> _FAMILY, place & ((1 << _FAMILY) - 1)
                    keys, values, _ = self._gathered(members.column("keys").to_pylist())
                    yield self._sent(chunk, list(self._messages(family, level + 1, at * self.sizes.fanout, keys, [keys.sum(v) for v in values])))

        answers = self.scratch.write(self._solve(chunks.select("block_id", "blob").mapInArrow(question, self._SENT), level + 1), f"answers-{level + 1}")

        def last(members: pa.RecordBatch, got: list[Reply]) -> Iterator[pa.RecordBatch]:
            place = members.column("place")[0].as_py()
            keys, _, at = self._gathered(members.column("keys").to_pylist())
            reply = got[place >> _FAMILY]
            yield self._answers(members.column("block_id"), members.column("place"), [keys.back(s) for s in reply.sums], keys.firsts() & keys.back(reply.first), at, level)

        return self.finish(chunks, answers, last, self.schema)

    def finish(self, blocks: DataFrame, answers: DataFrame, last: Callable[..., Iterator[pa.RecordBatch]], schema, numbered: bool = False) -> DataFrame:
        """Join blocks to their answers and let last(batch, replies) make the result rows; with `numbered` it gets the block's id too."""
        got = answers.groupBy("block_id").agg(F.collect_list(F.struct("place", "reply")).alias("replies"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    more = [batch.column("block_id")[i].as_py()] * numbered
                    yield from last(load(batch.column("blob")[i].as_buffer()), self._unpacked(batch.column("replies")[i].as_py() or []), *more)

        return blocks.select("block_id", "blob").join(got.hint("merge"), "block_id", "left").select("block_id", "blob", "replies").mapInArrow(run, schema)
