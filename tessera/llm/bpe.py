"""BPE encoding and decoding by reuse of content-defined chunks.

A rolling hash over the bytes proposes cuts, so texts that share a passage
share its chunks. Chunks are counted by 128-bit hashes over the whole corpus
(see blocks.py): one block encodes each chunk that several blocks have, and its
ids alone travel to the others; a chunk of one block is encoded there, once.

Where a chunk starts or ends inside a pretoken, its own encoding is wrong there:
the join is re-encoded from the last sure boundary before the cut to the first
one after it, and taken in place of both chunks' tokens. The chunks must have
token edges at these boundaries; as long as they don't, the join widens to the
next one.

A sure boundary stands before a space that follows an ASCII letter or mark and
is followed by an ASCII letter: there a byte-level pretoken starts whatever
else the text holds.
"""

from __future__ import annotations

import hashlib
import json
import os
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Accumulator
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm import blocks as bl
from tessera.llm.core import buffers, mix64, resident, slices, squeeze, unsqueeze
from tessera.runtime import Scratch, ship

#: one byte in so many ends a chunk, on average; bytes the rolling hash sees
CHUNK, WINDOW = 256, 8
#: the pretokens of byte-level BPE
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[0x21:0x7F] = True
_ROLL = mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


class Codec:
    """A tokenizer file's encoder and decoder for byte-level BPE."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        data = json.loads(spec)
        to_byte = _byte_chars()
        vocab = data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(to_byte[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.text = [str(i) for i in range(size)]
        self.special = sorted(special, key=len, reverse=True)
        self.fast = self._ranked(data, special)
        self.chunked = data.get("normalizer") is None and (data.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not data["pre_tokenizer"].get("add_prefix_space") and data["pre_tokenizer"].get("use_regex", True)

    def _ranked(self, data: dict, special: dict[str, int]):
        """The same vocabulary as ranks, if ids follow the order of the merges; None if not."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        ids = [data["model"]["vocab"].get(a + b) for a, b in pairs]
        if any(b is None or b <= a for a, b in zip(ids, ids[1:], strict=False)) or not ids or min(ids) < 256:
            return None
        import tiktoken

        ranks = {b: i for i, b in enumerate(self.bytes) if b and i not in special.values()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, raw: bytes) -> np.ndarray:
        """Ids of a piece without special tokens: by ranks for Latin letters of moderate length, else by the library itself."""
        text = raw.decode()
        if self.fast is not None and len(text) < 65_536 and (text.isascii() or max(text) < "ɐ"):
            return np.array(self.fast.encode_ordinary(text), np.int32)
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)

    def coded(self, ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """ids with the byte offset where each ends."""
        return ids, np.cumsum(self.length[ids]).tolist()

    def join(self, raw: bytes, cuts: list[int], sure: list[int], chunk: Callable[[int, int], tuple[np.ndarray, list[int]]], plain: Callable[[bytes], np.ndarray]) -> np.ndarray:
        """Ids of a text cut at `cuts`, from the ids and ends of its chunks, with its sure boundaries."""
        edges = [0, *cuts, len(raw)]
        out, done = [], 0  # done: up to where ids are final; always a sure boundary or the start
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b <= done:
                continue
            ids, ends = chunk(a, b)

            def after(at: int, a: int = a, ends: list[int] = ends) -> int:
                """The number of tokens up to a boundary where the chunk has a token edge, else -1."""
                k = bisect_left(ends, at - a)
                return k + 1 if k < len(ends) and ends[k] == at - a else -1

            low, high = bisect_right(sure, max(a, done)), bisect_right(sure, b)
            begin = 0 if done == a else after(done) if done > a else -1
            while begin < 0 and low < high:  # the join on the left goes on to a boundary that this chunk has too
                begin = after(sure[low])
                if begin >= 0:
                    out.append(plain(raw[done : sure[low]]))
                    done = sure[low]
                low += 1
            if begin < 0:
                continue  # or through this chunk
            stop = len(ids) if b == len(raw) else -1
            if stop >= 0:
                out.append(ids[begin:])
                done = b
            while stop < 0 and low < high:  # the chunk is left at the last boundary that it has
                high -= 1
                stop = after(sure[high])
                if stop >= 0:
                    out.append(ids[begin:stop])
                    done = sure[high]
            if done < b:
                k = bisect_right(sure, b)
                repaired = sure[k] if k < len(sure) else len(raw)
                out.append(plain(raw[done:repaired]))
                done = repaired
        if done < len(raw):
            out.append(plain(raw[done:]))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.bytes)):
            raise ValueError(f"token ids must be 0 to {len(self.bytes) - 1}")
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _cuts(buf: np.ndarray) -> np.ndarray:
    """Where a rolling hash of the WINDOW bytes before a position, at a character's start, ends a chunk."""
    if len(buf) <= WINDOW:
        return np.zeros(0, np.int64)
    v = _ROLL[buf]
    h = np.zeros(len(buf) - WINDOW, np.uint32)
    for i in range(WINDOW):
        h = h * np.uint32(0x9E3779B1) + v[i : i + len(h)]
    h ^= h >> np.uint32(15)
    at = np.flatnonzero((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - int(CHUNK).bit_length() + 1) == 0) + WINDOW
    return at[(buf[at] & 0xC0) != 0x80]


def _sure(buf: np.ndarray) -> np.ndarray:
    if len(buf) < 3:
        return np.zeros(0, np.int64)
    return np.flatnonzero(_MARK[buf[:-2]] & (buf[1:-1] == 0x20) & _LETTER[buf[2:]]) + 1


class Chunked:
    """The texts of a column, cut into chunks; whole texts where special tokens stand in them."""

    def __init__(self, codec: Codec, col: pa.Array):
        self.codec = codec
        buf, offsets = buffers(col)
        cuts, self.sure = _cuts(buf), _sure(buf)
        lo, hi = np.searchsorted(cuts, offsets[:-1] + WINDOW), np.searchsorted(cuts, offsets[1:])
        self.sure_lo, self.sure_hi = np.searchsorted(self.sure, offsets[:-1], side="right"), np.searchsorted(self.sure, offsets[1:])
        self.offsets = offsets.tolist()
        self.raw = [buf[a:b].tobytes() for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]
        special = [s.encode() for s in codec.special]
        self.plain = [any(s in raw for s in special) for raw in self.raw]  # the library finds special tokens before anything else
        self.cuts = [[] if p else (cuts[a:b] - o).tolist() for p, a, b, o in zip(self.plain, lo, hi, self.offsets, strict=False)]
        #: the 128-bit hash of each chunk of each text
        self.names = [[] if p or not raw else [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip([0, *c], [*c, len(raw)], strict=True)] for p, raw, c in zip(self.plain, self.raw, self.cuts, strict=True)]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit numbers of every chunk."""
        both = np.frombuffer(b"".join(n for names in self.names for n in names), np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def chunk(self, name: bytes) -> bytes:
        """The bytes of a chunk by its name."""
        if not hasattr(self, "found"):
            self.found = {n: (d, a, b) for d, names in enumerate(self.names) for n, a, b in zip(names, [0, *self.cuts[d]], [*self.cuts[d], len(self.raw[d])], strict=False)}
        d, a, b = self.found[name]
        return self.raw[d][a:b]

    def encoded(self, known: dict[bytes, np.ndarray]) -> tuple[list[np.ndarray], int]:
        """Ids of each text, and how many chunks were encoded: those that aren't known, each once."""
        known, joins, made, out = {n: self.codec.coded(ids) for n, ids in known.items()}, {}, 0, []

        def plain(raw: bytes) -> np.ndarray:
            got = joins.get(raw)
            if got is None:
                got = joins[raw] = self.codec.plain(raw)
            return got

        for d, raw in enumerate(self.raw):
            if self.plain[d]:
                out.append(np.array(self.codec.whole.encode(raw.decode(), add_special_tokens=False).ids, np.int32))
                continue
            for name, a, b in zip(self.names[d], [0, *self.cuts[d]], [*self.cuts[d], len(raw)], strict=False):
                if name not in known:
                    known[name] = self.codec.coded(self.codec.plain(raw[a:b]))
                    made += 1
            name = dict(zip([0, *self.cuts[d]], self.names[d], strict=False))
            out.append(self.codec.join(raw, self.cuts[d], (self.sure[self.sure_lo[d] : self.sure_hi[d]] - self.offsets[d]).tolist(), lambda a, b, name=name: known[name[a]], plain))
        return out, made


def encode_column(codec: Codec, col: pa.Array) -> list[np.ndarray]:
    """Ids of each text of a column; null is empty."""
    if not codec.chunked:
        buf, offsets = buffers(col)
        return [np.array(codec.whole.encode(buf[a:b].tobytes().decode(), add_special_tokens=False).ids, np.int32) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return Chunked(codec, col).encoded({})[0]


@lru_cache(maxsize=2)
def _codec(spec: str) -> Codec:
    return Codec(spec)


resident("bpe", _codec.cache_clear)


def encode(docs: DataFrame, tokenizer_path: str, column: str = "text", ids: bool = True, sizes: bl.Sizes = bl.Sizes(), made: Accumulator | None = None) -> DataFrame:
    """docs with ids (array of int, if asked for), n_tokens, ids_sha256 and decoded_sha256 of each text.

    ids are those of the tokenizers library for the file at tokenizer_path, with
    add_special_tokens=False; strings of special tokens in a text become those
    tokens. ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of
    the decoded text, special tokens included. Null is empty: no tokens. Every
    row and column stays; a column of docs that has a new column's name is
    replaced. An empty table gives no rows. The file is read on the driver and
    sent to the executors.

    Every distinct chunk of the corpus is encoded once; `made` counts them, as
    far as no task is repeated. A tokenizer that isn't byte-level BPE without a
    normalizer encodes whole texts instead. sizes sets the blocks and buckets
    of the exchange, not the result (see blocks.py).
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    spec = spark.sparkContext.broadcast(text)
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new = {f.name.lower() for f in fields}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new or f.name == column]
    schema = T.StructType(kept + [f for f in fields if f.name.lower() not in {k.name.lower() for k in kept}])
    docs = docs.select(*(docs[f.name] for f in kept))

    def rows(codec: Codec, part: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
        made = {
            "n_tokens": pa.array([len(x) for x in found], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(",".join(map(codec.text.__getitem__, x.tolist())).encode()).hexdigest() for x in found], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in found], pa.string()),
        }
        if ids:
            made["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32()), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([made[f.name] if f.name in made and f not in kept else part.column(f.name) for f in schema], [f.name for f in schema])

    if not _codec(text).chunked:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(spec.value)
            for batch in batches:
                for part in slices(batch, column):
                    yield rows(codec, part, encode_column(codec, part.column(column)))

        return docs.mapInArrow(whole, schema)

    scratch = Scratch(spark, "bpe")
    packed = bl.pack(scratch, docs, column, sizes)
    n = bl.buckets_for(packed, 1 / CHUNK, sizes)
    exchange = bl.Exchange(scratch, [n], cap=2, sizes=sizes)

    def chunks(part: pa.RecordBatch) -> tuple[Chunked, bl.Keys, np.ndarray]:
        cut = Chunked(_codec(spec.value), part.column(column))
        key, spread = cut.keys()
        return cut, bl.Keys(key, bl.bucket_of(spread, n)), spread

    def question(part: pa.RecordBatch) -> list[tuple[bl.Keys, list[np.ndarray]]]:
        keys = chunks(part)[1]
        return [(keys, [np.ones(len(keys), np.uint64)])]

    def shared(part: pa.RecordBatch, got: list[bl.Reply], block_id: int) -> Iterator[pa.RecordBatch]:
        """The chunks that other blocks have too, with their ids where this block is the first to have them."""
        cut, keys, spread = chunks(part)
        several = np.flatnonzero(got[0].sums[0] > 1)
        at = keys.order[keys.start[several]]
        names = [np.array([k, s], np.uint64).tobytes() for k, s in zip(keys.key[several].tolist(), spread[at].tolist(), strict=True)]
        ids = [squeeze(cut.codec.plain(cut.chunk(name)).astype(np.uint32)) if mine else None for name, mine in zip(names, got[0].first[several].tolist(), strict=True)]
        if made is not None:
            made.add(sum(x is not None for x in ids))
        yield pa.RecordBatch.from_arrays([pa.array([block_id] * len(names), pa.int64()), pa.array(names, pa.binary()), pa.array(ids, pa.binary())], ["block_id", "name", "ids"])

    answers = exchange.answer(exchange.ask(packed, question))
    wanted = scratch.write(exchange.finish(packed, answers, shared, "block_id long, name binary, ids binary", numbered=True), "shared")
    first = wanted.where("ids is not null").select("name", "ids")
    lent = wanted.select("block_id", "name").join(first, "name").groupBy("block_id").agg(F.collect_list(F.struct("name", "ids")).alias("lent"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for batch in batches:
            for i in range(batch.num_rows):
                part = bl.load(batch.column("blob")[i].as_buffer())
                known = {x["name"]: unsqueeze(x["ids"], np.uint32).astype(np.int32) for x in batch.column("lent")[i].as_py() or []}
                found, n = Chunked(codec, part.column(column)).encoded(known)
                if made is not None:
                    made.add(n)
                yield rows(codec, part, found)

    return packed.select("block_id", "blob").join(lent.hint("merge"), "block_id", "left").select("blob", "lent").mapInArrow(last, schema)


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of each id array; null gives null, ids outside the vocabulary raise."""
    spark = rows.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = T.StructType([*(f for f in rows.schema if f.name != text_col), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for batch in batches:
            text = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema if f.name != text_col), pa.array(text, pa.string())], [f.name for f in schema])

    return rows.mapInArrow(run, schema)
