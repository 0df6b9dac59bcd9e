"""Substring dedup: repeated token windows, merged into maximal removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tessera.llm import blocks as bl
from tessera.llm.core import Words, buffers, cover, second_hash, window_hash
from tessera.runtime import Scratch, ship


def _windows(batch: pa.RecordBatch, column: str, width: int, buckets: int) -> tuple[Words, np.ndarray, bl.Keys]:
    """Words, window starts, and the windows' distinct keys."""
    w = Words(*buffers(batch.column(batch.schema.get_field_index(column))))
    at = w.windows(width)
    if not len(at):
        return w, at, bl.Keys(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h = w.hashes()
    return w, at, bl.Keys(window_hash(h, width)[at], bl.bucket_of(second_hash(h, width)[at], buckets))


def cut_texts(col: pa.Array, w: Words, raw: np.ndarray, gone: np.ndarray) -> pa.Array:
    """A text column without the removed intervals of words, other bytes as they were.

    raw holds the bytes of the column, w its words. An interval runs from its
    first word to the next kept word, or to the end of the text.
    """
    first, offsets = w.first.tolist(), w.offsets.tolist()
    total = np.concatenate([[0], np.cumsum(gone)])
    hit = np.flatnonzero(total[w.first[1:]] > total[w.first[:-1]])
    if not len(hit):
        return col
    out = col.to_pylist()
    for d in hit.tolist():
        a, b = first[d], first[d + 1]
        text = raw[offsets[d] : offsets[d + 1]].tobytes()
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
        at, kept = 0, []
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            kept.append(text[at : w.starts[a + s] - offsets[d]])
            at = int(w.starts[a + e] - offsets[d]) if a + e < b else len(text)
        out[d] = (b"".join(kept) + text[at:]).decode("utf-8", "replace")
    return pa.array(out, col.type)


def _run(docs: DataFrame, column: str, width: int, sizes: bl.Sizes, last, schema) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "substring")
    packed = bl.pack(scratch, docs, column, sizes)
    n = bl.buckets_for(packed, 0.17, sizes)
    exchange = bl.Exchange(scratch, [n], cap=2, sizes=sizes)

    def question(batch: pa.RecordBatch) -> list[tuple[bl.Keys, list[np.ndarray]]]:
        keys = _windows(batch, column, width, n)[2]
        return [(keys, [keys.size])]

    def found(batch: pa.RecordBatch, got: list[bl.Reply]) -> Iterator[pa.RecordBatch]:
        w, at, keys = _windows(batch, column, width, n)
        hit = keys.back(got[0].sums[0] > 1)
        return last(batch, w, cover(np.sort(at[hit]), width, len(w)))

    return exchange.finish(packed, exchange.answer(exchange.ask(packed, question)), found, schema)


def removal(docs: DataFrame, id_col: str = "doc_id", column: str = "text", width: int = 35, sizes: bl.Sizes = bl.Sizes()) -> DataFrame:
    """What substring dedup takes from each text.

    A window is `width` consecutive words of one text; words are runs of
    characters other than blanks and \\t..\\r. Every word in a window whose word
    sequence starts anywhere else too, the same text included, is removed;
    windows are judged on the input. Returns id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space) and spans (maximal
    removed word intervals [start, end)). One row for each row of docs,
    whatever its id: null or repeated ids stay as they are. Null and empty
    texts, and texts shorter than a window, lose nothing. An empty table gives
    no rows. Other columns are not read.

    A window is known by a 64-bit Rabin-Karp hash within a bucket chosen by an
    independent hash; buckets hold about two million keys at any size, so about
    one window in 10**13 could be taken wrongly. sizes sets the blocks and
    buckets of the exchange, not the result (see blocks.py).
    """
    docs = docs.select(docs[id_col].alias("id"), docs[column].cast("string").alias("text"))
    id_type = docs.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def last(batch: pa.RecordBatch, w: Words, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[w.first[1:]] - total[w.first[:-1]]
        spans = [[] for _ in range(len(removed))]
        for d in np.flatnonzero(removed).tolist():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[w.first[d] : w.first[d + 1]].astype(np.int8), [0]])))
            spans[d] = [{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in w.joined(~gone)], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            [id_col, "n_words", "n_removed", "kept_sha256", "spans"],
        )

    return _run(docs, "text", width, sizes, last, schema)


def dedup_substrings(docs: DataFrame, column: str = "text", width: int = 35, sizes: bl.Sizes = bl.Sizes()) -> DataFrame:
    """docs with the removed intervals cut from the text; every other column and row stays.

    Texts that lose nothing are unchanged, byte for byte; null texts stay null.
    A text that is wholly repeated becomes empty and keeps its row.
    """
    at = docs.columns.index(column)

    def last(batch: pa.RecordBatch, w: Words, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
        arrays = batch.columns
        arrays[at] = cut_texts(batch.column(at), w, w.buf, gone)
        yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return _run(docs, column, width, sizes, last, docs.schema)
