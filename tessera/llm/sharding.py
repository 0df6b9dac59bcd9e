"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of id, text checksum and size. A balanced
Feistel network permutes the numbers 0..N-1 (cycle walking brings numbers
beyond N back in), and the permuted number p gives shard p mod n and slot
p div n: shard and slot of any row number can be computed without data, and the
shards' row counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm.core import mix64
from tessera.runtime import Scratch, ship

ROUNDS = 6


def _feistel(x: np.ndarray, half: int, seed: int, inverse: bool) -> np.ndarray:
    """One pass of the network over 2 * half bits."""
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        key = mix64(np.array([seed * ROUNDS + r + 1], np.uint64))[0]
        if inverse:
            left, right = right ^ (mix64(left + key) & mask), left
        else:
            left, right = right, left ^ (mix64(right + key) & mask)
    return left << h | right


def permute(numbers: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 that seed names, or its inverse, at each of the numbers."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    out = _feistel(numbers.astype(np.uint64), half, seed, inverse)
    while len(far := np.flatnonzero(out >= np.uint64(n))):
        out[far] = _feistel(out[far], half, seed, inverse)
    return out.astype(np.int64)


def place(numbers: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each row number among n rows."""
    p = permute(numbers, n, seed)
    return p % shards, p // shards


def number_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The row number at a shard's slot: the inverse of place()."""
    return permute(slot * shards + shard, n, seed, inverse=True)


def _numbered(scratch: Scratch, rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with their number in a total order, and how many there are.

    Sorted partitions are written once with their own row numbers; only the
    count of each partition goes to the driver. Rows equal in all of `order`
    are interchangeable, so the numbers depend on nothing but the table.
    """
    spark = rows.sparkSession
    # a mark that tells equal rows apart lets a range end among them, so many copies of a row are dealt over tasks
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    ordered = scratch.write(ordered.withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "ordered")
    counts = dict(ordered.groupBy("_part").count().collect())
    size = max(counts, default=-1) + 1
    base = np.concatenate([[0], np.cumsum([counts.get(i, 0) for i in range(size)])])
    starts = spark.createDataFrame([(i, int(base[i])) for i in range(size)], "_part int, _base long")
    # one row a partition of the sort: bounded by the number of partitions
    return ordered.join(F.broadcast(starts), "_part").withColumn("number", F.col("_at") + F.col("_base")).drop("_at", "_base", "_part"), int(base[-1])


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """Shard and slot of each row: a reproducible shuffle with equal row counts.

    Returns id, size (UTF-8 bytes of the text, null as empty, plus 1),
    text_crc32 (unsigned), number (global row number), shard and slot (gapless
    from 0 in each shard). Rows with null or repeated ids are numbered like
    others, nulls first; rows equal in id, checksum and size may swap places.
    An empty table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(docs[column].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    numbered, n = _numbered(scratch, rows, ["id", "text_crc32", "size"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shard, slot = place(pdf["number"].to_numpy(), n, shards, seed)
            yield pdf.assign(shard=shard.astype(np.int32), slot=slot)

    schema = T.StructType([*numbered.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return numbered.mapInPandas(run, schema).withColumnRenamed("id", id_col)
