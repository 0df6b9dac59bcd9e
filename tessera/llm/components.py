"""Connected components of a link table, by alternating large and small stars.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
Stars are joins and grouped minima, so no node's links are gathered in a task.
Links that are few when counted are merged in one task instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import Scratch


def _stars(links: Iterator[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Links as stars around the smallest node that they connect."""
    top: dict = {}

    def find(x):
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    stars = [(x, r) for x in top if (r := find(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in stars], schema.field(i).type) for i in (0, 1)], ["a", "b"])


def _contract(links: DataFrame, whole: bool = False) -> DataFrame:
    """Stars of each Arrow batch's links, or with `whole` of each partition's."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not whole:
            for batch in batches:
                yield _stars(pairs(iter([batch])), batch.schema)
        elif (first := next(batches, None)) is not None:
            yield _stars(pairs(chain([first], batches)), first.schema)

    return links.select("a", "b").mapInArrow(run, links.select("a", "b").schema)


def _large(links: DataFrame, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour.

    The minima are written before the join: read from a table, both its sides
    are shuffled for it, so Spark can split a node that holds most links.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(links: DataFrame, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = written(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _nodes(stars: DataFrame) -> DataFrame:
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(scratch: Scratch, links: DataFrame, name: str, max_rounds: int = 60, at_once: int = 300_000) -> DataFrame:
    """(node, root): every linked node and the smallest node it reaches.

    links has columns a and b of one ordered type; loops, repeats and either
    direction are fine, rows with a null end are ignored. An empty table gives
    an empty one. Up to at_once links (some tens of MB) are one task; more take
    a logarithmic number of rounds over all tasks.
    """
    links = scratch.write(_contract(links.where("a is not null and b is not null and a <> b")), f"{name}-0")
    if links.count() <= at_once:
        return _nodes(scratch.write(_contract(links.coalesce(1), True), f"{name}-all"))
    before = None
    for i in range(1, max_rounds):
        starred = scratch.write(_large(links, lambda x, i=i: scratch.write(x, f"{name}-{i}-least")), f"{name}-{i}-large")
        links = scratch.write(_small(starred, lambda x, i=i: scratch.write(x, f"{name}-{i}-down")), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}", f"{name}-{i}-least", f"{name}-{i}-large", f"{name}-{i}-down")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return _nodes(links)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
