"""Hard negatives by inner product, found through one-dimensional distance keys.

A vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so
that of an anchor q (last coordinate 0) nearer is the same as of higher score:
d^2 = |q|^2 + M^2 - 2 q.x. Vectors are stored in blocks, sorted by (pivot, distance to
it). A row at distance d from q has a key within d of q's own distance to the
pivot, so a search scans the key intervals of every pivot within a radius, and
widens them until what is left is farther than the last of its top k: exact,
whatever pivots the sample gave.

Equal vectors of one label are one node with its first ids; one list can't hold
more of them, so results don't change and a vector of a third of all rows is a
node like others. Searches are packed in blocks too; a pair of blocks that meet
is one matrix product, and each task keeps the best k of a search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import _dump, load
from tessera.runtime import Scratch, ship

#: nodes that pivots and first radii are fitted on, pivots at most, nodes of a block, searches of a block
SAMPLE, PIVOTS, BLOCK, SEARCHES = 4096, 64, 1024, 128
#: searches whose best rows a task holds before it sends them on
HELD = 64 * SEARCHES
_ROUNDS_BEFORE_ALL = 4


@dataclass(frozen=True)
class Space:
    """What every task knows: the sample's pivots in augmented space, the sample itself, and bounds."""

    dims: int
    largest: float
    nodes: int
    pivots: np.ndarray
    sample: np.ndarray
    labels: np.ndarray

    @property
    def slack(self) -> float:
        """More than the rounding of a distance."""
        return 1e-6 * (math.sqrt(self.largest) + 1)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as float64, short ones filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def quantised(rows: DataFrame, anchors: Column, scale: float, id_col: str, label_col: str, v_col: str) -> DataFrame:
    """(id, label, v, anchor): components floor(scale * x), and whether the row is an anchor. Rows with a null id, label, vector or component, or one that isn't finite, are left out."""
    v = F.col(v_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(v_col).isNotNull()).where(~bad)
    return whole.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(v, label, ids): the distinct vectors of each label with the `keep` smallest ids of each; tasks cut to those before the shuffle."""
    first = F.row_number().over(Window.partitionBy("v", "label").orderBy("id"))
    kept = rows.withColumn("_at", first).where(F.col("_at") <= keep)
    return kept.groupBy("v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def fit(nodes: DataFrame) -> Space:
    """Pivots: means of a sample of at most SAMPLE nodes, the first ones in the order of their hashes."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most = F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double")))))
    n, dims, largest, component = nodes.agg(F.count("*"), F.max(F.size("v")), F.max(square), most).first()
    dims = dims or 0
    if (component or 0) ** 2 * max(dims, 1) >= 2**63:
        raise ValueError("inner products of these vectors exceed 64-bit integers")
    taken = nodes.select("v", "label").orderBy(F.xxhash64("v", "label"), "v", "label").limit(SAMPLE).toArrow().combine_chunks()
    x = matrix(taken["v"].combine_chunks() if n else pa.array([], pa.list_(pa.int64())), dims)
    space = Space(dims, largest or 0.0, n, np.zeros((1, dims + 1)), x, taken["label"].to_numpy())
    points, rng = space.augmented(x), np.random.default_rng(0)
    centres = points[rng.permutation(len(points))[: min(PIVOTS, max(1, n // 256))]] if n else space.pivots
    for _ in range(8 if n else 0):
        near = Space(dims, space.largest, n, centres, x, space.labels).to_pivots(points).argmin(1)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = points[near == k].mean(0)
    return Space(dims, space.largest, n, centres, x, space.labels)


def index(scratch: Scratch, nodes: DataFrame, space: Space) -> DataFrame:
    """(block, pivot, lo, hi, blob): every node, in blocks of one pivot, sorted by the distance to it."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = space.to_pivots(space.augmented(matrix(batch.column("v"), space.dims)))
            near = far.argmin(1) if len(far) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far[np.arange(len(far)), near])], [*batch.schema.names, "pivot", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table["key"].to_numpy()
            x = matrix(table["v"].chunk(0), space.dims).astype(np.int64)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), space.dims) if space.dims else pa.nulls(len(x), pa.list_(pa.int64(), 0)).fill_null([])
            blob = _dump(pa.RecordBatch.from_arrays([flat, table["label"].chunk(0), table["ids"].chunk(0)], ["v", "label", "ids"]))
            return pa.RecordBatch.from_pydict({"block": [number], "pivot": pa.array([table["pivot"][0].as_py()], pa.int32()), "lo": [keys[0]], "hi": [keys[-1]], "blob": pa.array([blob], pa.binary())})

        for batch in batches:
            pivot = batch.column("pivot").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while a < b:
                    size = sum(h.num_rows for h in held)
                    if held and (size >= BLOCK or held[0].column("pivot")[0].as_py() != pivot[a]):
                        yield block()
                        held, size, number = [], 0, number + 1
                    held.append(batch.slice(a, min(b - a, BLOCK - size)))
                    a += held[-1].num_rows
        if held:
            yield block()

    keyed = scratch.write(nodes.select("v", "label", "ids").mapInArrow(key, "v array<long>, label long, ids array<long>, pivot int, key double"), "keyed")
    tasks = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = keyed.repartitionByRange(tasks, "pivot", "key").sortWithinPartitions("pivot", "key")
    return scratch.write(dealt.mapInArrow(cut, "block long, pivot int, lo double, hi double, blob binary"), "blocks")


def _first(search: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are the first k of their search, by falling score, then rising id; in that order."""
    order = np.lexsort((ids, -score, search))
    s = search[order]
    new = np.flatnonzero(np.diff(s, prepend=-1))
    rank = np.arange(len(s)) - np.repeat(new, np.diff(np.append(new, len(s))))
    return order[rank < k]


class Searches:
    """A block of searches for the k best rows of the anchor's label (or of all others), with scores from `low` to `high`.

    Holds each one's best rows so far, and of each pivot the interval of keys
    that was scanned for all of them.
    """

    COLUMNS = "search long, v array<long>, label long, low long, high long"

    def __init__(self, batch: pa.RecordBatch, space: Space, same: bool, k: int):
        self.batch, self.space, self.same, self.k = batch, space, same, k
        self.x = matrix(batch.column("v"), space.dims)
        self.label, self.low, self.high = (batch.column(c).to_numpy() for c in ("label", "low", "high"))
        self.square = (self.x * self.x).sum(1)
        self.own = space.to_pivots(np.column_stack([self.x, np.zeros(len(self.x))]))

    def distance(self, score: np.ndarray | float) -> np.ndarray:
        return np.sqrt(np.maximum(self.square + self.space.largest - 2 * np.asarray(score, np.float64), 0))

    @property
    def limit(self) -> np.ndarray:
        """Beyond this no row counts: half a score past the lowest one, or the farthest that a row can be."""
        end = np.sqrt(self.square) + math.sqrt(self.space.largest) + self.space.slack
        return np.minimum(end, self.distance(self.low - 0.5) + self.space.slack)

    def fitting(self, score: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return ((self.label[:, None] == labels) == self.same) & (score >= self.low[:, None]) & (score <= self.high[:, None])

    def first_radius(self) -> np.ndarray:
        """Where the sample expects k rows and half as many again."""
        space = self.space
        score = _scores(self.x, space.sample)
        want = max(1, math.ceil(1.5 * self.k * len(space.sample) / max(space.nodes, 1)))
        seen = np.where(self.fitting(score, space.labels), score.astype(np.float64), -np.inf)
        if seen.shape[1] < want:
            return self.limit
        at = np.partition(seen, seen.shape[1] - want, axis=1)[:, seen.shape[1] - want]
        known = np.isfinite(at)
        return np.minimum(self.limit, np.where(known, self.distance(np.where(known, at, 0) - 0.5) + space.slack, np.inf))

    def intervals(self, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pivot, the keys that rows within the radius of any search can have; none for rows above `high`."""
        inner = self.distance(np.minimum(self.high, 2.0**62) + 0.5) - self.space.slack
        live = radius > 0
        if not live.any():
            return np.full(self.own.shape[1], np.inf), np.full(self.own.shape[1], -np.inf)
        lo = np.maximum(self.own - radius[:, None], np.where(self.high[:, None] < 2**62, inner[:, None] - self.own, -np.inf))[live]
        hi = (self.own + radius[:, None])[live]
        return lo.min(0) - self.space.slack, hi.max(0) + self.space.slack

    def best(self, block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, score, id) of the first k rows of a block, for each search."""
        y = np.asarray(block.column("v").flatten(), np.float64).reshape(block.num_rows, -1) if self.space.dims else np.zeros((block.num_rows, 0))
        score = _scores(self.x, y)
        seen = np.where(self.fitting(score, block.column("label").to_numpy()), score, np.iinfo(np.int64).min)
        at = max(seen.shape[1] - self.k, 0)
        least = np.partition(seen, at, axis=1)[:, at]
        search, node = np.nonzero((seen >= least[:, None]) & (seen > np.iinfo(np.int64).min))
        ids = block.column("ids")
        start, size = ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py(), np.diff(ids.offsets.to_numpy())
        many = size[node]
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[node], many)
        search, value, found = np.repeat(search, many), np.repeat(score[search, node], many), ids.flatten().to_numpy()[which]
        first = _first(search, value, found, self.k)
        return search[first], value[first], found[first]


def _lists(search: np.ndarray, *values: np.ndarray, n: int) -> list[pa.Array]:
    """Entries sorted by search as a list for each of n searches."""
    offsets = pa.array(np.searchsorted(search, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def search(scratch: Scratch, blocks: DataFrame, searches: DataFrame, space: Space, same: bool, k: int, name: str) -> DataFrame:
    """(search, scores, ids) of searches (search, v, label, low, high): the first k rows of each.

    Rounds widen the radius: first to what the sample expects, then to the k-th
    best found, which leaves nothing nearer; searches that found fewer than k
    go on by halves and in the end to every block.
    """
    spark, keys = scratch.spark, len(space.pivots)
    state = "part long, pending long, blob binary"

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), space.dims)
            at = space.to_pivots(np.column_stack([x, np.zeros(len(x))])).argmin(1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "near"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for a in range(0, batch.num_rows, SEARCHES):
                part = batch.slice(a, SEARCHES)
                s = Searches(part, space, same, k)
                none = pa.array([[]] * part.num_rows, pa.list_(pa.int64()))
                yield _packed(number, part, s.first_radius(), np.full(keys, np.inf), np.full(keys, -np.inf), none, none, np.ones(part.num_rows, bool))
                number += 1

    def _packed(number, part, radius, lo, hi, scores, ids, pending) -> pa.RecordBatch:
        static = [part.column(c) for c in ("search", "v", "label", "low", "high")]
        blob = _dump(pa.RecordBatch.from_arrays([*static, pa.array(np.where(pending, radius, 0)), scores, ids, pa.array(pending)], ["search", "v", "label", "low", "high", "radius", "scores", "ids", "pending"]))
        ends = _dump(pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"]))
        return pa.RecordBatch.from_pydict({"part": [number], "pending": [int(pending.sum())], "blob": pa.array([len(ends).to_bytes(8, "little") + ends + blob], pa.binary())})

    def opened(raw: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        size = int.from_bytes(raw[:8], "little")
        ends = load(raw[8 : 8 + size])
        return load(raw[8 + size :]), ends.column("lo").to_numpy(), ends.column("hi").to_numpy()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                part, lo, hi = opened(raw)
                a, b = Searches(part, space, same, k).intervals(part.column("radius").to_numpy())
                a, b = np.minimum(a, lo), np.maximum(b, hi)
                yield pa.RecordBatch.from_arrays([pa.array([number] * keys), pa.array(np.arange(keys), pa.int32()), pa.array(a), pa.array(b), pa.array(lo), pa.array(hi)], ["part", "pivot", "from", "to", "old_from", "old_to"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for number, raw, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "blob", "rows")), strict=True):
                part, _, _ = opened(raw)
                found = Searches(part, space, same, k).best(load(blob))
                if number in held:
                    found = [np.concatenate(x) for x in zip(held[number], found, strict=True)]
                    first = _first(*found, k)
                    found = [x[first] for x in found]
                held[number] = list(found)
                if len(held) * SEARCHES > HELD:
                    yield sent(held)
                    held = {}
        yield sent(held)

    def sent(held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        part = np.repeat(np.array(list(held), np.int64), [len(v[0]) for v in held.values()]) if held else np.zeros(0, np.int64)
        rest = [np.concatenate([np.asarray(v[i], np.int64) for v in held.values()] or [np.zeros(0, np.int64)]) for i in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (part, *rest)], ["part", "at", "score", "id"])

    def widen(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, raw, found in zip(*(batch.column(c).to_pylist() for c in ("part", "blob", "found")), strict=True):
                    part, lo, hi = opened(raw)
                    s, n = Searches(part, space, same, k), part.num_rows
                    radius = part.column("radius").to_numpy()
                    a, b = s.intervals(radius)
                    lo, hi = np.minimum(a, lo), np.maximum(b, hi)
                    had = [np.asarray(part.column(c).flatten(), np.int64) for c in ("scores", "ids")]
                    at = np.repeat(np.arange(n), np.diff(part.column("scores").offsets.to_numpy()))
                    new = np.array([[f["at"], f["score"], f["id"]] for f in found or []], np.int64).reshape(-1, 3)
                    at, score, ids = (np.concatenate(x) for x in zip((at, *had), new.T, strict=True))
                    first = _first(at, score, ids, k)
                    at, score, ids = at[first], score[first], ids[first]
                    count = np.bincount(at, minlength=n)
                    last = np.zeros(n)
                    last[at] = score  # entries are in order: the last one stays
                    needed = np.where(count >= k, np.minimum(s.distance(last - 0.5) + space.slack, s.limit), s.limit)
                    pending = part.column("pending").to_numpy(zero_copy_only=False) & (radius < needed)
                    goal = np.where(count >= k, needed, s.limit if turn >= _ROUNDS_BEFORE_ALL else np.minimum(radius * 1.5, s.limit))
                    yield _packed(number, part, goal, lo, hi, *_lists(at, score, ids, n=n), pending)

        return run

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # searches of near vectors share blocks
    placed = scratch.write(searches.mapInArrow(near, f"{Searches.COLUMNS}, near int"), f"{name}-placed")
    dealt = placed.repartitionByRange(tasks, "near", "label", "search").sortWithinPartitions("near", "label", "search")
    now = scratch.write(dealt.mapInArrow(pack, state), f"{name}-0")
    turn = 0
    while not now.where("pending > 0").isEmpty():
        turn += 1
        live = now.where("pending > 0")
        wanted = live.mapInArrow(spans, "part long, pivot int, `from` double, `to` double, old_from double, old_to double")
        meta = blocks.select("block", F.col("pivot").alias("of"), "lo", "hi")
        new = (F.col("hi") >= F.col("from")) & (F.col("lo") <= F.col("to")) & ~((F.col("hi") >= F.col("old_from")) & (F.col("lo") <= F.col("old_to")))
        pairs = scratch.write(wanted.join(meta, (F.col("pivot") == F.col("of")) & new).select("part", "block"), f"{name}-pairs-{turn}")
        rows = pairs.join(live.select("part", "blob"), "part").join(blocks.select("block", F.col("blob").alias("rows")), "block")
        found = rows.select("part", "blob", "rows").mapInArrow(meet, "part long, at long, score long, id long")
        rank = F.row_number().over(Window.partitionBy("part", "at").orderBy(F.desc("score"), "id"))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("part").agg(F.collect_list(F.struct("at", "score", "id")).alias("found"))
        moved = live.join(best, "part", "left").select("part", "blob", "found").mapInArrow(widen(turn), state)
        now = scratch.write(moved.unionByName(now.where("pending = 0")), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-pairs-{turn}")

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("blob").to_pylist():
                part, _, _ = opened(raw)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("search", "scores", "ids")], ["search", "scores", "ids"])

    return now.mapInArrow(out, "search long, scores array<long>, ids array<long>")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "id", label_col: str = "label", v_col: str = "v") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows that `anchors` holds for.

    Components become floor(scale * x); a score is the integer inner product,
    higher ones first, ties by id. An anchor's positives are its first rows of
    the same label, itself left out; for each, the first rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score,
    ranked from 1. Exact.

    Rows with a null id, label, vector or component, or one that isn't finite,
    take no part. Vectors of different lengths meet as if filled up with zeros;
    an empty vector scores 0 with all. Repeated rows count each on its own.
    An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "negatives")
    kept = scratch.write(quantised(rows, anchors, scale, id_col, label_col, v_col), "rows")
    nodes = scratch.write(nodes_of(kept.drop("anchor"), max(positives + 1, negatives)), "nodes")
    space = fit(nodes)
    blocks = index(scratch, nodes, space)

    picked = scratch.write(kept.where("anchor").select("id", "label", "v"), "anchors")
    queries = scratch.write(picked.select("v", "label").distinct().withColumn("search", F.monotonically_increasing_id()), "queries")
    top = 1 << 62
    found = search(scratch, blocks, queries.select("search", "v", "label", F.lit(-top).alias("low"), F.lit(top).alias("high")), space, True, positives + 1, "positives")
    found = scratch.write(found, "positives")
    # every score that a positive can have is a search of its own
    scores = found.join(queries, "search").select("search", "v", "label", F.explode(F.array_distinct("scores")).alias("score")).where("score >= 0")
    scores = scratch.write(scores.withColumn("of", F.col("search")).withColumn("search", F.monotonically_increasing_id()), "scores")
    bounds = scores.withColumn("wide", F.col("score").cast("decimal(20,0)")).select("search", "v", "label", F.expr(f"(wide * {low} + 99) div 100").alias("low"), F.expr(f"(wide * {high}) div 100").alias("high"))
    worst = scratch.write(search(scratch, blocks, bounds, space, False, negatives, "negatives"), "negatives")

    pairs = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct(x["scores"].alias("score"), x["ids"].alias("id")))
    mates = picked.join(queries, ["v", "label"]).join(found.select("search", pairs.alias("best")), "search").select("search", "id", "v", "best")
    # an anchor's own entry, if it is among its best, is known by its score too
    self_score = F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + x * x)
    own = F.array_position("best", F.struct(self_score.alias("score"), F.col("id").alias("id")))
    others = F.filter("best", lambda x, i: (F.col("own") == 0) | (i != F.col("own") - 1))
    mates = mates.withColumn("own", own).select("search", F.col("id").alias("anchor_id"), F.explode(F.slice(others, 1, positives)).alias("p"))
    mates = mates.select(F.col("search").alias("of"), "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    lists = scores.select("search", "of", F.col("score").alias("positive_score")).join(worst.select("search", pairs.alias("worst")), "search").drop("search")
    out = mates.join(lists, ["of", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("worst").alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))
