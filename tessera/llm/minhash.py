"""MinHash near-dedup with an LSH forest.

Every text's set of word shingles gets 128 minimum hashes, cut into 16 trees of
depth 8. A tree is a sorted order of the texts by its 8 values, so texts next
to each other have the longest common prefixes. A text takes candidates from
its nearest predecessors in each order: it walks back, longest prefix first,
until it has met enough similar texts, the common prefix is under the least
depth, or the reach ends. Where many texts share a prefix the walk stays among
the deepest matches, and where few do it goes down to the least depth: the
depth adapts to the region. Texts with one and the same set are one node.

Candidates pass a bit sketch first. Then the sets themselves, made from the
whole texts, confirm each link: the best link of each node in the first round,
in later rounds only links between components that are still apart.

In a crowded region a text hands on its nearest candidate, so that the region
hangs together, and its best one: the others are left to the exact join below.
A walk that met enough similar texts may have left a link behind. The texts of
every region where either can be (one tree, one prefix of the least depth) are
joined once more, exactly, by prefix filtering (Chaudhuri, Ganti and Kaushik
2006): with shingles in one order for all texts, the rarest first, two texts
similar enough share a shingle among the first n - ceil(similarity * n) + 1 of
each, and so early in the shorter one that the rest can still hold the overlap
(Xiao et al. 2008). What thousands of texts have in common comes last in that
order, so a region of texts just below the threshold gives no candidates. Only
confirmed links spare a comparison. A text hands on its best candidate in a cell
of that join; what these links leave apart meets with its whole sets in the
cell, which hands on links alone: no table grows with the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.core import Words, buffers, make_room, mix64, slices, span_hash, squeeze, unmatched, unsqueeze, window_hash
from tessera.llm.urls import BlockedBloom
from tessera.runtime import Scratch, ship

TREES, DEPTH = 16, 8
PERMS = TREES * DEPTH
MIN_DEPTH, REACH = 3, 64
#: partitions whose seams fit in a task
SEAMS = 256
#: the walk ends after so many sure candidates, or so many in all
SURE, WANT = 2, 6
#: rows in a block of a group's comparison, and texts on either side of a cell of confirmations
BLOCK, CELL = 256, 128
#: what names a cell of the exact join: a shingle, one of two kinds of pairs, and a block of either side
CELL_KEY = ("grp", "kind", "x", "y")
#: cells of the sketch of shingle frequencies, a power of two; its errors change the order, not the result
FREQUENCY_CELLS = 1 << 22
#: of 128 two-bit minima, those that agree at a similarity of 0.8: 108.8, deviation 4.0
SKETCH_SIGMAS = 4.6
_MUL = mix64(np.arange(1, PERMS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    w = Words(*buffers(col), lower=True)
    h, first = w.hashes(), w.first
    at = w.windows(width)
    wide = window_hash(h, width)
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    whole = dict(zip(short.tolist(), span_hash(h, first[short], first[short + 1]), strict=True))
    cut = np.searchsorted(at, first)
    sets, none = [], np.zeros(0, np.uint64)
    for d in range(len(first) - 1):
        a, b = cut[d], cut[d + 1]
        if b > a:
            s = np.sort(wide[at[a] : at[b - 1] + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            sets.append(np.array([whole[d]], np.uint64) if d in whole else none)
    return (np.concatenate(sets) if sets else none), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """PERMS minima of each segment of values, mixed: minima of long texts are small, and so alike in their bits."""
    out = np.empty((len(starts), PERMS), np.uint64)
    for i in range(PERMS):
        out[:, i] = np.minimum.reduceat(values * _MUL[i], starts)
    return mix64(out)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows = np.ascontiguousarray(rows)
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(rows.tobytes())])


def _rows_of(col: pa.Array, width: int) -> np.ndarray:
    """A binary column of one width as rows of bytes."""
    return buffers(col)[0].reshape(-1, width)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """(id, row_key, n, nid, sig, sketch) of each row: nid names its set, null if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values, cut = shingle_sets(part.column("text"), width)
                n = np.diff(cut)
                full = np.flatnonzero(n)
                nid, sig, sketch = (np.zeros((part.num_rows, k), np.uint8) for k in (16, 2 * PERMS, PERMS // 4))
                if len(full):
                    at = cut[full]
                    digest = np.stack([np.add.reduceat(mix64(values + np.uint64(k)), at) for k in (1, 2)], 1)
                    nid[full] = digest.astype(">u8").view(np.uint8).reshape(-1, 16)
                    minima = _signatures(values, at)
                    sig[full] = minima.astype(np.uint16).astype(">u2").view(np.uint8).reshape(len(full), -1)
                    two = (minima >> np.uint64(16)).astype(np.uint8) & 3
                    sketch[full] = two[:, 0::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6
                empty = pa.array(n == 0)
                none = pa.scalar(None, pa.binary())
                cols = [pa.compute.if_else(empty, none, _binary(x)) for x in (nid, sig, sketch)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row_key"), pa.array(n), *cols], ["id", "row_key", "n", "nid", "sig", "sketch"])

    id_type = docs.schema["id"].dataType
    fields = [("id", id_type), ("row_key", T.LongType()), ("n", T.LongType()), ("nid", T.BinaryType()), ("sig", T.BinaryType()), ("sketch", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def _forest(nodes: DataFrame) -> DataFrame:
    """(tree, key, nid, sketch, n): a row for each node and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = _rows_of(batch.column("sig"), 2 * PERMS)
                for t in range(TREES):
                    key = _binary(sig[:, 2 * DEPTH * t : 2 * DEPTH * (t + 1)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sig), t, np.int32)), key, batch.column("nid"), batch.column("sketch"), batch.column("n")], ["tree", "key", "nid", "sketch", "n"])

    return nodes.select("nid", "sig", "sketch", "n").mapInArrow(run, "tree int, key binary, nid binary, sketch binary, n long")


def _gate(similarity: float) -> tuple[int, float]:
    """Places of two sketches that agree: the least of a candidate, and of a sure one."""
    p = 0.25 + 0.75 * similarity
    sigma = (PERMS * p * (1 - p)) ** 0.5
    return int(PERMS * p - SKETCH_SIGMAS * sigma), PERMS * p + 1.5 * sigma


def _agree(x: np.ndarray) -> np.ndarray:
    """Places that agree, from the exclusive or of sketches as four words each."""
    return PERMS - np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int32)


def _neighbours(ordered: DataFrame, similarity: float) -> DataFrame:
    """Candidate links within each sorted partition, and its outermost rows (kind 1) for the seams."""
    least, sure = _gate(similarity)
    head = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("agree", pa.int32()), ("crowded", pa.int32()), ("tree", pa.int32()), ("key", pa.binary()), ("nid", pa.binary()), ("sketch", pa.binary()), ("n", pa.int64())])

    def seam(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in rows.to_batches():
            none = [pa.nulls(b.num_rows, head.field(k).type) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(b.num_rows, np.int32)), *none, *b.columns], schema=head)

    def links(t: pa.Table, new: int) -> pa.RecordBatch:
        """Links of the last `new` rows to rows before them; of a row in a crowded region the nearest and the best."""
        tree = t["tree"].to_numpy()
        key = _rows_of(t["key"], 2 * DEPTH)[:, : 2 * MIN_DEPTH].copy()
        sk = _rows_of(t["sketch"], PERMS // 4).copy().view(np.uint64)
        n = t["n"].to_numpy()
        live = np.arange(t.num_rows - new, t.num_rows)
        met = np.zeros(t.num_rows, np.int32)
        found = []
        for lag in range(1, REACH + 1):
            live = live[live >= lag]
            live = live[(tree[live] == tree[live - lag]) & (key[live] == key[live - lag]).all(1)]
            if not len(live):
                break
            agree = _agree(sk[live] ^ sk[live - lag])
            lo, hi = np.minimum(n[live], n[live - lag]), np.maximum(n[live], n[live - lag])
            ok = (agree >= least) & (lo >= similarity * hi - 1e-9)
            found.append((live[ok], live[ok] - lag, agree[ok]))
            met[live[ok]] += np.where(agree[ok] >= sure, WANT // SURE, 1)
            live = live[met[live] < WANT]
        i, j, agree = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [[], [], []]))
        i, j = i.astype(int), j.astype(int)
        run = np.cumsum(np.append(False, (tree[1:] != tree[:-1]) | (key[1:] != key[:-1]).any(1)))
        crowded = np.bincount(run)[run[i]] > SURE + 1  # a region's rows here are no more than it has
        handed = ~crowded
        for order in (np.lexsort((i - j, i)), np.lexsort((i - j, -agree, i))):
            handed[order[np.flatnonzero(np.diff(i[order], prepend=-1))]] = True
        i, j, agree, crowded = (x[handed] for x in (i, j, agree, crowded))
        nid = _rows_of(t["nid"], 16)
        u, v = nid[i], nid[j]
        swap = np.array([a.tobytes() > b.tobytes() for a, b in zip(u, v, strict=True)], bool).reshape(-1, 1)
        a, b = np.where(swap, v, u), np.where(swap, u, v)
        rest = [pa.nulls(len(a), head.field(k).type) for k in range(5, 10)]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), _binary(a), _binary(b), pa.array(agree.astype(np.int32)), pa.array(crowded.astype(np.int32)), *rest], schema=head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            if tail is None:
                yield from seam(new.slice(0, REACH).combine_chunks())
            both = new if tail is None else pa.concat_tables([tail, new])
            yield links(both.combine_chunks(), new.num_rows)
            tail = both.slice(max(0, both.num_rows - REACH))
        if tail is not None:
            yield from seam(tail.combine_chunks())

    return ordered.mapInArrow(run, "kind int, a binary, b binary, agree int, crowded int, tree int, key binary, nid binary, sketch binary, n long")


def _candidates(scratch: Scratch, nodes: DataFrame, similarity: float, partitions: int) -> DataFrame:
    """(a, b, agree, crowded): candidate links of the forest, a < b, each once; crowded: met in a region that is left to the exact join."""
    order = ["tree", "key", "nid"]
    ordered = _forest(nodes).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    found = scratch.write(_neighbours(ordered, similarity), "neighbours")
    pairs = found.where("kind = 0")
    while partitions > 1:  # rows at the seams of the partitions, then at the seams of theirs
        partitions = 1 if partitions <= SEAMS else partitions // SEAMS
        seams = found.where("kind = 1").select("tree", "key", "nid", "sketch", "n").distinct()
        seams = (seams.repartitionByRange(partitions, *order) if partitions > 1 else seams.coalesce(1)).sortWithinPartitions(*order)
        found = _neighbours(seams, similarity)
        if partitions > 1:
            found = scratch.write(found, f"seams-{partitions}")
        pairs = pairs.union(found.where("kind = 0"))
    return scratch.write(pairs.groupBy("a", "b").agg(F.max("agree").alias("agree"), (F.max("crowded") == 1).alias("crowded")), "pairs")


def _regions(nodes: DataFrame) -> DataFrame:
    """(grp, nid, and root if nodes has it) of each node and tree: grp is the tree and its first MIN_DEPTH minima, exactly."""
    kept = [c for c in ("nid", "root") if c in nodes.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig, key = _rows_of(batch.column("sig"), 2 * PERMS), np.zeros((batch.num_rows, 8), np.uint8)
                for t in range(TREES):
                    key[:, 1], key[:, 2:] = t, sig[:, 2 * DEPTH * t : 2 * DEPTH * t + 2 * MIN_DEPTH]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(">i8").ravel().astype(np.int64)), *(batch.column(c) for c in kept)], ["grp", *kept])

    return nodes.select("sig", *kept).mapInArrow(run, "grp long, " + ", ".join(f"{c} binary" for c in kept))


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets hold the shingles of each of FREQUENCY_CELLS cells, up to 2**32 - 1: a sketch of bounded size."""
    pieces = 64
    width = FREQUENCY_CELLS // pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCY_CELLS, np.uint64)
        for batch in batches:
            for raw in batch.column("shingles").to_pylist():
                np.add.at(total, _cells(unpacked(raw)), np.uint64(1))
        for i, part in enumerate(total.reshape(pieces, width)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([squeeze(part)], pa.binary())], ["piece", "n"])

    def merge(key: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.uint64)
        for batch in batches:
            for raw in batch.column("n").to_pylist():
                total += unsqueeze(raw, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([squeeze(np.minimum(total, 2**32 - 1).astype(np.uint32))], pa.binary())], ["piece", "n"])

    schema = "piece int, n binary"
    out = np.zeros((pieces, width), np.uint32)
    for r in sets.select("shingles").mapInArrow(run, schema).groupBy("piece").applyInArrow(merge, schema).collect():
        out[r["piece"]] = unsqueeze(r["n"], np.uint32)
    return out.ravel()


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (mix64(shingles) % np.uint64(FREQUENCY_CELLS)).astype(np.int64)


def packed(shingles: np.ndarray) -> bytes:
    """A sorted set as bytes."""
    return squeeze(np.diff(shingles, prepend=np.uint64(0)))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw, np.uint64), dtype=np.uint64)


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(grp, root, nid, sketch, n, left, early) of each set and each shingle in its prefix of the rarest ones.

    left: shingles from there to the end of the order; early: enough of them
    for an overlap with a set at least as large.
    """
    frequency = sets.sparkSession.sparkContext.broadcast(squeeze(_frequencies(sets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = unsqueeze(frequency.value, np.uint32)
        for batch in batches:
            for i, raw in enumerate(batch.column("shingles").to_pylist()):
                s = unpacked(raw)
                n = len(s)
                grp = s[np.lexsort((s, often[_cells(s)]))[: n + percent * n // -100 + 1]].view(np.int64)
                left = n - np.arange(len(grp))
                same = pa.array(np.full(len(grp), i))
                yield pa.RecordBatch.from_arrays([pa.array(grp), *(batch.column(c).take(same) for c in ("root", "nid", "sketch", "n")), pa.array(left), pa.array((left * (100 + percent) >= 2 * percent * n).astype(np.int32))], [*fields, "left", "early"])

    fields = ["grp", "root", "nid", "sketch", "n"]
    return sets.select("shingles", "root", "nid", "sketch", "n").mapInArrow(run, "grp long, root long, nid binary, sketch binary, n long, left long, early int")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by CELL_KEY, in tables that cut no cell."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        both = (new if kept is None else pa.concat_tables([kept, new])).combine_chunks()
        cell = np.stack([both[c].to_numpy() for c in CELL_KEY], 1)
        other = np.flatnonzero((cell != cell[-1]).any(1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield both.slice(0, cut).combine_chunks()
        kept = both.slice(cut)
    if kept is not None:
        yield kept.combine_chunks()


def _met(t: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, agree): candidate links between components, as numbers of a cell's left rows (side 0) and right ones, a block of left rows at a time."""
    least, _ = _gate(percent / 100)
    cell = np.stack([t[c].to_numpy() for c in CELL_KEY], 1)
    side, root, n, rest = (t[c].to_numpy() for c in ("side", "root", "n", "left"))
    sk = _rows_of(t["sketch"], PERMS // 4).copy().view(np.uint64)
    edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1).tolist(), len(cell)]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        left, right = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
        for k in range(0, len(left), BLOCK):
            i, j = left[k : k + BLOCK, None], right[None]
            # the overlap that a link needs must fit in what is left of both orders
            ok = (root[i] != root[j]) & (np.minimum(rest[i], rest[j]) * (100 + percent) >= percent * (n[i] + n[j]))
            at, to = np.nonzero(ok)
            u, v = left[k + at], right[to]
            agree = _agree(sk[u] ^ sk[v])
            found = agree >= least
            if found.any():
                yield u[found], v[found], agree[found]


def _ends(t: pa.Table, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """(a, b), a < b, of rows u and v."""
    nid = _rows_of(t["nid"], 16)
    high, low = nid.copy().view(">u8").astype(np.uint64).T
    first = (high[u] < high[v]) | ((high[u] == high[v]) & (low[u] < low[v]))
    return pa.RecordBatch.from_arrays([_binary(nid[np.where(first, u, v)]), _binary(nid[np.where(first, v, u)])], ["a", "b"])


def _across(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): of each left row of a cell its best candidate in another component, if it has any there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            for u, v, agree in _met(t, percent):
                order = np.lexsort((-agree, u))
                best = order[np.flatnonzero(np.diff(u[order], prepend=-1))]
                yield _ends(t, u[best], v[best])

    return dealt.mapInArrow(run, "a binary, b binary")


def _open_rows(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows that have a candidate in another component in their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            found = np.zeros(t.num_rows, bool)
            for u, v, _ in _met(t, percent):
                found[u] = found[v] = True
            yield from t.filter(pa.array(found)).to_batches()

    return dealt.mapInArrow(run, dealt.schema)


def _links_in_cells(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect the components of a cell as all its links do, from rows with their sets.

    Every candidate of a cell is looked at where both sets are, so no pair is
    written, and a cell gives fewer links than it has rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            root, n = t["root"].to_numpy(), t["n"].to_numpy()
            for u, v, _ in _met(t, percent):
                rows, number = np.unique(np.concatenate([u, v]), return_inverse=True)
                sets = [unpacked(raw) for raw in t["shingles"].take(pa.array(rows)).to_pylist()]
                same = _same(sets, number[: len(u)], number[len(u) :])
                top: dict[int, int] = {}
                some = []
                for k in np.flatnonzero(100 * same >= percent * (n[u] + n[v] - same)).tolist():
                    x, y = int(root[u[k]]), int(root[v[k]])
                    while (up := top.get(x, x)) != x:
                        x = up
                    while (up := top.get(y, y)) != y:
                        y = up
                    if x != y:
                        top[x] = y
                        some.append(k)
                if some:
                    yield _ends(t, u[some], v[some])

    return dealt.mapInArrow(run, "a binary, b binary")


def _blocks(kind: int, on_left: Column, on_right: Column) -> list[Column]:
    """Where a row goes as a left and as a right one: arrays of (kind, side, x, y)."""
    lines, cols = F.col(f"lines{kind}"), F.col(f"cols{kind}")
    line, col = F.pmod(F.xxhash64("nid", F.lit(1)), lines), F.pmod(F.xxhash64("nid", F.lit(2)), cols)

    def at(side: int, x: Column, y: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(side).alias("side"), x.alias("x"), y.alias("y"))

    def to(n: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), n - 1)

    fits = (lines > 0) & (cols > 0)
    left = F.when(fits & on_left, F.transform(to(cols), lambda y: at(0, line, y)))
    right = F.when(fits & on_right, F.transform(to(lines), lambda x: at(1, x, col)))
    return [left.otherwise(F.array()), right.otherwise(F.array())]


def _root_number(root: str) -> Column:
    """A component's number, from its root or the set itself."""
    return F.conv(F.hex(F.substring(F.coalesce(root, "nid"), 1, 7)), 16, 10).cast("long")


def _dealt(scratch: Scratch, rows: DataFrame, table: str) -> DataFrame:
    """Rows of _rarest() in cells where those of different components meet, if they share a shingle.

    Of the sets that share one, at least one of a pair is outside the largest
    component and at least one has the shingle early: both kinds are cut into
    blocks, and so is what they have to meet; block meets block.
    """
    sizes = rows.groupBy("grp", "root").agg(F.count("*").alias("k"), F.sum("early").alias("e")).groupBy("grp").agg(F.sum("k").alias("k"), F.sum("e").alias("e"), F.max(F.struct("k", "root", "e")).alias("most"))
    odd_early = F.col("e") - F.col("most.e")
    counts = {"lines1": odd_early, "cols1": F.col("k"), "lines2": F.col("k") - F.col("most.k") - odd_early, "cols2": F.col("e")}
    groups = sizes.where((F.col("k") > F.col("most.k")) & (F.col("e") > 0)).select("grp", F.col("most.root").alias("main"), *(F.ceil(c / BLOCK).alias(name) for name, c in counts.items()))
    rows = rows.join(scratch.write(groups, table), "grp")
    odd, early = F.col("root") != F.col("main"), F.col("early") == 1
    parts = _blocks(1, odd & early, F.lit(True)) + _blocks(2, odd & ~early, early)
    whole = ["root", "nid", "sketch", "n", "left"]
    return rows.select("grp", *whole, F.explode(F.concat(*parts)).alias("c")).select("grp", "c.kind", "c.x", "c.y", "c.side", *whole)


def _by_cell(dealt: DataFrame, partitions: int) -> DataFrame:
    return dealt.repartition(partitions, *CELL_KEY).sortWithinPartitions(*CELL_KEY)


def _same(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets, given by their numbers."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum([0, *map(len, sets)])
    held, out = np.zeros(int(ids.max()) + 1, bool), np.zeros(len(left), np.int64)
    order = np.argsort(left, kind="stable")
    cut = np.flatnonzero(np.diff(left[order], prepend=-1))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        mine = ids[at[left[order[lo]]] : at[left[order[lo]] + 1]]
        held[mine] = True
        for k in order[lo:hi].tolist():
            out[k] = np.count_nonzero(held[ids[at[right[k]] : at[right[k] + 1]]])
        held[mine] = False
    return out


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(a, b): the pairs whose full sets are similar enough: 100 * intersection >= percent * union.

    Sets are dealt over as many classes as keep CELL of them in each; a pair is
    looked at in the cell of its two classes, where each set comes once for all
    of its pairs.
    """
    classes = F.lit(sets.count() // CELL + 1)
    x, y = (F.pmod(F.xxhash64(c), classes) for c in ("a", "b"))
    dealt = pairs.select(x.alias("x"), y.alias("y"), "a", "b")
    ends = dealt.select("x", "y", F.col("a").alias("nid")).union(dealt.select("x", "y", F.col("b").alias("nid"))).distinct()
    none = F.lit(None).cast("binary")
    rows = ends.join(sets.select("nid", "shingles"), "nid").select("x", "y", F.lit(0).alias("side"), F.col("nid").alias("a"), none.alias("b"), "shingles")
    rows = rows.union(dealt.select("x", "y", F.lit(1), "a", "b", none)).repartition(partitions, "x", "y").sortWithinPartitions("x", "y", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, number, sets, left, right = None, {}, [], [], []

        def found() -> Iterator[pa.RecordBatch]:
            if left:
                i, j = np.array(left), np.array(right)
                size, same = np.array([len(s) for s in sets]), _same(sets, i, j)
                keep = 100 * same >= percent * (size[i] + size[j] - same)
                names = list(number)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in at[keep].tolist()], pa.binary()) for at in (i, j)], ["a", "b"])

        for batch in batches:
            for x, y, side, a, b, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (x, y) != cell:
                    yield from found()
                    cell, number, sets, left, right = (x, y), {}, [], [], []
                if side == 0:
                    number[a] = len(sets)
                    sets.append(unpacked(shingles))
                else:
                    left.append(number[a])
                    right.append(number[b])
        yield from found()

    return rows.mapInArrow(run, "a binary, b binary")


def _named(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, row_key, n, nid, root, component_id) of each row of docs (id, text): root names its component, null for an empty set."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "minhash")
    docs = docs.withColumn("row_key", F.xxhash64("text"))
    rows = scratch.write(_sketches(docs, width), "rows")
    # one row a set; equal sets have equal signatures, so any of them will do
    nodes = scratch.write(rows.where("nid is not null").groupBy("nid").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.first("n").alias("n")), "nodes")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    pairs = _candidates(scratch, nodes, percent / 100, partitions)

    def sets_of(some: DataFrame, name: str) -> DataFrame:
        """(nid, shingles) of some nodes, from the whole text of one row of each."""
        wanted = scratch.write(nodes.join(some, "nid").select("nid", F.col("rep.id").alias("wanted_id"), F.col("rep.row_key").alias("wanted_key")), f"{name}-wanted")
        keys = BlockedBloom.build(wanted.select("wanted_key").distinct(), "wanted_key")
        # most texts are in no pair: the filter keeps them out of the shuffle
        likely = docs.where(keys.may_contain(F.col("row_key")))
        texts = likely.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("row_key") == F.col("wanted_key"))).select("nid", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    values, cut = shingle_sets(batch.column("text"), width)
                    yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array([packed(values[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["nid", "shingles"])

        return scratch.write(texts.groupBy("nid").agg(F.first("text").alias("text")).mapInArrow(run, "nid binary, shingles binary"), name)

    def apart(some: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs of different components, with their roots: null where a set has no link yet."""
        root_a, root_b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        return some.join(root_a, "a", "left").join(root_b, "b", "left").where("root_a is null or root_b is null or root_a <> root_b")

    def merged(roots: DataFrame, links: DataFrame, k: int) -> DataFrame:
        """The components with more links."""
        more = scratch.write(links, f"links-{k}")
        if not more.take(1):
            return roots
        star = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        return scratch.write(components(scratch, star.union(more), f"cc{k}"), f"roots-{k}")

    def confirmed(some: DataFrame, k: int) -> DataFrame:
        return _confirm(scratch.write(some.select("a", "b"), f"open-{k}"), sets, percent, partitions)

    def best(some: DataFrame, *between: str) -> DataFrame:
        return some.groupBy(*between).agg(F.max(F.struct("agree", "a", "b")).alias("x")).select("x.a", "x.b").distinct()

    # regions that a walk can have ended early in: what is among their sets is left to the exact join
    regions = _regions(nodes)
    crowded = scratch.write(regions.groupBy("grp").count().where(F.col("count") > SURE + 1).select("grp"), "regions")
    dense = scratch.write(regions.join(crowded, "grp", "left_semi").select("nid").distinct(), "dense")
    wanted = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).union(dense).distinct()
    sets = sets_of(wanted, "sets")
    in_a, in_b = (dense.select(F.col("nid").alias(x), F.lit(True).alias(f"dense_{x}")) for x in "ab")
    alone = pairs.where("not crowded").join(in_a, "a", "left").join(in_b, "b", "left")
    alone = alone.select("a", "b", "agree", "crowded", F.coalesce(F.col("dense_a") & F.col("dense_b"), F.lit(False)).alias("dense"))
    pairs = scratch.write(alone.union(pairs.where("crowded").withColumn("dense", F.lit(True))), "pairs-marked")

    first = scratch.write(best(pairs.withColumn("at", F.col("a")).union(pairs.withColumn("at", F.col("b"))), "at"), "first")
    links = scratch.write(_confirm(first, sets, percent, partitions), "links-0")
    roots = scratch.write(components(scratch, links, "cc0"), "roots-0")
    tried = apart(pairs, roots).where("not dense or (root_a is not null and root_b is not null)").join(first, ["a", "b"], "left_anti")
    second = scratch.write(best(tried.withColumn("low", F.least(F.coalesce("root_a", "a"), F.coalesce("root_b", "b"))).withColumn("high", F.greatest(F.coalesce("root_a", "a"), F.coalesce("root_b", "b"))), "low", "high"), "second")
    roots = merged(roots, confirmed(second, 1), 1)
    tried = apart(pairs.where("not dense"), roots).select("a", "b")
    roots = merged(roots, confirmed(tried.join(first.union(second), ["a", "b"], "left_anti"), 2), 2)

    # dense sets with a neighbour in another component, in a region or in a pair not looked at
    tagged = scratch.write(dense.join(nodes.select("nid", "sig", "sketch", "n"), "nid").join(roots.withColumnRenamed("node", "nid"), "nid", "left"), "tagged")
    named = F.coalesce("root", "nid")
    regions = _regions(tagged.withColumn("root", named))
    mixed = scratch.write(regions.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where((F.col("low") < F.col("high")) & (F.col("size") > SURE + 1)).select("grp"), "regions-mixed")
    # a crowded region is among those, and a crowded pair that is apart makes it mixed
    skipped = apart(pairs.where("dense and not crowded"), roots).select("a", "b").join(first.union(second), ["a", "b"], "left_anti")
    some = regions.join(mixed, "grp", "left_semi").select("nid").union(skipped.select("a")).union(skipped.select("b")).distinct()
    some = scratch.write(sets.join(some, "nid", "left_semi").join(tagged.drop("sig"), "nid"), "sets-mixed")
    if some.take(1):
        rows_of = scratch.write(_rarest(some.withColumn("root", _root_number("root")), percent), "rarest")
        met = scratch.write(_open_rows(_by_cell(_dealt(scratch, rows_of, "groups-apart"), partitions), percent), "met")
        scratch.drop("rarest", "groups-apart")
        # the best candidates first: where they link two components, the others need no look
        near = _across(_by_cell(met, partitions), percent).distinct()
        roots = merged(roots, confirmed(near.join(first.union(second), ["a", "b"], "left_anti"), 3), 3)
        # what is still apart meets once more, with its sets
        now = roots.select(F.col("node").alias("nid"), F.col("root").alias("now"))
        moved = met.drop("root").join(now, "nid", "left").withColumn("root", _root_number("now")).select(met.columns)
        left = scratch.write(_open_rows(_by_cell(moved, partitions), percent), "apart")
        if left.take(1):
            roots = merged(roots, _links_in_cells(_by_cell(left.join(some.select("nid", "shingles"), "nid"), partitions), percent), 4)

    named = nodes.select("nid", F.col("rep.id").alias("id")).join(roots.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    named = scratch.write(named, "named")
    # written, so that the join shuffles both sides and Spark can split a component that holds most rows
    least = scratch.write(named.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    groups = scratch.write(named.join(least, "root").select("nid", "root", "component_id"), "groups")
    return rows.join(groups, "nid", "left").select("id", "row_key", "n", "nid", "root", F.when(F.col("nid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicate texts.

    Words are runs of characters other than blanks and \\t..\\r, with A-Z in
    lower case. A text's set holds its distinct shingles of `width` words, or
    its whole word sequence if that is shorter; a text without words has an
    empty set and is linked with nothing. Texts are linked when 100 *
    intersection >= percent * union of their full sets.

    Returns for each row of docs: id, n_shingles, component_id (smallest id
    that the row reaches by links, itself included), kept (the id is its own
    component's) and row_key (hash of the text, for joining back). A row with a
    null id takes part in links; it is kept only if no row of its component has
    an id. Repeated rows share a component. An empty table gives no rows.
    """
    out = _named(docs.select(docs[id_col].alias("id"), docs[column].cast("string").alias("text")), width, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "row_key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, all columns as they were.

    Of each group one row with the smallest id stays, null ids last; of several
    such rows one with the least text hash, and of rows equal in id and text any
    one. Texts without words are in no group and all stay.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash-drop")
    rows = scratch.write(_named(docs.select(docs[id_col].alias("id"), docs[column].cast("string").alias("text")), width, percent).where("nid is not null").groupBy("root", "id", "row_key").agg(F.count("*").alias("copies")), "rows")
    best = scratch.write(rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("best")), "best")
    marked = rows.join(best, "root").withColumn("stays", F.col("id").eqNullSafe(F.col("best.id")) & (F.col("row_key") == F.col("best.row_key")))
    marked = scratch.write(marked.select("id", "row_key", "stays", "copies"), "marked")
    left = unmatched(docs, marked.where("not stays"), id_col, column)
    several = marked.where("stays and copies > 1")
    if not several.take(1):
        return left
    return unmatched(left, several, id_col, column).unionByName(unmatched(left, several, id_col, column, "left_semi").dropDuplicates([id_col, column]))
