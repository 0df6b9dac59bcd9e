"""Sequence alignment operators over DataFrames.

All-pairs alignment is a product by definition. Queries are dealt over the
cluster, packed into blocks, and every block of queries meets every block of
targets: one target after another is aligned with all queries of a block at
once. Costs that blocks don't take are for pairs, aligned in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.sequences import score_matrix
from tessera.operators import kernels as k
from tessera.runtime import ship

LINEAR = ("t_start", "t_end", "q_start", "q_end", "score")
AFFINE = ("score", "te", "qe", "score2", "te2", "tb", "qb")
EXTEND = ("score", "qle", "tle", "gtle", "gscore", "max_off")
#: a result that a pair doesn't have; cells of all rows of a batch of end-to-end alignments, a byte each
UNSET, KEPT_CELLS = -(2**31), 64_000_000
LINEAR_TYPE = "struct<" + ", ".join(f"{c}: int" for c in LINEAR) + ">"
AFFINE_TYPE = "struct<" + ", ".join(f"{c}: int" for c in AFFINE) + ">"
GLOBAL_TYPE = "struct<score: int, cigar: string>"
EXTEND_TYPE = "struct<" + ", ".join(f"{c}: int" for c in EXTEND) + ">"


def _gaps(gap_open: int, gap_ext: int, ins_open: int | None, ins_ext: int | None) -> tuple[int, int, int, int]:
    """Costs to open and extend a deletion, then an insertion; the same unless told apart."""
    return gap_open, gap_ext, gap_open if ins_open is None else ins_open, gap_ext if ins_ext is None else ins_ext


def _in_batches(t: pd.Series, q: pd.Series, align: Callable[[list[str], list[str]], np.ndarray], width: int, empty: bool = False, kept: int | None = None, wide: bool = False) -> np.ndarray:
    """Rows of results; pairs with a null side, or an empty one unless those are aligned, stay UNSET. wide: align lets a pair go where its target ends."""
    out = np.full((len(t), width), UNSET, np.int64)
    t, q = t.tolist(), q.tolist()
    good = [i for i, (a, b) in enumerate(zip(t, q, strict=True)) if a is not None and b is not None and (empty or a and b)]
    lengths = [(len(t[i]), len(q[i])) for i in good]
    for group in k.wide_batches(lengths) if wide else k.batches(lengths, kept=kept):
        rows = [good[i] for i in group]
        out[rows] = align([t[i] for i in rows], [q[i] for i in rows])
    return out


def _costs(match: int, mismatch: int, scoring: Sequence[Sequence[int]] | None, alphabet: str | None) -> tuple[np.ndarray, k.Coding]:
    """Scoring matrix and coding. An alphabet needs a matrix with a row for each letter and a last one for all other characters."""
    coding = k.NUCLEOTIDES if alphabet is None else k.Coding(alphabet)
    if scoring is None and alphabet is not None:
        raise ValueError("an alphabet needs a scoring matrix")
    return coding.checked(np.array(score_matrix(match, mismatch) if scoring is None else scoring)), coding


def linear_udf(match: int = 1, mismatch: int = 3, gap: int = 5, score: k.Score | None = None):
    """align_linear(t, q): the best local alignment with a cost for each gap position; null positions at score 0.

    score takes arrays of target and query code points that broadcast, and
    gives whole numbers; by default match and mismatch.
    """

    def align(t: list[str], q: list[str]) -> np.ndarray:
        sides = *k.pack(t), *k.pack(q)
        return k.local_linear_equal(*sides, match, mismatch, gap) if score is None else k.local_linear(*sides, score, gap)

    @pandas_udf(LINEAR_TYPE)
    def align_linear(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        got = pd.DataFrame(_in_batches(t, q, align, 5), columns=LINEAR).astype("Int32")
        got.loc[(got["score"] <= 0).to_numpy(bool), list(LINEAR[:4])] = pd.NA
        got["score"] = got["score"].clip(lower=0)
        return got

    return align_linear


def affine_udf(match: int = 1, mismatch: int = 3, gap_open: int = 5, gap_ext: int = 2, min_score: int | None = 0, starts: bool = True, byte_mode: bool = False, ins_open: int | None = None, ins_ext: int | None = None, scoring: Sequence[Sequence[int]] | None = None, alphabet: str | None = None, stop_score: int | None = None, lanes: str = "auto"):
    """align_affine(t, q): the best local alignment with affine gaps, its runner-up and its starts."""
    mat, coding = _costs(match, mismatch, scoring, alphabet)
    gaps = _gaps(gap_open, gap_ext, ins_open, ins_ext)

    def align(t: list[str], q: list[str]) -> np.ndarray:
        return k.local_affine(*k.pack(t, coding), *k.pack(q, coding), mat, gaps, min_score, starts, byte_mode, stop_score, lanes)

    @pandas_udf(AFFINE_TYPE)
    def align_affine(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        got = pd.DataFrame(_in_batches(t, q, align, 7, wide=True), columns=AFFINE).astype("Int32")
        return got.mask(got == UNSET)

    return align_affine


def global_udf(match: int = 1, mismatch: int = 3, gap_open: int = 5, gap_ext: int = 2, band: int = 1 << 20, ins_open: int | None = None, ins_ext: int | None = None, scoring: Sequence[Sequence[int]] | None = None, cigar: bool = True, alphabet: str | None = None):
    """align_global(t, q): the banded end-to-end score and CIGAR."""
    mat, coding = _costs(match, mismatch, scoring, alphabet)
    gaps = _gaps(gap_open, gap_ext, ins_open, ins_ext)

    @pandas_udf(GLOBAL_TYPE)
    def align_global(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        texts: list[str] = []

        def align(a: list[str], b: list[str]) -> np.ndarray:
            score, runs = k.global_affine(*k.pack(a, coding), *k.pack(b, coding), mat, gaps, band, cigar)
            texts.extend(runs or [])
            return np.stack([score, np.arange(len(texts) - len(score), len(texts))], 1)

        got = _in_batches(t, q, align, 2, empty=True, kept=KEPT_CELLS)
        score = pd.DataFrame({"score": got[:, 0]}).astype("Int32")
        return score.mask(score == UNSET).assign(cigar=[texts[at] if cigar and at != UNSET else None for at in got[:, 1].tolist()])

    return align_global


def extend_udf(h0: int = 1, match: int = 1, mismatch: int = 3, gap_open: int = 5, gap_ext: int = 2, band: int = 100, end_bonus: int = 0, z_drop: int = 0, ins_open: int | None = None, ins_ext: int | None = None, scoring: Sequence[Sequence[int]] | None = None, alphabet: str | None = None):
    """align_extend(t, q): extension of a seed of score h0 along both sequences."""
    mat, coding = _costs(match, mismatch, scoring, alphabet)
    gaps = _gaps(gap_open, gap_ext, ins_open, ins_ext)

    def align(t: list[str], q: list[str]) -> np.ndarray:
        return k.extend(*k.pack(t, coding), *k.pack(q, coding), mat, gaps, band, end_bonus, z_drop, h0)

    @pandas_udf(EXTEND_TYPE)
    def align_extend(t: pd.Series, q: pd.Series) -> pd.DataFrame:
        got = pd.DataFrame(_in_batches(t, q, align, 6, empty=True), columns=EXTEND).astype("Int32")
        return got.mask(got == UNSET)

    return align_extend


def register(spark: SparkSession) -> None:
    """The SQL functions align_linear, align_affine, align_global, align_extend, hash_64 and sq_dist, with default costs."""
    ship(spark)
    for name, udf in (("align_linear", linear_udf()), ("align_affine", affine_udf()), ("align_global", global_udf()), ("align_extend", extend_udf())):
        spark.udf.register(name, udf)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sq_dist(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v)")
    from tessera.functions.hashing import STEPS

    low = "4294967295L"
    steps = [f"_add(k, {'~' if kind == 'add_not' else ''}shiftleft(k, {n}))" if kind != "xor" else f"k ^ shiftrightunsigned(k, {n})" for kind, n in STEPS]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION _add(a BIGINT, b BIGINT) RETURNS BIGINT RETURN shiftleft(shiftrightunsigned(a, 32) + shiftrightunsigned(b, 32) + shiftrightunsigned((a & {low}) + (b & {low}), 32), 32) | (((a & {low}) + (b & {low})) & {low})")
    for i, step in enumerate(steps):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION _mix{i}(k BIGINT) RETURNS BIGINT RETURN {step}")
    nested = "k"
    for i in range(len(steps)):
        nested = f"_mix{i}({nested})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hash_64(k BIGINT) RETURNS BIGINT RETURN {nested}")


def _pairs(targets: DataFrame, queries: DataFrame, name: str, seq: str, spread: bool) -> DataFrame:
    """All (t_name, t_seq, q_name, q_seq) with sequences on both sides; empty ones are skipped."""
    t = targets.select(F.col(name).alias("t_name"), F.col(seq).alias("t_seq")).where(F.length("t_seq") > 0)
    q = queries.select(F.col(name).alias("q_name"), F.col(seq).alias("q_seq")).where(F.length("q_seq") > 0)
    if spread:  # a small file is one partition; the pairs would stay in it
        q = q.repartition(max(2 * q.sparkSession.sparkContext.defaultParallelism, 8))
    return q.crossJoin(t)


def _blocks(df: DataFrame, name: str, seq: str, prefix: str) -> DataFrame:
    """(names, seqs) with a prefix, as arrays of some STRIP letters in all; empty sequences are skipped."""
    rows = df.select(F.col(name).alias("name"), F.col(seq).cast("string").alias("seq")).where(F.length("seq") > 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                letters = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy().astype(np.int64))
                cut = np.flatnonzero(np.diff((letters - 1) // k.STRIP, prepend=-1))
                edges = pa.array(np.append(cut, batch.num_rows).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edges, c) for c in batch.columns], [f"{prefix}names", f"{prefix}seqs"])

    return rows.mapInArrow(pack, T.StructType([T.StructField(f"{prefix}names", T.ArrayType(rows.schema["name"].dataType)), T.StructField(f"{prefix}seqs", T.ArrayType(T.StringType()))]))


def _over_blocks(targets: DataFrame, queries: DataFrame, name: str, seq: str, spread: bool, align: Callable[[list[str], list[str]], list[tuple[np.ndarray, list[pa.Array]]]], columns: str) -> DataFrame:
    """(t_name, q_name, columns) of what align gives of targets and queries: pairs, target by target, that it keeps, and their columns."""
    q = queries
    if spread:  # a small file is one partition; the blocks would stay in it
        q = q.repartition(max(4 * q.sparkSession.sparkContext.defaultParallelism, 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                q_names, q_seqs, t_names, t_seqs = (batch.column(c)[at].values for c in range(4))
                for kept, made in align(t_seqs.to_pylist(), q_seqs.to_pylist()):
                    names = [t_names.take(pa.array(kept // len(q_names))), q_names.take(pa.array(kept % len(q_names)))]
                    yield pa.RecordBatch.from_arrays(names + made, fields.names)

    q, t = _blocks(q, name, seq, "q_"), _blocks(targets, name, seq, "t_")
    types = [T.StructField("t_name", t.schema["t_names"].dataType.elementType), T.StructField("q_name", q.schema["q_names"].dataType.elementType)]
    fields = T.StructType(types + T._parse_datatype_string(columns).fields)
    return q.crossJoin(t).mapInArrow(run, fields)


def _int32(x: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.astype(np.int32), mask=null)


def linear_scores(targets: DataFrame, queries: DataFrame, match: int = 1, mismatch: int = 3, gap: int = 5, name: str = "name", seq: str = "seq", spread: bool = True) -> DataFrame:
    """(t_name, q_name, score) of align_local_linear(), without looking for positions."""
    if match <= 0 or mismatch < 0 or gap <= 0:
        return align_local_linear(targets, queries, match, mismatch, gap, name, seq, spread).select("t_name", "q_name", "score")
    ship(targets.sparkSession)

    def align(t: list[str], q: list[str]) -> list[tuple[np.ndarray, list[pa.Array]]]:
        got = k.linear_block(t, q, match, mismatch, gap, False)
        return [(np.arange(len(got)), [_int32(got[:, 4])])]

    return _over_blocks(targets, queries, name, seq, spread, align, "score int")


def align_local_linear(targets: DataFrame, queries: DataFrame, match: int = 1, mismatch: int = 3, gap: int = 5, name: str = "name", seq: str = "seq", spread: bool = True, score: k.Score | None = None) -> DataFrame:
    """Every target against every query: t_name, t_start, t_end, q_name, q_start, q_end, score.

    Characters are compared as they are: case matters and N matches N. Every
    pair has a row; at score 0 the positions are null. score: see linear_udf().
    """
    ship(targets.sparkSession)
    order = ("t_name", "t_start", "t_end", "q_name", "q_start", "q_end", "score")
    if score is None and match > 0 and mismatch >= 0 and gap > 0:

        def align(t: list[str], q: list[str]) -> list[tuple[np.ndarray, list[pa.Array]]]:
            got = k.linear_block(t, q, match, mismatch, gap)
            none = got[:, 4] <= 0
            return [(np.arange(len(got)), [_int32(got[:, c], none) for c in range(4)] + [_int32(got[:, 4])])]

        return _over_blocks(targets, queries, name, seq, spread, align, ", ".join(f"{c} int" for c in LINEAR)).select(*order)
    hit = _pairs(targets, queries, name, seq, spread).withColumn("hit", linear_udf(match, mismatch, gap, score)("t_seq", "q_seq"))
    return hit.select("t_name", "hit.t_start", "hit.t_end", "q_name", "hit.q_start", "hit.q_end", "hit.score")


def align_local_affine(targets: DataFrame, queries: DataFrame, match: int = 1, mismatch: int = 3, gap_open: int = 5, gap_ext: int = 2, min_score: int = 0, forward_only: bool = False, byte_mode: bool = False, name: str = "name", seq: str = "seq", spread: bool = True, ins_open: int | None = None, ins_ext: int | None = None, scoring: Sequence[Sequence[int]] | None = None, alphabet: str | None = None, complement: tuple[str, str] | None = None, stop_score: int | None = None, lanes: str = "auto") -> DataFrame:
    """Every target against every query, on both strands unless forward_only: pairs of at least min_score.

    Columns t_name, t_start, t_end, q_name, q_start, q_end, score, score2,
    t_end2, strand. Ends are exclusive; on the reverse strand query positions
    count on the forward one, so the start is the larger. What is unset is -1.

    gap_open and gap_ext cost deletions, and insertions too unless ins_open or
    ins_ext are given. Letters are nucleotides of either case, any other
    character one more; with an alphabet, such as that of proteins, its letters,
    and scoring has a row for each and a last one for all others. The reverse
    strand swaps letters by `complement` (two strings, nucleotides by default);
    an alphabet without one has the forward strand only. stop_score ends a pair
    at the first row that reaches it. lanes: the width of scores, see
    kernels.local_affine().
    """
    ship(targets.sparkSession)
    floor = min(min_score, 0xFFFF)
    pair = complement or (("ACGTacgt", "TGCAtgca") if alphabet is None else None)
    strands = ["+"] if forward_only or pair is None else ["+", "-"]
    mat, coding = _costs(match, mismatch, scoring, alphabet)
    gaps = _gaps(gap_open, gap_ext, ins_open, ins_ext)
    if min(gaps) >= 0 and gaps[1] > 0 and gaps[3] > 0 and int(mat.max()) > 0 and not byte_mode and stop_score is None and lanes == "auto":

        def both(t: list[str], q: list[str]) -> list[tuple[np.ndarray, list[pa.Array]]]:
            out = []
            for strand in strands:
                used = q if strand == "+" else [x.translate(swap)[::-1] for x in q]
                got = k.affine_block(t, used, coding, mat, gaps, floor)
                kept = np.flatnonzero(got[:, 0] >= floor)
                score, te, qe, score2, te2, tb, qb = got[kept].T
                n = np.array([len(x) for x in q])[kept % len(q)]
                start, end = (qb, qe + 1) if strand == "+" else (n - qb, n - 1 - qe)
                out.append((kept, [*map(_int32, (tb, te + 1, start, end, score, score2, te2)), pa.array([strand] * len(kept), pa.string())]))
            return out

        swap = {ord(a): (ord(pair[1][i]) if i < len(pair[1]) else None) for i, a in reversed(list(enumerate(pair[0])))} if pair else {}
        columns = "t_start int, t_end int, q_start int, q_end int, score int, score2 int, t_end2 int, strand string"
        order = ("t_name", "t_start", "t_end", "q_name", "q_start", "q_end", "score", "score2", "t_end2", "strand")
        return _over_blocks(targets, queries, name, seq, spread, both, columns).select(*order)
    pairs = _pairs(targets, queries, name, seq, spread).withColumn("strand", F.explode(F.array(*map(F.lit, strands))))
    turned = F.reverse(F.translate(F.col("q_seq"), *pair)) if pair else F.col("q_seq")
    pairs = pairs.withColumn("q_used", F.when(F.col("strand") == "+", F.col("q_seq")).otherwise(turned))
    align = affine_udf(match, mismatch, gap_open, gap_ext, floor, True, byte_mode, ins_open, ins_ext, scoring, alphabet, stop_score, lanes)
    hit = pairs.withColumn("hit", align("t_seq", "q_used")).where(F.col("hit.score") >= floor)
    n, fwd = F.length("q_seq"), F.col("strand") == "+"
    return hit.select(
        "t_name", F.col("hit.tb").alias("t_start"), (F.col("hit.te") + 1).alias("t_end"), "q_name",
        F.when(fwd, F.col("hit.qb")).otherwise(n - F.col("hit.qb")).alias("q_start"), F.when(fwd, F.col("hit.qe") + 1).otherwise(n - 1 - F.col("hit.qe")).alias("q_end"),
        "hit.score", "hit.score2", F.col("hit.te2").alias("t_end2"), "strand",
    )


def neighbour_scores(df: DataFrame, key: str, text: str = "text", match: int = 1, mismatch: int = 3) -> DataFrame:
    """(key, score, coded) of each text: the sums of plain and of coded scores of all neighbouring characters; 0 without any.

    Plain scores compare code points; coded ones are those of nucleotides of
    either case, all other characters being ambiguous.
    """
    ship(df.sparkSession)
    code = np.full(129, 4)
    for n, letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
        code[[ord(x) for x in letters]] = n
    scores = np.array(score_matrix(match, mismatch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            edge = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            left, right = chars[:-1], chars[1:]
            coded = code[np.minimum(chars, 128)]
            sums = []
            for each in (np.where(left == right, match, -mismatch), scores[coded[:-1], coded[1:]]):
                upto = np.concatenate([[0], np.cumsum(each)])  # of the pairs that begin before a character
                sums.append(np.where(edge[1:] > edge[:-1], upto[np.maximum(edge[1:] - 1, 0)] - upto[np.minimum(edge[:-1], len(upto) - 1)], 0))
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x.astype(np.int64)) for x in sums)], [key, "score", "coded"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField(key, rows.schema["key"].dataType), T.StructField("score", T.LongType()), T.StructField("coded", T.LongType())]))


def linear_score_expression(t: F.Column, q: F.Column, match: int = 1, mismatch: int = 3, gap: int = 5):
    """The local score alone, as a fold over the target in the JVM: for short sequences."""
    letters = F.split(q, "")
    letters = F.filter(letters, lambda c: c != "")
    zero = F.transform(letters, lambda c: F.lit(0))

    def row(state, base):
        cells = F.aggregate(
            F.arrays_zip(letters.alias("c"), state["row"].alias("up")),
            F.struct(F.lit(0).alias("diag"), F.lit(0).alias("left"), F.array().cast("array<int>").alias("row")),
            lambda a, x: _cell(a, x, base, match, mismatch, gap),
        )["row"]
        return F.struct(F.greatest(state["best"], F.coalesce(F.array_max(cells), F.lit(0))).alias("best"), cells.alias("row"))

    bases = F.filter(F.split(t, ""), lambda c: c != "")
    return F.aggregate(bases, F.struct(F.lit(0).alias("best"), zero.alias("row")), row, lambda s: s["best"])


def _cell(a, x, base, match: int, mismatch: int, gap: int):
    h = F.greatest(F.lit(0), a["diag"] + F.when(x["c"] == base, F.lit(match)).otherwise(F.lit(-mismatch)), x["up"] - gap, a["left"] - gap)
    return F.struct(x["up"].alias("diag"), h.alias("left"), F.concat(a["row"], F.array(h)).alias("row"))


def pair_rows(df: DataFrame) -> Iterator[tuple]:
    """Hits in the order of the sink: query by query, target by target."""
    return map(tuple, df.orderBy("q_name", "t_name").toLocalIterator())
