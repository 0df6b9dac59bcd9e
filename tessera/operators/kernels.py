"""Alignment recurrences in NumPy, over many pairs at once.

A batch holds B pairs as padded code arrays. A loop runs over target positions;
within a row, all pairs and all query positions are computed together. The
left-to-right dependency of gaps in the query is a running maximum: with a gap
cost of o + l * e, F[j] = max over k < j of (h[k] + k * e) - o - j * e.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np

NEVER = -(1 << 28)


class Coding:
    """Letters of an alphabet as the numbers 0, 1, ..; every other character as the next one.

    With either_case a letter stands for both of its cases.
    """

    def __init__(self, letters: str, either_case: bool = True):
        if len(set(letters)) != len(letters):
            raise ValueError("a letter occurs twice in the alphabet")
        self.size = len(letters) + 1
        code = {ord(v): k for k, c in enumerate(letters) for v in ((c.lower(), c.upper()) if either_case else (c,)) if len(v) == 1}
        self.points = np.array(sorted(code), np.uint32)
        self.codes = np.array([code[p] for p in sorted(code)], np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.zeros(len(points), np.int32)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, self.codes[at], np.int32(self.size - 1))

    def checked(self, mat: np.ndarray) -> np.ndarray:
        if mat.shape != (self.size, self.size):
            raise ValueError(f"a scoring matrix of {self.size} x {self.size} is needed: a row for each letter and one for all others")
        return mat


#: the letters A, C, G and T of either case are 0 to 3, every other character 4
NUCLEOTIDES = Coding("ACGT")


def pack(seqs: Sequence[str], coding: Coding | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Padded matrix and lengths, in code points: those themselves, or through a coding."""
    n = np.array([len(s) for s in seqs], np.int64)
    points = np.frombuffer("".join(seqs).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = points.astype(np.int32) if coding is None else coding(points)
    out = np.zeros((len(seqs), int(n.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


def batches(lengths: Sequence[tuple[int, int]], cells: int = 4_000_000, kept: int | None = None) -> Iterator[np.ndarray]:
    """Indexes of pairs in groups of similar shape, a row of each group bounded in cells; with `kept`, all its rows together too."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i][0], lengths[i][1]))
    group: list[int] = []
    wide = 0
    for i in order:
        rows, wide = lengths[i][0], max(wide, lengths[i][1] + 1)
        more = len(group) + 1
        if group and (more * wide > cells // 64 or rows > 2 * lengths[group[0]][0] + 16 or kept is not None and more * wide * rows > kept):
            yield np.array(group)
            group, wide = [], lengths[i][1] + 1
        group.append(i)
    if group:
        yield np.array(group)


#: cells in a row of batches whose pairs leave as their targets end
WIDE_ROW = 250_000


def wide_batches(lengths: Sequence[tuple[int, int]]) -> Iterator[np.ndarray]:
    """Indexes of pairs in groups of similar queries, of targets of any length: for kernels that let a pair go where its target ends."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i][1], lengths[i][0]))
    group: list[int] = []
    for i in order:
        wide = lengths[i][1] + 1
        if group and ((len(group) + 1) * wide > WIDE_ROW or wide > 1.25 * lengths[group[0]][1] + 16):
            yield np.array(group)
            group = []
        group.append(i)
    if group:
        yield np.array(group)


#: scores of target characters against query characters, code points that broadcast
Score = Callable[[np.ndarray, np.ndarray], np.ndarray]


def equality(match: int, mismatch: int) -> Score:
    """match for equal characters, -mismatch for others."""
    return lambda t, q: np.where(t == q, np.int32(match), np.int32(-mismatch))


def local_linear(t: np.ndarray, tn: np.ndarray, q: np.ndarray, qn: np.ndarray, score: Score, gap: int) -> np.ndarray:
    """(target start, end, query start, end, score) of each pair's best local alignment.

    The end is the first cell in row-major order with the largest score; the
    path prefers diagonal, then up, then left. Each cell carries the origin of
    its path forward, so no matrix is kept. Score 0 gives all zeros.
    """
    b, m, n = len(tn), t.shape[1], q.shape[1]
    col = np.arange(n + 1, dtype=np.int32)
    inside = col[1:] <= qn[:, None]
    h = np.zeros((b, n + 1), np.int32)
    oi = np.zeros((b, n + 1), np.int32)
    oj = np.tile(col, (b, 1))
    best = np.zeros((b, 5), np.int64)
    gap = np.int32(gap)
    for i in range(1, m + 1):
        s = np.asarray(score(t[:, i - 1 : i], q), np.int32)
        diag = np.where(inside, h[:, :-1] + s, np.int32(NEVER))
        up = h - gap
        top = np.maximum(up, 0)
        top[:, 0] = 0
        top[:, 1:] = np.maximum(top[:, 1:], diag)
        new = np.maximum.accumulate(top + gap * col, 1) - gap * col
        zero = new == 0
        from_diag = np.zeros_like(zero)
        from_diag[:, 1:] = ~zero[:, 1:] & (new[:, 1:] == diag)
        from_up = ~zero & ~from_diag & (new == up)
        ni = np.where(zero, np.int32(i), np.where(from_up, oi, np.int32(0)))
        nj = np.where(zero, col, np.where(from_up, oj, np.int32(0)))
        ni[:, 1:] = np.where(from_diag[:, 1:], oi[:, :-1], ni[:, 1:])
        nj[:, 1:] = np.where(from_diag[:, 1:], oj[:, :-1], nj[:, 1:])
        source = np.maximum.accumulate(np.where(zero | from_diag | from_up, col, np.int32(0)), 1)  # a left step takes its origin from there
        oi, oj, h = np.take_along_axis(ni, source, 1), np.take_along_axis(nj, source, 1), new
        j = h.argmax(1)
        top_score = h[np.arange(b), j]
        better = np.flatnonzero((top_score > best[:, 4]) & (i <= tn))
        best[better] = np.stack([oi[better, j[better]], np.full(len(better), i), oj[better, j[better]], j[better], top_score[better]], 1)
    return best


def _linear_ends(t: np.ndarray, tn: np.ndarray, q: np.ndarray, qn: np.ndarray, match: int, mismatch: int, gap: int, kind: type) -> np.ndarray:
    """(target end, query end, score) as in local_linear(), without origins, in whole numbers of a narrow kind.

    Cells beyond a query's end are worth less than the cell inside that they
    come from, and so are never the best.
    """
    (b, m), n = t.shape, q.shape[1]
    wide = np.uint8 if max(t.max(initial=0), q.max(initial=0)) < 255 else np.uint32
    t = t.astype(wide)
    q = np.where(np.arange(n) < qn[:, None], q, np.iinfo(wide).max).astype(wide)
    h, new, up, same = np.zeros((b, n + 1), kind), np.zeros((b, n + 1), kind), np.zeros((b, n), kind), np.zeros((b, n), bool)
    best = np.zeros((b, 3), np.int64)
    gain, loss, cost = kind(match + mismatch), kind(mismatch), kind(gap)
    for i in range(1, m + 1):
        np.equal(t[:, i - 1 : i], q, out=same)
        row = new[:, 1:]
        np.multiply(same.view(np.int8), gain, out=row)
        row += h[:, :-1]
        row -= loss
        np.subtract(h[:, 1:], cost, out=up)
        np.maximum(row, up, out=row)
        np.maximum(row, kind(0), out=row)
        # a gap of k positions costs k times as much, so only short ones leave something: gaps of 1, 2, 4, .. positions
        step, most = 1, int(row.max(initial=0))
        while step * gap < most and step < n:
            np.subtract(row[:, :-step], kind(step * gap), out=up[:, step:])
            np.maximum(row[:, step:], up[:, step:], out=row[:, step:])
            step *= 2
        h, new = new, h
        top = h.max(1)
        better = np.flatnonzero((top > best[:, 2]) & (i <= tn))
        if len(better):
            best[better] = np.stack([np.full(len(better), i), h[better].argmax(1), top[better]], 1)
    return best


def local_linear_equal(t: np.ndarray, tn: np.ndarray, q: np.ndarray, qn: np.ndarray, match: int, mismatch: int, gap: int) -> np.ndarray:
    """local_linear() of equal and other characters: ends first, then origins in the stretch of the query that can hold the path.

    A path of m rows has at most m * match to pay its gaps with, so it spans
    at most m + m * match / gap positions of the query. In that stretch every
    cell of a best path, and of one as good, has the value it has in the whole.
    """
    most = match * t.shape[1]
    kind = next((k for k in (np.int8, np.int16) if most + mismatch + 2 * gap <= np.iinfo(k).max and match > 0 and mismatch >= 0 and gap > 0), None)
    if kind is None:
        return local_linear(t, tn, q, qn, equality(match, mismatch), gap)
    ends = _linear_ends(t, tn, q, qn, match, mismatch, gap, kind)
    out = np.zeros((len(tn), 5), np.int64)
    some = np.flatnonzero(ends[:, 2] > 0)
    if not len(some):
        return out
    te, qe, _ = ends[some].T
    near = np.flatnonzero(te > NEAR[0])
    near = near[_stays_near(t, q, some[near], te[near], qe[near], match, mismatch, gap)] if len(near) else near
    is_near = np.isin(np.arange(len(some)), near)
    rows, cols = np.where(is_near, NEAR[0], te), np.where(is_near, NEAR[1], te + te * match // gap + 1)
    for part in (near, np.flatnonzero(~is_near)):
        if len(part):
            pair, i, j = some[part], np.maximum(te[part] - rows[part], 0), np.maximum(qe[part] - cols[part], 0)
            m, n = te[part] - i, qe[part] - j
            got = local_linear(_stretch(t, pair, i, m), m, _stretch(q, pair, j, n), n, equality(match, mismatch), gap)
            got[:, :2] += i[:, None]
            got[:, 2:4] += j[:, None]
            out[pair] = got
    return out


#: rows and columns before an end in which the paths of long targets are looked for first
NEAR = (64, 80)


def _stretch(x: np.ndarray, rows: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each row the n codes from first on."""
    return x[rows[:, None], np.minimum(first[:, None] + np.arange(int(n.max())), x.shape[1] - 1)]


def _stays_near(t: np.ndarray, q: np.ndarray, pair: np.ndarray, te: np.ndarray, qe: np.ndarray, match: int, mismatch: int, gap: int) -> np.ndarray:
    """Whether no best path to an end comes from further than NEAR.

    What comes before a cell of a best path is worth less than the whole, as
    the end is the first cell of its score; so the rest of the path from that
    cell is worth something. Where no path to the end from a cell on the edge
    is, none crosses it.
    """
    m, n = NEAR
    back = np.arange(max(NEAR))
    a, b = t[pair[:, None], te[:, None] - 1 - back[:m]], q[pair[:, None], np.maximum(qe[:, None] - 1 - back[:n], 0)]
    col = np.arange(n + 1)
    beyond = col > qe[:, None]  # before the query's first character
    r = np.where(beyond, NEVER, np.tile(-gap * col, (len(pair), 1)))
    crosses = (r[:, n] > 0) & (qe > n)
    for i in range(m):
        new = np.maximum(r - gap, NEVER)
        new[:, 1:] = np.maximum(new[:, 1:], r[:, :-1] + np.where(a[:, i : i + 1] == b, match, -mismatch))
        r = np.where(beyond, NEVER, np.maximum.accumulate(new + gap * col, 1) - gap * col)
        crosses |= (r[:, n] > 0) & (qe > n)
    return ~(crosses | (r > 0).any(1))


def _affine_rows(t: np.ndarray, tn: np.ndarray, q: np.ndarray, qn: np.ndarray, mat: np.ndarray, gaps: tuple[int, int, int, int]) -> Generator[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray | None, None]:
    """(pairs, row maximum, first query index of it), row by row.

    A mask sent back says which of these pairs go on; the others leave the
    batch, as do pairs whose target has ended.
    """
    od, ed, oi, ei = (np.int32(x) for x in gaps)
    mat = mat.astype(np.int32)
    pairs, n = np.arange(len(tn)), q.shape[1]
    col = np.arange(n, dtype=np.int32)
    inside = col < qn[:, None]
    h = np.zeros((len(tn), n + 1), np.int32)
    e = np.zeros((len(tn), n), np.int32)
    going = tn > 0
    for i in range(t.shape[1]):
        going &= tn > i
        if not going.all():
            pairs, t, tn, q, inside, h, e = (x[going] for x in (pairs, t, tn, q, inside, h, e))
        if not len(pairs):
            return
        diag = h[:, :-1] + np.where(inside, mat[t[:, i : i + 1], q], np.int32(NEVER))
        new = np.maximum(np.maximum(diag, e), 0)
        run = np.maximum.accumulate(new + ei * col, 1)
        f = np.zeros_like(new)
        f[:, 1:] = run[:, :-1] - oi - ei * col[1:]
        new = np.where(inside, np.maximum(new, f), 0)
        e = np.maximum(np.maximum(e - ed, new - od - ed), 0)
        h[:, 1:] = new
        j = new.argmax(1) if n else np.zeros(len(pairs), np.int64)
        top = new[np.arange(len(pairs)), j] if n else np.zeros(len(pairs), np.int64)
        told = yield pairs, top, j
        going = np.ones(len(pairs), bool) if told is None else told


#: scores that 8 and 16 bits hold; a pair that comes near the end of one is aligned again in the next
LANES = {"int8": np.int8, "int16": np.int16, "int32": np.int32}


def _fits(lane: type, mat: np.ndarray, gaps: tuple[int, int, int, int]) -> bool:
    """Whether no cost alone exceeds a lane."""
    most = np.iinfo(lane).max
    return max(gaps[0] + gaps[1], gaps[2] + gaps[3], int(np.abs(mat).max())) < most


#: of so many cells one at most holds a score that pays for a gap, where gaps are computed cell by cell
SPARSE = 32


def _narrow_rows(t: np.ndarray, tn: np.ndarray, q: np.ndarray, qn: np.ndarray, mat: np.ndarray, gaps: tuple[int, int, int, int], lane: type) -> Generator[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray | None, None]:
    """_affine_rows() in lanes of 8 or 16 bits, while no score exceeds the lane less the best match.

    Every query's scores against each letter are looked up once. A gap leaves
    something only of a score above its cost: where few cells hold one, gaps
    are computed from those alone, else for the rows that have any, in steps
    that double, so that no number grows with the position. Pairs that end
    leave when they are a quarter of the batch.
    """
    od, ed, oi, ei = gaps
    b, n, letters = len(tn), q.shape[1], len(mat)
    pairs = np.arange(b)
    inside = (np.arange(n) < qn[:, None]).astype(lane)
    scores = np.concatenate([mat.astype(lane), np.full((letters, 1), np.iinfo(lane).min, lane)], 1)
    code, profile = np.where(inside > 0, q, letters).astype(np.intp), np.empty((b, letters, n), lane)
    for k in range(letters):
        profile[:, k] = scores[k].take(code)
    profile = profile.reshape(b * letters, n)
    h, other, e, gain = *(np.zeros((b, n + 1), lane) for _ in range(3)), np.empty((b, n), lane)
    held = np.zeros(0, np.int64)  # cells of e above 0, None where they were not kept
    going = tn > 0
    for i in range(t.shape[1]):
        going &= tn[pairs] > i
        if not going.any():
            return
        if 4 * np.count_nonzero(going) <= 3 * len(pairs):
            pairs, e, h = (x[going] for x in (pairs, e, h))
            other, gain, going, held = np.zeros_like(h), np.empty((len(pairs), n), lane), np.ones(len(pairs), bool), None
        np.take(profile, pairs * letters + t[pairs, i], axis=0, out=gain, mode="clip")
        new, flat, down = other[:, 1:], other.reshape(-1), e.reshape(-1)
        np.add(h[:, :-1], gain, out=new)
        np.maximum(new, lane(0), out=new)
        held = np.flatnonzero(down) if held is None else held
        flat[held] = np.maximum(flat[held], down[held])
        j = new.argmax(1) if n else np.zeros(len(pairs), np.int64)
        top = new[np.arange(len(pairs)), j].astype(np.int64) if n else np.zeros(len(pairs), np.int64)
        cells = np.flatnonzero(flat > min(oi + ei, od + ed))
        if SPARSE * max(len(cells), len(held)) < flat.size:
            score, col, end = flat[cells], cells % (n + 1), qn[pairs[cells // (n + 1)]]
            opened, k = [cells], 1
            while (fits := (score > oi + ei * k) & (col + k <= end)).any():
                to, left = cells[fits] + k, score[fits] - lane(oi + ei * k)
                np.maximum.at(flat, to, left)
                opened.append(to[left > od + ed])
                k += 1
            cells = np.unique(np.concatenate(opened)) if len(opened) > 1 else cells
            cells = cells[flat[cells] > od + ed]
            down[held] = np.maximum(down[held] - lane(ed), lane(0))
            fresh = cells[down[cells] == 0]
            held = held[down[held] > 0]
            down[cells] = np.maximum(down[cells], flat[cells] - lane(od + ed))
            held = np.concatenate([held, fresh])
        else:
            wide = np.flatnonzero((top > oi + ei) & going)
            if len(wide):
                row, f = new[wide], np.zeros((len(wide), n), lane)
                np.maximum(row[:, :-1] - lane(oi + ei), lane(0), out=f[:, 1:])
                step, most = 1, int(top[wide].max()) - oi - ei
                while step < n and ei * step < most:
                    f[:, step:] = np.maximum(f[:, step:], f[:, :-step] - lane(ei * step))
                    step *= 2
                new[wide] = np.maximum(row, f) * inside[pairs[wide]]
            e = np.maximum(np.maximum(e - lane(ed), other - lane(od + ed)), lane(0))
            held = None
        h, other = other, h
        if going.all():
            told = yield pairs, top, j
        else:
            told = yield pairs[going], top[going], j[going]
        if told is not None:
            going[going] = told


def _rows(lane: type, t: np.ndarray, tn: np.ndarray, q: np.ndarray, qn: np.ndarray, mat: np.ndarray, gaps: tuple[int, int, int, int]) -> Generator:
    return _affine_rows(t, tn, q, qn, mat, gaps) if lane is np.int32 else _narrow_rows(t, tn, q, qn, mat, gaps, lane)


def _reversed_prefix(x: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each row's n codes before an end in reverse; the rest is padding."""
    k = np.arange(int(n.max(initial=0)))
    at = end[:, None] - 1 - k
    return np.where(k < n[:, None], np.take_along_axis(x, np.maximum(at, 0), 1), 0).astype(x.dtype)


def _span(m: np.ndarray, score: np.ndarray, mat: np.ndarray, gaps: tuple[int, int, int, int]) -> np.ndarray:
    """The most query positions that a path of m target rows and some score can hold: what its matches are worth beyond the score pays for gaps."""
    if min(gaps) < 0 or gaps[3] <= 0:
        return np.full(len(m), np.iinfo(np.int64).max)
    return m + np.maximum(max(int(mat.max()), 0) * m - score, 0) // gaps[3]


def _best_rows(rows: Generator, b: int, stop: np.ndarray, each: Callable[[int, np.ndarray, np.ndarray], None] | None = None, ceiling: int = 1 << 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair the largest row maximum, its first row and query index, and whether it left above the ceiling; a pair that reaches its `stop` ends there."""
    score, te, qe = np.zeros(b, np.int64), np.full(b, -1), np.zeros(b, np.int64)
    above = np.zeros(b, bool)
    told, i = None, 0
    while True:
        try:
            pairs, top, j = rows.send(told)
        except StopIteration:
            return score, te, qe, above
        if each:
            each(i, pairs, top)
        up = top > score[pairs]
        score[pairs[up]], te[pairs[up]], qe[pairs[up]] = top[up], i, j[up]
        ended = up & (top >= stop[pairs])
        above[pairs] = ~ended & (top > ceiling)
        told, i = ~(ended | above[pairs]), i + 1


def local_affine(t: np.ndarray, tn: np.ndarray, q: np.ndarray, qn: np.ndarray, mat: np.ndarray, gaps: tuple[int, int, int, int], min_score: int | None = 0, starts: bool = True, byte_mode: bool = False, stop_score: int | None = None, lanes: str = "auto") -> np.ndarray:
    """(score, te, qe, score2, te2, tb, qb) of each pair; what is unset is -1.

    te is the first target row with the largest score, qe the first query
    index of it. With min_score, the second-best score is that of the best row
    maximum of at least min_score outside te +- ceil(score / best match); rows
    next to each other merge into the better one. Starts come from aligning
    the reversed prefixes, and stay unset under min_score. A pair ends at the
    first row with a new best score of stop_score or more: what follows isn't
    seen. In byte mode scores saturate at 255.

    lanes: the width that scores are computed in, "int8", "int16" or "int32";
    pairs whose score outgrows it are aligned again in the next. "auto" starts
    with the narrowest that holds every cost, and gives the same results.
    """
    if lanes != "auto" and lanes not in LANES:
        raise ValueError(f"lanes must be auto or one of {', '.join(LANES)}")
    names = list(LANES)[0 if lanes == "auto" else list(LANES).index(lanes) :]
    out, left = np.zeros((len(tn), 7), np.int64), np.arange(len(tn))
    for lane in (LANES[n] for n in names):
        if not len(left) or lane is not np.int32 and not _fits(lane, mat, gaps):
            continue
        got, above = _local_affine(lane, t[left], tn[left], q[left], qn[left], mat, gaps, min_score, starts, byte_mode, stop_score)
        out[left[~above]] = got[~above]
        left = left[above]
    return out


def _local_affine(lane: type, t: np.ndarray, tn: np.ndarray, q: np.ndarray, qn: np.ndarray, mat: np.ndarray, gaps: tuple[int, int, int, int], min_score: int | None, starts: bool, byte_mode: bool, stop_score: int | None) -> tuple[np.ndarray, np.ndarray]:
    """local_affine() in one width, and which pairs outgrew it."""
    b, m = len(tn), t.shape[1]
    entry_score, entry_row, entries = np.full((b, m + 1), -1), np.full((b, m + 1), -2), np.zeros(b, np.int64)
    shift = -int(mat.min())

    def record(i: int, pairs: np.ndarray, top: np.ndarray) -> None:
        hit = top >= min_score
        at, top = pairs[hit], top[hit]
        last = np.maximum(entries[at] - 1, 0)
        fresh = (entries[at] == 0) | (entry_row[at, last] + 1 != i)
        new = at[fresh]
        entry_score[new, entries[new]], entry_row[new, entries[new]] = top[fresh], i
        better = ~fresh & (entry_score[at, last] < top)
        entry_score[at[better], last[better]], entry_row[at[better], last[better]] = top[better], i
        entries[new] += 1

    limit = min(255 - shift if byte_mode else 1 << 60, 1 << 60 if stop_score is None else stop_score)
    ceiling = 1 << 60 if lane is np.int32 else int(np.iinfo(lane).max) - max(int(mat.max()), 0)
    score, te, qe, above = _best_rows(_rows(lane, t, tn, q, qn, mat, gaps), b, np.full(b, limit), record if min_score is not None else None, ceiling)
    full = (score + shift >= 255) & byte_mode
    score, qe = np.where(full, 255, score), np.where(full, -1, qe)
    score2, te2 = np.full(b, -1), np.full(b, -1)
    if min_score is not None:
        at = np.arange(b)
        reach = -(-score // int(mat.max()))
        away = (np.arange(m + 1) < entries[:, None]) & ((entry_row < (te - reach)[:, None]) | (entry_row > (te + reach)[:, None])) & ~full[:, None]
        rest = np.where(away, entry_score, -1)
        pick = rest.argmax(1)
        found = rest[at, pick] > -1
        score2[found], te2[found] = rest[at, pick][found], entry_row[at, pick][found]
    tb, qb = np.full(b, -1), np.full(b, -1)
    wanted = ~full & ~above & (True if min_score is None else score >= min_score)
    if starts and wanted.any():
        w = np.flatnonzero(wanted)
        # the way back ends where it reaches the score; up to the end no cell but it has that, so every such path starts there
        m = te[w] + 1
        cols = np.minimum(qe[w] + 1, _span(m, score[w], mat, gaps))
        back = _rows(lane, _reversed_prefix(t[w], m, m), m, _reversed_prefix(q[w], qe[w] + 1, cols), cols, mat, gaps)
        back_score, back_te, back_qe, _ = _best_rows(back, len(w), score[w])
        same = back_score == score[w]
        tb[w[same]], qb[w[same]] = (te[w] - back_te)[same], (qe[w] - back_qe)[same]
    return np.stack([score, te, qe, score2, te2, tb, qb], 1), above


#: letters of the queries of a strip; cells of the rows kept at once, and rows of those at most; pairs whose starts are looked for at once
STRIP, KEPT, KEPT_ROWS, SOME = 1 << 16, 1 << 22, 64, 1 << 13
#: rows before an end in which a path without gaps is looked for
DIAGONAL = 96


class Strip:
    """Queries side by side in one row, to be aligned with one target after another.

    Behind each query is room that no gap crosses; scores there are 0. All
    operations are on whole rows of narrow numbers.
    """

    def __init__(self, queries: Sequence[str], room: Callable[[np.ndarray], np.ndarray], coding: Coding | None = None):
        self.queries = queries
        self.n = np.array([len(s) for s in queries], np.int64)
        taken = self.n + room(self.n) + 1
        self.start = 1 + np.cumsum(taken) - taken
        self.width = 1 + int(taken.sum())
        points = np.frombuffer("".join(queries).encode("utf-32-le", "surrogatepass"), np.uint32)
        before = np.cumsum(self.n) - self.n
        self.codes = np.full(self.width, -1, np.int32)
        self.codes[np.repeat(self.start - before, self.n) + np.arange(len(points))] = points.astype(np.int32) if coding is None else coding(points)
        self.kept: dict[type, tuple[bytearray, np.ndarray]] = {}
        self.caps: dict[type, np.ndarray] = {}
        self.profiles: dict[tuple[type, int], np.ndarray] = {}

    def rows(self, kind: type) -> tuple[bytearray, np.ndarray]:
        """Rows to be written in turn, and their bytes; the last one is empty, as the row before the first."""
        if kind not in self.kept:
            n = min(max(KEPT // self.width, 2), KEPT_ROWS)
            raw = bytearray(n * self.width * np.dtype(kind).itemsize)
            self.kept[kind] = raw, np.frombuffer(raw, kind).reshape(n, self.width)
            self.caps[kind] = np.where(self.codes < 0, kind(0), np.iinfo(kind).max).astype(kind)
        self.kept[kind][1][-1] = 0
        return self.kept[kind]

    def profile(self, kind: type, letter: int, scores: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
        """The scores of a target's letter against all of the row; in the room low enough for 0."""
        if (kind, letter) not in self.profiles:
            if len(self.profiles) > 256:
                self.profiles.clear()
            self.profiles[kind, letter] = np.where(self.codes < 0, -np.iinfo(kind).max, scores(letter, self.codes)).astype(kind)
        return self.profiles[kind, letter]

    def best(self, tops: np.ndarray, rows: Iterator[np.ndarray], kind: type, places: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query the largest row maximum, its first row (-1 without any) and the first query index of it; tops takes all row maxima."""
        raw, kept = self.rows(kind)
        score, te, qe = np.zeros(len(self.n), np.int64), np.full(len(self.n), -1), np.zeros(len(self.n), np.int64)
        for i, top in enumerate(rows):
            tops[i] = top
            if not places or (i + 1) % len(kept) and i + 1 < len(tops):
                continue
            first = i - i % len(kept)
            some = tops[first : i + 1]
            most = some.max(0)
            up = np.flatnonzero(most > score)
            score[up], te[up] = most[up], first + some[:, up].argmax(0)
            row, a, n = (te[up] % len(kept)).tolist(), self.start[up].tolist(), self.n[up].tolist()
            if kind is np.int8:
                at = [raw.find(s, r * self.width + x, r * self.width + x + y) - r * self.width - x for s, r, x, y in zip(score[up].tolist(), row, a, n, strict=True)]
            else:
                at = [int(kept[r, x : x + y].argmax()) for r, x, y in zip(row, a, n, strict=True)]
            qe[up] = at
        return score if places else tops.max(0, initial=0).astype(np.int64), te, qe

    def diagonals(self, targets: np.ndarray, which: np.ndarray, query: np.ndarray, te: np.ndarray, qe: np.ndarray, score: np.ndarray, scores: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Rows of the shortest path without gaps of some score to an end, 0 where there is none of DIAGONAL rows."""
        out = np.zeros(len(te), np.int64)
        for first in range(0, len(te), SOME):
            at = slice(first, first + SOME)
            back = np.arange(min(int(min(te[at].max(), qe[at].max())) + 1, DIAGONAL))
            i, j = te[at, None] - back, qe[at, None] - back
            a = targets[which[at, None], np.maximum(i, 0)]
            each = np.where((i < 0) | (j < 0), NEVER, scores(a, self.codes[self.start[query[at], None] + np.maximum(j, 0)]))
            hit = np.cumsum(each, 1) == score[at, None]
            k = hit.argmax(1)
            out[at] = np.where(hit[np.arange(len(k)), k], k + 1, 0)
        return out


def _kind(most: int, cost: int) -> type:
    """The narrowest whole numbers for scores up to `most` and a cost."""
    return next((k for k in (np.int8, np.int16) if most + cost < np.iinfo(k).max), np.int32)


def _linear_strip(t: np.ndarray, strip: Strip, match: int, mismatch: int, gap: int, kind: type) -> Iterator[np.ndarray]:
    """Row maxima of each query, row by row."""
    _, kept = strip.rows(kind)
    h, spare, cap, zero, high = kept[-1], np.zeros(strip.width, kind), strip.caps[kind], np.zeros(strip.width, kind), 0  # an array of zeros, as the maximum with one number is slow
    for i, letter in enumerate(t.tolist()):
        new = kept[i % len(kept)]
        np.add(h[:-1], strip.profile(kind, letter, lambda c, q: np.where(q == c, match, -mismatch))[1:], out=new[1:])
        new[0] = 0
        np.maximum(new, zero, out=new)
        if high > gap:
            np.subtract(h, kind(gap), out=spare)
            np.maximum(new, spare, out=new)
        top = np.maximum.reduceat(new, strip.start)
        high = int(top.max())
        if high > gap:
            # a gap of k positions costs k times as much, so only short ones leave something: gaps of 1, 2, 4, .. positions
            step = 1
            while step * gap < high and step < strip.width:
                np.subtract(new[:-step], kind(step * gap), out=spare[step:])
                np.maximum(new[step:], spare[step:], out=new[step:])
                step *= 2
            np.minimum(new, cap, out=new)
        h = new
        yield top


def linear_block(targets: Sequence[str], queries: Sequence[str], match: int, mismatch: int, gap: int, places: bool = True) -> np.ndarray:
    """local_linear_equal() of every target with every query, target by target; without places only the score is right.

    Where the last rows to an end hold a path without gaps of the whole score,
    it is the one: every cell of it has just what is left of the score, so the
    way back goes diagonally. Other pairs are aligned again, in the stretch
    that can hold the path.
    """
    t, tn = pack(targets)
    strip = Strip(queries, lambda n: match * np.minimum(n, int(tn.max(initial=0))) // gap)
    out = np.zeros((len(tn), len(strip.n), 5), np.int64)
    for x, m in enumerate(tn.tolist()):
        kind = _kind(match * m, max(mismatch, gap))
        tops = np.zeros((m, len(strip.n)), kind)
        score, te, qe = strip.best(tops, _linear_strip(t[x, :m], strip, match, mismatch, gap, kind), kind, places)
        out[x, :, 1], out[x, :, 3], out[x, :, 4] = te + 1, qe + 1, score
    out = out.reshape(-1, 5)
    out[out[:, 4] <= 0] = 0
    if not places:
        return out
    some = np.flatnonzero(out[:, 4] > 0)
    which, query = some // len(strip.n), some % len(strip.n)
    te, qe = out[some, 1] - 1, out[some, 3] - 1
    k = strip.diagonals(t, which, query, te, qe, out[some, 4], lambda a, b: np.where(a == b, match, -mismatch))
    out[some, 0], out[some, 2] = te + 1 - k, qe + 1 - k
    rest = np.flatnonzero(k == 0)
    first = np.maximum(qe[rest] + 1 - (te[rest] + 1) * (gap + match) // gap - 1, 0)
    a = [targets[x][: y + 1] for x, y in zip(which[rest].tolist(), te[rest].tolist(), strict=True)]
    b = [queries[x][j : y + 1] for x, j, y in zip(query[rest].tolist(), first.tolist(), qe[rest].tolist(), strict=True)]
    for group in batches([(len(x), len(y)) for x, y in zip(a, b, strict=True)]):
        got = local_linear_equal(*pack([a[i] for i in group]), *pack([b[i] for i in group]), match, mismatch, gap)
        got[:, 2:4] += first[group, None]
        out[some[rest[group]]] = got
    return out


def _affine_strip(t: np.ndarray, strip: Strip, mat: np.ndarray, gaps: tuple[int, int, int, int], kind: type) -> Iterator[np.ndarray]:
    """_linear_strip() with affine gaps."""
    _, kept = strip.rows(kind)
    od, ed, oi, ei = gaps
    h, cap = kept[-1], strip.caps[kind]
    spare, less, e, zero = (np.zeros(strip.width, kind) for _ in range(4))
    held = 0  # no cell of e is above
    for i, letter in enumerate(t.tolist()):
        new = kept[i % len(kept)]
        np.add(h[:-1], strip.profile(kind, letter, lambda c, q: mat[c].take(q, mode="clip"))[1:], out=new[1:])
        new[0] = 0
        np.maximum(new, zero, out=new)
        if held > 0:
            np.maximum(new, e, out=new)
        top = np.maximum.reduceat(new, strip.start)
        high = int(top.max())
        if high > oi + ei:
            np.subtract(new[:-1], kind(oi + ei), out=spare[1:])
            spare[0] = 0
            step = 1
            while step * ei < high - oi - ei and step < strip.width:
                np.subtract(spare[:-step], kind(step * ei), out=less[step:])
                np.maximum(spare[step:], less[step:], out=spare[step:])
                step *= 2
            np.maximum(new, spare, out=new)
            np.minimum(new, cap, out=new)
        if high > od + ed or held > ed:
            if held > ed:
                np.subtract(e, kind(ed), out=e)
                np.subtract(new, kind(od + ed), out=spare)
                np.maximum(e, spare, out=e)
            else:
                np.subtract(new, kind(od + ed), out=e)
        held = max(held - ed, high - od - ed, 0)
        h = new
        yield top


def _runners_up(tops: np.ndarray, least: int, te: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """score2 and te2 of local_affine() from all row maxima, -1 where there is no row."""
    b = tops.shape[1]
    te, reach = te.astype(np.int32), reach.astype(np.int32)
    score, row = np.full(b, -1, np.int32), np.full(b, -2, np.int32)  # of the last entry
    score2, te2 = np.full(b, -1, np.int32), np.full(b, -1, np.int32)

    def leave(at: np.ndarray) -> None:
        away = at[(np.abs(row[at] - te[at]) > reach[at]) & (score[at] > score2[at])]
        score2[away], te2[away] = score[away], row[away]

    for i, top in enumerate(tops):
        hit = top >= least
        fresh = hit & (row + 1 != i)
        better = hit & ~fresh & (top > score)
        leave(np.flatnonzero(fresh & (score >= 0)))
        change = np.flatnonzero(fresh | better)
        score[change], row[change] = top[change], i
    leave(np.flatnonzero(score >= 0))
    return score2, te2


def affine_block(targets: Sequence[str], queries: Sequence[str], coding: Coding, mat: np.ndarray, gaps: tuple[int, int, int, int], min_score: int) -> np.ndarray:
    """local_affine() of every target with every query, target by target; no starts under min_score.

    Where the last rows to an end hold a path without gaps of the whole score,
    and are fewer than one with gaps needs, it is the way back. Other pairs
    are aligned again, in the stretch that can hold the path.
    """
    t, tn = pack(targets, coding)
    most, longest = int(mat.max()), int(tn.max(initial=0))
    strip = Strip(queries, lambda n: np.maximum(most * np.minimum(n, longest) - gaps[2], 0) // gaps[3], coding)
    b = len(strip.n)
    tops = np.full((longest, len(tn), b), -1, np.int32 if most * longest > 30000 else np.int16)
    score, te, qe = (np.zeros((len(tn), b), np.int64) for _ in range(3))
    for x, m in enumerate(tn.tolist()):
        kind = _kind(most * m, max(gaps[0] + 2 * gaps[1], gaps[2] + gaps[3], int(np.abs(mat).max())))
        mine = np.zeros((m, b), kind)
        score[x], te[x], qe[x] = strip.best(mine, _affine_strip(t[x, :m], strip, mat, gaps, kind), kind, True)
        tops[:m, x] = mine
    score, te, qe = score.ravel(), te.ravel(), qe.ravel()
    score2, te2 = _runners_up(tops.reshape(longest, -1), min_score, te, -(-score // most))
    tb, qb = np.full(len(score), -1), np.full(len(score), -1)
    tb[(score == 0) & (min_score <= 0)] = qb[(score == 0) & (min_score <= 0)] = 0
    some = np.flatnonzero(score >= max(min_score, 1))
    which, query = some // b, some % b
    k = strip.diagonals(t, which, query, te[some], qe[some], score[some], lambda x, y: mat[x, y])
    k[k * most >= score[some] + min(gaps[0] + gaps[1], gaps[2] + gaps[3])] = 0
    tb[some], qb[some] = te[some] + 1 - k, qe[some] + 1 - k
    rest = np.flatnonzero(k == 0)
    at = some[rest]
    first = np.maximum(qe[at] + 1 - _span(te[at] + 1, score[at], mat, gaps), 0)
    a = [targets[x][: y + 1] for x, y in zip(which[rest].tolist(), te[at].tolist(), strict=True)]
    c = [queries[x][j : y + 1] for x, j, y in zip(query[rest].tolist(), first.tolist(), qe[at].tolist(), strict=True)]
    for group in wide_batches([(len(x), len(y)) for x, y in zip(a, c, strict=True)]):
        got = local_affine(*pack([a[i] for i in group], coding), *pack([c[i] for i in group], coding), mat, gaps, None)
        tb[at[group]], qb[at[group]] = got[:, 5], np.where(got[:, 6] < 0, -1, got[:, 6] + first[group])
    return np.stack([score, te, qe, score2, te2, tb, qb], 1)


def _windows(lengths: np.ndarray, i: int) -> int:
    """How many of some pairs, longest targets first, have a row i."""
    return int(np.searchsorted(-lengths, -i))


def extend(t: np.ndarray, tn: np.ndarray, q: np.ndarray, qn: np.ndarray, mat: np.ndarray, gaps: tuple[int, int, int, int], band: int, end_bonus: int, z_drop: int, h0: int) -> np.ndarray:
    """(score, qle, tle, gtle, gscore, max_off) of extending a seed of score h0 through both sequences of each pair.

    Gaps open from the diagonal score only, and a diagonal score of 0 can't
    start again. The band shrinks to what the best possible score can pay for
    (end_bonus counts there alone). z_drop ends the extension when the score
    falls that far below the best, less the gap between them. Ties: last query
    index in a row, first row overall, last row for the end-to-end score. Pairs
    that end leave the batch.
    """
    if h0 <= 0:
        raise ValueError("the seed's score must be positive")
    od, ed, oi, ei = gaps
    mat = mat.astype(np.int64)
    b, width, best_match = len(tn), q.shape[1], int(mat.max())
    bands = np.full(b, band)
    for o, e in ((oi, ei), (od, ed)):
        bands = np.minimum(bands, np.maximum(((qn * best_match + end_bonus - o) / e + 1.0).astype(np.int64), 1))
    out = np.tile(np.array([h0, 0, 0, 0, -1, 0], np.int64), (b, 1))
    col = np.arange(width + 1)
    # h[:, j]: score left of query position j in the row above; e[:, j]: gap in the query that reaches position j
    h = np.tile(np.where(col == 0, h0, np.maximum(h0 - oi - ei * col, 0)), (b, 1))
    e = np.zeros((b, width + 1), np.int64)
    live = np.flatnonzero(tn > 0)
    h, e = h[live], e[live]
    lo, hi = np.zeros(len(live), np.int64), qn[live].astype(np.int64)
    best, at_i, at_j = np.full(len(live), h0), np.full(len(live), -1), np.full(len(live), -1)
    end_row, end_score, off = np.full(len(live), -1), np.full(len(live), -1), np.zeros(len(live), np.int64)
    i = 0
    while len(live):
        n, rows = qn[live], np.arange(len(live))
        lo, hi = np.maximum(lo, i - bands[live]), np.minimum(np.minimum(hi, i + bands[live] + 1), n)
        first = np.where(lo == 0, max(h0 - od - ed * (i + 1), 0), 0)
        # columns that any pair uses; one more, as a row's values go one to the right
        left, right = int(lo.min()), int(hi.max())
        c = col[left : right + 1]
        inside = (c[:-1] >= lo[:, None]) & (c[:-1] < hi[:, None])
        above = h[:, left:right]
        diag = np.where(inside & (above > 0), above + mat[t[live, i][:, None], q[live, left:right]], 0)
        # an opening gap pays its first base too: openings under 0 count as 0
        reach = np.maximum.accumulate(np.where(inside, np.maximum(diag - oi - ei, 0) + ei * c[1:], NEVER), 1)
        f = np.zeros_like(diag)
        f[:, 1:] = np.maximum(reach[:, :-1] - ei * c[1:-1], 0)
        f = np.where(inside & (c[:-1] > lo[:, None]), f, 0)
        row = np.where(inside, np.maximum(np.maximum(diag, e[:, left:right]), f), -1)
        e[:, left:right] = np.where(inside, np.maximum(e[:, left:right] - ed, np.maximum(diag - od - ed, 0)), e[:, left:right])
        wide = lo < hi
        shifted = h[:, left + 1 : right + 1]
        h[:, left + 1 : right + 1] = np.where(inside, row, shifted)
        h[rows, np.where(wide, lo, hi)] = first
        e[rows, hi] = 0
        if row.shape[1]:
            back = row.shape[1] - 1 - row[:, ::-1].argmax(1)
            top, j = np.where(wide, row[rows, back], 0), np.where(wide, back + left, -1)
            last = np.where(wide, row[rows, np.maximum(hi - 1 - left, 0)], first)
        else:
            top, j, last = np.zeros(len(live), np.int64), np.full(len(live), -1), first
        ends = (np.maximum(lo, hi) == n) & (last >= end_score)
        end_row, end_score = np.where(ends, i, end_row), np.where(ends, last, end_score)
        up = top > best
        gap = (i - at_i) - (j - at_j)
        dropped = (z_drop > 0) & ~up & (best - top - np.where(gap > 0, gap * ed, -gap * ei) > z_drop)
        off = np.where(up, np.maximum(off, np.abs(j - i)), off)
        best, at_i, at_j = np.where(up, top, best), np.where(up, i, at_i), np.where(up, j, at_j)
        # the next row goes from the first cell that isn't empty to two past the last
        alive = (h[:, left : right + 1] != 0) | (e[:, left : right + 1] != 0)
        alive &= (c >= lo[:, None]) & (c <= hi[:, None])
        inner = alive & (c < hi[:, None])
        lo = np.where(inner.any(1), inner.argmax(1) + left, hi)
        alive &= c >= lo[:, None]
        final = np.where(alive.any(1), right - alive[:, ::-1].argmax(1), lo - 1)
        hi = np.minimum(final + 2, n)
        i += 1
        over = (top == 0) | dropped | (tn[live] <= i)
        if over.any():
            done = live[over]
            out[done] = np.stack([best, at_j + 1, at_i + 1, end_row + 1, end_score, off], 1)[over]
            keep = ~over
            live, h, e, lo, hi = live[keep], h[keep], e[keep], lo[keep], hi[keep]
            best, at_i, at_j, end_row, end_score, off = (x[keep] for x in (best, at_i, at_j, end_row, end_score, off))
    return out


def global_affine(t: np.ndarray, tn: np.ndarray, q: np.ndarray, qn: np.ndarray, mat: np.ndarray, gaps: tuple[int, int, int, int], band: int, cigar: bool = True) -> tuple[np.ndarray, list[str] | None]:
    """Score and CIGAR of the banded end-to-end alignment of each pair.

    Gaps open from the diagonal score only, so an insertion never touches a
    deletion. Of equal scores, diagonal comes before deletion, deletion before
    insertion, and opening a gap before extending one. A pair whose end lies
    outside the band has no score above NEVER.
    """
    od, ed, oi, ei = gaps
    order = np.argsort(-tn, kind="stable")
    t, tn, q, qn = t[order], tn[order], q[order], qn[order]
    mat = mat.astype(np.int64)
    b, width = len(tn), q.shape[1]
    col = np.arange(width + 1)
    h = np.tile(np.where(col == 0, 0, np.where(col <= band, -(oi + ei * col), NEVER)), (b, 1))
    e = np.full((b, width + 1), NEVER, np.int64)
    score = h[np.arange(b), qn]
    steps: list[tuple[int, np.ndarray]] = []
    for i in range(int(tn.max(initial=0))):
        m = _windows(tn, i)  # pairs whose target has a row i come first
        lo, hi = max(i - band, 0), min(i + band + 1, int(qn[:m].max()))
        first = -(od + ed * (i + 1)) if lo == 0 else NEVER
        if lo < hi:
            c = col[lo:hi]
            inside = c < qn[:m, None]
            diag = np.where(inside, h[:m, lo:hi] + mat[t[:m, i][:, None], q[:m, lo:hi]], NEVER)
            open_f = diag - oi - ei
            f = np.full_like(diag, NEVER)
            f[:, 1:] = np.maximum(np.maximum.accumulate(open_f + ei * (c + 1), 1)[:, :-1] - ei * c[1:], NEVER - ei * (c[1:] - lo))
            above = e[:m, lo:hi]
            best = np.maximum(diag, above)
            if cigar:
                # the move in two bits, and whether a deletion or an insertion that comes here goes on
                kind = np.where(best < f, 2, np.where(diag >= above, 0, 1)) | (above - ed > diag - od - ed) << 2 | (f - ei > open_f) << 3
                steps.append((lo, kind.astype(np.uint8)))
            e[:m, lo:hi] = np.where(inside, np.maximum(above - ed, diag - od - ed), NEVER)
            h[:m, lo + 1 : hi + 1] = np.where(inside, np.maximum(best, f), h[:m, lo + 1 : hi + 1])
            h[:m, lo] = first
        elif cigar:
            steps.append((lo, np.zeros((m, 0), np.uint8)))
        short = np.flatnonzero(qn[:m] <= lo)  # no cell of the band: the end is out of reach, or the query empty
        h[short, qn[short]] = first
        ending = slice(_windows(tn, i + 1), m)
        score[ending] = h[np.arange(ending.start, m), qn[ending]]
    back = np.argsort(order, kind="stable")
    return score[back], [_runs(x) for x in _paths(steps, tn, qn, band)[back]] if cigar else None


def _paths(steps: list[tuple[int, np.ndarray]], tn: np.ndarray, qn: np.ndarray, band: int) -> np.ndarray:
    """Of each pair its moves from the end to the start (0 both, 1 the target, 2 the query), filled up with 3; all pairs walk together."""
    i, j, state = tn - 1, np.minimum(tn + band, qn) - 1, np.zeros(len(tn), np.int64)
    moves = []
    while (live := (i >= 0) | (j >= 0)).any():
        move = np.where(i < 0, 2, 1)  # at the edge only one sequence is left
        for row in np.unique(i[live & (i >= 0) & (j >= 0)]).tolist():
            lo, kind = steps[row]
            at = np.flatnonzero((i == row) & (j >= 0))
            cell = j[at] - lo
            known = (cell >= 0) & (cell < kind.shape[1])  # a path from outside the band goes up to it
            at, cell = at[known], cell[known]
            k = kind[at, cell]
            s = state[at]
            move[at] = np.where(s == 0, k & 3, np.where((s == 1) & (k & 4 > 0), 1, np.where((s == 2) & (k & 8 > 0), 2, 0)))
        state = np.where((i >= 0) & (j >= 0), move, state)
        moves.append(np.where(live, move, 3).astype(np.int8))
        i, j = i - (live & (move != 2)), j - (live & (move != 1))
    return np.stack(moves, 1) if moves else np.zeros((len(tn), 0), np.int8)


def _runs(path: np.ndarray) -> str:
    """CIGAR text of a path that was walked from its end."""
    path = path[path < 3][::-1]
    if not len(path):
        return ""
    start = np.flatnonzero(np.diff(path, prepend=-1))
    return "".join(f"{n}{'MDI'[k]}" for k, n in zip(path[start].tolist(), np.diff(np.append(start, len(path))).tolist(), strict=True))
