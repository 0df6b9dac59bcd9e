"""One pair at a time: what the batched kernels are compared with."""

import numpy as np

NEVER = -(1 << 28)


def extend(q: np.ndarray, t: np.ndarray, mat: np.ndarray, gaps: tuple[int, int, int, int], band: int, end_bonus: int, z_drop: int, h0: int) -> tuple[int, int, int, int, int, int]:
    """(score, qle, tle, gtle, gscore, max_off) of extending a seed of score h0 through both sequences.

    Gaps open from the diagonal score only, and a diagonal score of 0 can't
    start again. The band shrinks to what the best possible score can pay for
    (end_bonus counts there alone). z_drop ends the extension when the score
    falls that far below the best, less the gap between them. Ties: last query
    index in a row, first row overall, last row for the end-to-end score.
    """
    if h0 <= 0:
        raise ValueError("the seed's score must be positive")
    od, ed, oi, ei = gaps
    n, best_match = len(q), int(mat.max())
    for o, e in ((oi, ei), (od, ed)):
        band = min(band, max(int((n * best_match + end_bonus - o) / e + 1.0), 1))
    # h[j]: score left of query position j in the row above; e[j]: gap in the query that reaches position j
    col = np.arange(n + 1)
    h = np.where(col == 0, h0, np.maximum(h0 - oi - ei * col, 0)).astype(np.int64)
    e = np.zeros(n + 1, np.int64)
    best, at_i, at_j, end_row, end_score, off = h0, -1, -1, -1, -1, 0
    lo, hi = 0, n
    for i, base in enumerate(t):
        lo, hi = max(lo, i - band), min(hi, i + band + 1, n)
        first = max(h0 - od - ed * (i + 1), 0) if lo == 0 else 0
        if lo < hi:
            span = col[lo:hi]
            diag = np.where(h[lo:hi] > 0, h[lo:hi] + mat[base, q[lo:hi]], 0)
            f = np.zeros(len(span), np.int64)
            # an opening gap pays its first base too: openings under 0 count as 0
            open_f = np.maximum(diag - oi - ei, 0)
            f[1:] = np.maximum.accumulate(open_f + ei * (span + 1))[:-1] - ei * span[1:]
            row = np.maximum(np.maximum(diag, e[lo:hi]), f)
            e[lo:hi] = np.maximum(e[lo:hi] - ed, np.maximum(diag - od - ed, 0))
            h[lo], h[lo + 1 : hi + 1] = first, row
            top = int(row.max())
            j = int(lo + len(row) - 1 - row[::-1].argmax())
            last = int(row[-1])
        else:
            top, j, last = 0, -1, first
            h[hi] = first
        e[hi] = 0
        if max(lo, hi) == n and last >= end_score:
            end_row, end_score = i, last
        if top == 0:
            break
        if top > best:
            best, at_i, at_j = top, i, j
            off = max(off, abs(j - i))
        elif z_drop > 0:
            gap = (i - at_i) - (j - at_j)
            if best - top - (gap * ed if gap > 0 else -gap * ei) > z_drop:
                break
        alive = np.flatnonzero((h[lo : hi + 1] != 0) | (e[lo : hi + 1] != 0)) + lo
        inner = alive[alive < hi]
        lo = int(inner[0]) if len(inner) else hi
        alive = alive[alive >= lo]
        hi = min((int(alive[-1]) if len(alive) else lo - 1) + 2, n)
    return best, at_j + 1, at_i + 1, end_row + 1, end_score, off


def global_affine(q: np.ndarray, t: np.ndarray, mat: np.ndarray, gaps: tuple[int, int, int, int], band: int, cigar: bool = True) -> tuple[int, list[tuple[str, int]]]:
    """Score and CIGAR runs of the banded end-to-end alignment.

    Gaps open from the diagonal score only, so an insertion never touches a
    deletion. Of equal scores, diagonal comes before deletion, deletion before
    insertion, and opening a gap before extending one.
    """
    od, ed, oi, ei = gaps
    n, m = len(q), len(t)
    col = np.arange(n + 1)
    h = np.where(col == 0, 0, np.where(col <= band, -(oi + ei * col), NEVER)).astype(np.int64)
    e = np.full(n + 1, NEVER, np.int64)
    kinds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(m):
        lo, hi = max(i - band, 0), min(i + band + 1, n)
        first = -(od + ed * (i + 1)) if lo == 0 else NEVER
        if lo < hi:
            span = col[lo:hi]
            diag = h[lo:hi] + mat[t[i], q[lo:hi]]
            open_f = diag - oi - ei
            f = np.full(len(span), NEVER, np.int64)
            f[1:] = np.maximum.accumulate(open_f + ei * (span + 1))[:-1] - ei * span[1:]
            f[1:] = np.maximum(f[1:], NEVER - ei * (span[1:] - lo))
            best = np.maximum(diag, e[lo:hi])
            row = np.maximum(best, f)
            if cigar:
                kind = np.where(best < f, 2, np.where(diag >= e[lo:hi], 0, 1)).astype(np.int8)
                kinds.append((lo, kind, e[lo:hi] - ed > diag - od - ed, f - ei > open_f))
            e[lo:hi] = np.maximum(e[lo:hi] - ed, diag - od - ed)
            h[lo], h[lo + 1 : hi + 1] = first, row
        else:
            kinds.append((lo, np.zeros(0, np.int8), np.zeros(0, bool), np.zeros(0, bool)))
            h[hi] = first
        e[hi] = NEVER
    score = int(h[n])
    runs: list[tuple[str, int]] = []

    def add(op: str, size: int) -> None:
        if runs and runs[-1][0] == op:
            runs[-1] = (op, runs[-1][1] + size)
        else:
            runs.append((op, size))

    if cigar:
        i, j, state = m - 1, min(m - 1 + band + 1, n) - 1, 0
        while i >= 0 and j >= 0:
            lo, kind, e_on, f_on = kinds[i]
            k = j - lo
            # in a gap, the cell it came to tells whether the gap goes on
            state = int(kind[k]) if state == 0 else 1 if state == 1 and e_on[k] else 2 if state == 2 and f_on[k] else 0
            add("MDI"[state], 1)
            i, j = i - (state != 2), j - (state != 1)
        if i >= 0:
            add("D", i + 1)
        if j >= 0:
            add("I", j + 1)
    return score, runs[::-1]
