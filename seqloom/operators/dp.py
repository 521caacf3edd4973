"""Affine-gap alignment of base codes (0 to 3, 4: ambiguous), a row of cells at a time in NumPy.

A horizontal gap depends on cells to its left in the same row. Opened at column k and extended to j it costs
o + (j - k) * e, so the best one at every j is a running maximum of (value at k) + k * e: a whole row
is a few vector operations.
"""

from __future__ import annotations

import numpy as np

from ..options import Options

LOW = -(1 << 29)
_CODE = np.full(256, 4, dtype=np.int8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[[_b, _b + 32]] = _i


def codes(seq: str) -> np.ndarray:
    return _CODE[np.frombuffer(seq.encode("ascii", "replace"), dtype=np.uint8)]


def scores(o: Options) -> np.ndarray:
    out = np.full((5, 5), -o.mismatch, dtype=np.int32)
    np.fill_diagonal(out, o.match)
    out[4, :] = out[:, 4] = -1
    return out


def extend(query: np.ndarray, target: np.ndarray, h0: int, band: int, o: Options, end_bonus: int) -> tuple[int, int, int, int, int, int]:
    """Extension from a seed of score ``h0``: (score, query end, target end, target end at the query's end, score there, offset).

    Cells that fall to 0 are dead. A row whose best falls more than ``zdrop`` (gap costs aside) below the best ends it.
    """
    n = len(query)
    if not n or not len(target):
        return h0, 0, 0, 0, -1, 0
    most = n * o.match + end_bonus
    band = min(band, max(1, int((most - o.o_ins) / o.e_ins + 1)), max(1, int((most - o.o_del) / o.e_del + 1)))
    profile = scores(o)[:, query]
    column = np.arange(n + 1)
    above = np.maximum(h0 - o.o_ins - o.e_ins * column, 0)
    above[0] = h0
    down = np.zeros(n, dtype=np.int64)
    best, best_q, best_t, end_score, end_t, offset = h0, -1, -1, -1, -1, 0
    for i in range(len(target)):
        lo, hi = max(0, i - band), min(n, i + band + 1)
        if lo >= n:
            break
        left = max(0, h0 - o.o_del - o.e_del * (i + 1)) if lo == 0 else 0
        diagonal = above[lo:hi]
        m = np.where(diagonal > 0, diagonal + profile[target[i], lo:hi], 0)
        open_right = np.maximum(m - o.o_ins - o.e_ins, 0) + o.e_ins * column[lo + 1 : hi + 1]
        right = np.zeros(hi - lo, dtype=np.int64)
        right[1:] = np.maximum(np.maximum.accumulate(open_right)[:-1] - o.e_ins * column[lo + 1 : hi], 0)
        h = np.maximum(np.maximum(m, down[lo:hi]), right)
        down[lo:hi] = np.maximum(np.maximum(down[lo:hi] - o.e_del, m - o.o_del - o.e_del), 0)
        above = np.zeros(n + 1, dtype=np.int64)
        above[lo] = left
        above[lo + 1 : hi + 1] = h
        if hi < n:
            down[hi:] = 0
        if hi == n and h[-1] >= end_score:
            end_score, end_t = int(h[-1]), i
        row = int(h.max())
        if row == 0:
            break
        at = lo + len(h) - 1 - int(np.argmax(h[::-1]))
        if row > best:
            best, best_q, best_t = row, at, i
            offset = max(offset, abs(at - i))
        elif o.zdrop > 0:
            lag_t, lag_q = i - best_t, at - best_q
            gap = (lag_t - lag_q) * o.e_del if lag_t > lag_q else (lag_q - lag_t) * o.e_ins
            if best - row - gap > o.zdrop:
                break
    return best, best_q + 1, best_t + 1, end_t + 1, end_score, offset


def align(query: np.ndarray, target: np.ndarray, band: int, o: Options) -> tuple[int, list[tuple[int, str]]]:
    """Global alignment in a band: score and CIGAR. Of equal choices a match comes before a deletion before an insertion."""
    n, t = len(query), len(target)
    profile = scores(o)[:, query] if n else np.zeros((5, 0), dtype=np.int32)
    column = np.arange(n + 1)
    above = np.where(column <= band, -(o.o_ins + o.e_ins * column), LOW)
    above[0] = 0
    down = np.full(n, LOW, dtype=np.int64)
    taken = np.zeros((t, n), dtype=np.int8)  # bits 0-1: which of match, deletion, insertion; 2: deletion goes on; 3: insertion does
    for i in range(t):
        lo, hi = max(0, i - band), min(n, i + band + 1)
        left = -(o.o_del + o.e_del * (i + 1)) if lo == 0 else LOW
        if lo >= hi:
            above = np.full(n + 1, LOW, dtype=np.int64)
            above[0] = left
            continue
        m = above[lo:hi] + profile[target[i], lo:hi]
        begun = m - o.o_ins - o.e_ins + o.e_ins * column[lo + 1 : hi + 1]
        right = np.full(hi - lo, LOW, dtype=np.int64)
        right[1:] = np.maximum(np.maximum.accumulate(begun)[:-1] - o.e_ins * column[lo + 1 : hi], LOW)
        d = down[lo:hi]
        h, which = np.where(m >= d, m, d), np.where(m >= d, 0, 1)
        which = np.where(h >= right, which, 2)
        h = np.maximum(h, right)
        open_down = m - o.o_del - o.e_del
        goes_on = d - o.e_del > open_down
        down[lo:hi] = np.maximum(d - o.e_del, open_down)
        onward = right - o.e_ins > m - o.o_ins - o.e_ins
        taken[i, lo:hi] = which | goes_on << 2 | onward << 3
        above = np.full(n + 1, LOW, dtype=np.int64)
        above[lo] = left
        above[lo + 1 : hi + 1] = h
        if hi < n:
            down[hi:] = LOW
    ops: list[str] = []
    i, j, state = t - 1, n - 1, None
    while i >= 0 and j >= 0:
        cell = int(taken[i, j])
        if state is None:
            state = cell & 3
        if state == 0:
            ops.append("M")
            i, j, state = i - 1, j - 1, None
        elif state == 1:
            ops.append("D")
            i -= 1
            state = 1 if i >= 0 and taken[i, j] & 4 else (0 if i >= 0 else None)
        else:
            ops.append("I")
            j -= 1
            state = 2 if j >= 0 and taken[i, j] & 8 else (0 if j >= 0 else None)
    ops += ["D"] * (i + 1) + ["I"] * (j + 1)
    cigar: list[tuple[int, str]] = []
    for op in reversed(ops):
        cigar[-1:] = [(cigar[-1][0] + 1, op)] if cigar and cigar[-1][1] == op else [*cigar[-1:], (1, op)]
    return int(above[n]), cigar


def local(query: np.ndarray, target: np.ndarray, o: Options, min_score: int = 0) -> tuple[int, int, int, int, int, int]:
    """Best local alignment: (score, query start, query end, target start, target end, second best score elsewhere)."""

    def forward(q: np.ndarray, t: np.ndarray) -> tuple[int, int, int, np.ndarray]:
        profile = scores(o)[:, q]
        column = np.arange(len(q) + 1)
        above, down = np.zeros(len(q) + 1, dtype=np.int64), np.zeros(len(q), dtype=np.int64)
        rows, best, at_q, at_t = np.zeros(len(t), dtype=np.int64), 0, -1, -1
        for i in range(len(t)):
            m = np.maximum(above[:-1] + profile[t[i]], 0)
            begun = np.maximum(m - o.o_ins - o.e_ins, 0) + o.e_ins * column[1:]
            right = np.zeros(len(q), dtype=np.int64)
            right[1:] = np.maximum(np.maximum.accumulate(begun)[:-1] - o.e_ins * column[1:-1], 0)
            h = np.maximum(np.maximum(m, down), right)
            down = np.maximum(np.maximum(down - o.e_del, m - o.o_del - o.e_del), 0)
            above[1:] = h
            rows[i] = h.max()
            if rows[i] > best:
                best, at_q, at_t = int(rows[i]), int(np.argmax(h)), i
        return best, at_q, at_t, rows

    if not len(query) or not len(target):
        return 0, 0, 0, 0, 0, 0
    best, q_end, t_end, rows = forward(query, target)
    if best <= 0 or best < min_score:
        return best, 0, 0, 0, 0, 0
    _, q_back, t_back, _ = forward(query[q_end::-1], target[t_end::-1])
    reach = (best + o.match - 1) // o.match
    other = np.concatenate([rows[: max(0, t_end - reach)], rows[t_end + reach + 1 :]])
    return best, q_end - q_back, q_end + 1, t_end - t_back, t_end + 1, int(other.max()) if len(other) else 0


def infer_band(l1: int, l2: int, score: int, match: int, o: int, e: int) -> int:
    """The band that an alignment of this score can need."""
    if l1 == l2 and l1 * match - score < 2 * (o + e - match):
        return 0
    return max(int((min(l1, l2) * match - score - o) / e + 2), abs(l1 - l2))


def cigar_of(query: np.ndarray, target: np.ndarray, band: int, reverse: bool, o: Options) -> tuple[int, list[tuple[int, str]], int, str]:
    """Score, CIGAR, edit distance and MD of a whole query against a whole target.

    For a hit on the reverse strand both are turned round first, so gaps lie leftmost on the forward strand.
    """
    if reverse:
        query, target = query[::-1], target[::-1]
    most = max(1, *(int((((len(query) + 1) >> 1) * o.match - a) / e + 1) for a, e in ((o.o_ins, o.e_ins), (o.o_del, o.e_del))))
    apart = abs(len(target) - len(query))
    width = max(min((most + apart + 1) >> 1, band), apart + 3)
    score, cigar = align(query, target, width, o)
    letters = "TGCAN" if reverse else "ACGTN"
    x = y = run = edits = 0
    md: list[str] = []
    for k, (n, op) in enumerate(cigar):
        if op == "M":
            for a, b in zip(query[x : x + n], target[y : y + n], strict=True):
                if a != b:
                    md.append(f"{run}{letters[b]}")
                    run, edits = 0, edits + 1
                else:
                    run += 1
            x, y = x + n, y + n
        elif op == "D":
            if 0 < k < len(cigar) - 1:
                md.append(f"{run}^" + "".join(letters[b] for b in target[y : y + n]))
                run, edits = 0, edits + n
            y += n
        else:
            x, edits = x + n, edits + n
    return score, cigar, edits, "".join(md) + str(run)
