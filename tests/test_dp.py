"""Alignment kernels against full-matrix dynamic programmes written cell by cell."""

import numpy as np
import pytest

from seqloom.operators import dp
from seqloom.options import Options

O = Options()
S = dp.scores(O)


def naive_global(q, t):
    low = -(10**9)
    m = np.full((len(t) + 1, len(q) + 1), low)
    d, r, h = m.copy(), m.copy(), m.copy()
    h[0, 0] = 0
    for j in range(1, len(q) + 1):
        h[0, j] = r[0, j] = -(O.o_ins + O.e_ins * j)
    for i in range(1, len(t) + 1):
        h[i, 0] = d[i, 0] = -(O.o_del + O.e_del * i)
        for j in range(1, len(q) + 1):
            m[i, j] = h[i - 1, j - 1] + S[t[i - 1], q[j - 1]]
            if i > 1:
                d[i, j] = max(m[i - 1, j] - O.o_del - O.e_del, d[i - 1, j] - O.e_del)
            if j > 1:
                r[i, j] = max(m[i, j - 1] - O.o_ins - O.e_ins, r[i, j - 1] - O.e_ins)
            h[i, j] = max(m[i, j], d[i, j], r[i, j])
    return h[-1, -1]


def naive_local(q, t):
    h = np.zeros((len(t) + 1, len(q) + 1), dtype=int)
    d, r = h.copy(), h.copy()
    for i in range(1, len(t) + 1):
        for j in range(1, len(q) + 1):
            d[i, j] = max(0, h[i - 1, j] - O.o_del - O.e_del, d[i - 1, j] - O.e_del)
            r[i, j] = max(0, h[i, j - 1] - O.o_ins - O.e_ins, r[i, j - 1] - O.e_ins)
            h[i, j] = max(0, h[i - 1, j - 1] + S[t[i - 1], q[j - 1]], d[i, j], r[i, j])
    return h.max()


def mutated(rng, q):
    t = q.copy()
    for _ in range(rng.integers(0, 4)):
        p = int(rng.integers(0, len(t) + 1))
        t = np.concatenate([t[:p], rng.integers(0, 4, rng.integers(0, 4)), t[min(len(t), p + int(rng.integers(0, 3))) :]])
    return t


@pytest.mark.parametrize("seed", range(40))
def test_global(seed):
    rng = np.random.default_rng(seed)
    q = rng.integers(0, 4, rng.integers(1, 40))
    t = mutated(rng, q)
    if not len(t):
        return
    score, cigar = dp.align(q, t, 100, O)
    assert score == naive_global(q, t)
    x = y = total = 0
    for n, op in cigar:
        if op == "M":
            total += sum(S[a, b] for a, b in zip(t[y : y + n], q[x : x + n], strict=True))
            x, y = x + n, y + n
        elif op == "D":
            total, y = total - O.o_del - O.e_del * n, y + n
        else:
            total, x = total - O.o_ins - O.e_ins * n, x + n
    assert (x, y, total) == (len(q), len(t), score)


@pytest.mark.parametrize("seed", range(20))
def test_local(seed):
    rng = np.random.default_rng(seed)
    q = rng.integers(0, 4, 30)
    t = np.concatenate([rng.integers(0, 4, 20), mutated(rng, q[5:25]), rng.integers(0, 4, 20)])
    score, qb, qe, tb, te, _ = dp.local(q, t, O)
    # A match may not follow a gap of the other kind at once in the kernel, so it can only score less.
    assert score <= naive_local(q, t)
    assert 0 <= qb < qe <= len(q) and 0 <= tb < te <= len(t)
    assert naive_local(q[qb:qe], t[tb:te]) >= score


def test_extension_of_equal_texts_reaches_both_ends():
    q = np.arange(40) % 4
    assert dp.extend(q, q, 20, 100, O, 5) == (60, 40, 40, 40, 60, 0)
    assert dp.extend(q[:0], q, 20, 100, O, 5)[:3] == (20, 0, 0)


def test_cigar_has_edit_distance_and_md():
    q = dp.codes("ACGTACGTACGTTTGA")
    t = dp.codes("ACGTACGAACGTTTGA")
    assert dp.cigar_of(q, t, 10, False, O)[1:] == ([(16, "M")], 1, "7A8")
    score, cigar, edits, md = dp.cigar_of(dp.codes("ACGTACGTCCATTTGACCA"), dp.codes("ACGTACGTCGGCATTTGACCA"), 10, False, O)
    assert edits >= 2 and sum(n for n, op in cigar if op in "MI") == 19 and sum(n for n, op in cigar if op in "MD") == 21
