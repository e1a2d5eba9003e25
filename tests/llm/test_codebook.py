import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cumulo.llm import codebook


def brute(rows, rounds=codebook.ROUNDS):
    """The codes of (vec_id, vector, label) rows of one length, in Python's integers."""
    rows = [(i, [int(np.floor(np.float64(x) * 4096)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = len(rows[0][1])
    cuts = [dim * p // 8 for p in range(9)]
    ids = sorted({i for i, _, _ in rows})[:16]
    firsts = [min(v for i, v, _ in rows if i == n) for n in ids]
    books = [[v[a:b] for v in firsts] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    part = lambda v, p: v[cuts[p] : cuts[p + 1]]

    def nearest(v, p):
        return min((sum((x - y) ** 2 for x, y in zip(part(v, p), e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[nearest(v, p)[1] for p in range(8)] for _, v, _ in rows]
        for p in range(8):
            old = list(books[p])
            for n in range(len(old)):
                mine = [part(v, p) for (_, v, _), a in zip(rows, at, strict=True) if a[p] == n]
                if mine:
                    old[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
            books[p] = old
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    told = [(i, "".join(f"{nearest(v, p)[1]:02x}" for p in range(8)), sum(nearest(v, p)[0] for p in range(8)), label) for i, v, label in rows]
    return sorted((i, code, error, min(codebook.MOST, sum(e for _, _, e, other in told if other == label)), digest) for i, code, error, label in told)


def compressed(spark, rows, kind="float"):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, size int")
    return sorted((tuple(r) for r in codebook.compress(table).collect()), key=lambda r: (r[0] is None, r))


def test_equals_plain_integers(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=16)], int(i % 3) if i % 7 else None) for i in rng.permutation(120)]
    assert compressed(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 8)], 0) for i in range(40)]
    bad = [(50, None, 0), (51, [None] * 8, 0), (52, [float("nan")] * 8, 0), (53, [float("inf")] + [0.0] * 7, 0)]
    rows += [rows[3], (3, [9.0] * 8, None), (60, [0.0] * 8, None), (61, [-0.0] * 8, None)]
    assert compressed(spark, rows + bad) == brute(rows)
    assert compressed(spark, []) == [] and compressed(spark, bad) == []
    few = compressed(spark, [(None, [1.0] * 8, 1), (4, [2.0] * 8, 1)])
    assert [r[:4] for r in few if r[0] == 4] == [(4, "00" * 8, 0, 0)] and len(few) == 2
    assert compressed(spark, [(1, [], None)])[0][:4] == (1, "00" * 8, 0, 0)
    # Lengths that eight doesn't divide, and several lengths at once, have codebooks of their own.
    uneven = [(i, [float(x) for x in rng.normal(size=11)], 1) for i in range(30)]
    assert compressed(spark, uneven, "double") == brute(uneven)
    both = compressed(spark, uneven + [(100 + i, v, 2) for i, v, _ in rows], "double")
    assert [r for r in both if r[0] < 100] == brute(uneven)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-200_000, 200_000, 16)], 0) for i in range(60)]
    assert compressed(spark, rows, "double") == brute(rows)
    (row,) = compressed(spark, [(1, [1e300] * 8, 0)], "double")
    assert row[1:4] == ("00" * 8, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=16), st.integers(0, 2**32 - 1))
def test_trees_find_the_least_numbered_of_the_nearest(entries, seed):
    entries = np.array(entries, np.int64)
    parts = np.random.default_rng(seed).integers(-5, 6, (50, 2))
    best, at = np.full(50, 1 << 62), np.full(50, 16)
    codebook.Tree(entries, list(range(len(entries)))).search(parts, np.arange(50), best, at)
    d = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (at == d.argmin(axis=1)).all()


def test_trees_leave_out_sides():
    rng = np.random.default_rng(5)
    entries = np.concatenate([rng.integers(0, 10, (8, 4)), rng.integers(1000, 1010, (8, 4))])
    seen = []
    tree = codebook.Tree(entries, list(range(16)))
    plain = codebook.Tree._squared
    codebook.Tree._squared = lambda self, parts: seen.append(len(parts)) or plain(self, parts)
    try:
        tree.search(rng.integers(0, 10, (100, 4)), np.arange(100), np.full(100, 1 << 62), np.full(100, 16))
    finally:
        codebook.Tree._squared = plain
    assert sum(seen) < 100 * 12


@pytest.mark.parametrize("hot", [1, 5])
def test_a_label_that_most_rows_have(spark, hot):
    rng = np.random.default_rng(hot)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], hot if i % 10 else i) for i in range(200)]
    assert compressed(spark, rows) == brute(rows)
