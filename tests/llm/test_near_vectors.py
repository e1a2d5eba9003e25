import numpy as np
import pytest

from cumulo.llm import near_vectors


def brute(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector) rows, by all pairs."""
    fine = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], np.float64) for i in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            todo += [n for n in links[todo.pop()] - seen if not seen.add(n)]
        least = None if i is None else min(rows[n][0] for n in seen)
        out.append((i, len(links[a]), least, None if i is None else i == least))
    return sorted(out, key=str)


def linked(spark, rows, kind="float", cosine=0.95):
    table = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, node string, copies int")
    return sorted((tuple(r) for r in near_vectors.link(table, cosine).collect()), key=str)


def around(rng, dim, groups, each, noise):
    centres = rng.normal(size=(groups, dim))
    return [[float(np.float32(x)) for x in centres[g] + noise * rng.normal(size=dim)] for g in range(groups) for _ in range(each)]


@pytest.mark.parametrize("dim", [1, 2, 3, 8, 12, 64])
def test_equals_all_pairs(spark, dim):
    rng = np.random.default_rng(dim)
    rows = list(enumerate(around(rng, dim, 12, 6, 0.23) + around(rng, dim, 40, 1, 0.0)))
    assert linked(spark, rows) == brute(rows)


def test_cells_tiles_and_squares_of_any_size(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = list(enumerate(around(rng, 16, 3, 30, 0.24) + around(rng, 16, 1, 60, 0.02)))
    whole = brute(rows)
    monkeypatch.setattr(near_vectors, "TILE", 20)
    monkeypatch.setattr(near_vectors, "SQUARE", 7)
    # Tasks' Python has the module's own sizes; the cells of one group are compared here.
    blocks_axes = (1, 2, 3)
    x = np.array([v for _, v in rows])
    for axes in blocks_axes:
        links, tree = np.zeros(len(x)), {i: i for i in range(len(x))}
        blocks = near_vectors.Blocks(16, 0.95, axes)
        cells = {}
        for at, keys, visits in blocks.cells(near_vectors.rotated(x)):
            for i, k, v in zip(at.tolist(), keys.tolist(), visits.tolist(), strict=True):
                cells.setdefault(k, []).append((i, v))
        for key, held in cells.items():
            own, visits = np.array(held).T
            group = near_vectors.Group(x[own], visits, np.ones(len(own)), key, 0.95, axes)
            group.run(np.zeros(len(own), np.int64), 0, 0)
            links[own] += group.links
            for one, other in enumerate(group.tree.tolist()):
                a, b = tree[int(own[one])], tree[int(own[other])]
                tree = {i: min(a, b) if t in (a, b) else t for i, t in tree.items()}
        assert sorted(((i, int(n), tree[i], tree[i] == i) for i, n in enumerate(links)), key=str) == whole
    assert linked(spark, rows) == whole


def test_axes_only_where_they_pay(spark):
    """Vectors that point in all directions alike are copied once a block; those that differ along a few rotated components have a grid."""
    rng = np.random.default_rng(13)
    alike = rng.normal(size=(2000, 64))
    block, axes = near_vectors.plan([alike], 51_282, 8192, 0.95)
    assert sum(len(at) for at, _, _ in near_vectors.Blocks(64, 0.95, axes, block).cells(near_vectors.rotated(alike))) <= 2 * len(alike)
    # Of few dimensions a block is the whole vector, and cells are far smaller than the sphere.
    assert near_vectors.plan([rng.normal(size=(2000, 3))], 1_000_000, 8192, 0.9999)[1] > 0
    rows = list(enumerate(around(rng, 64, 40, 3, 0.2) + around(rng, 5, 30, 3, 0.1)))
    assert linked(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [8, 16, 32, 64])
def test_blocks_of_any_size(block):
    rng = np.random.default_rng(block)
    x = np.array(around(rng, 64, 20, 6, 0.22))
    near = {(a, b) for a in range(len(x)) for b in range(a) if x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.95}
    for axes in (0, 1, 3):
        links = np.zeros(len(x))
        cells = {}
        for at, keys, visits in near_vectors.Blocks(64, 0.95, axes, block).cells(near_vectors.rotated(x)):
            for i, k, v in zip(at.tolist(), keys.tolist(), visits.tolist(), strict=True):
                cells.setdefault(k, []).append((i, v))
        for key, held in cells.items():
            own, visits = np.array(held).T
            group = near_vectors.Group(x[own], visits, np.ones(len(own)), key, 0.95, axes, block)
            group.run(np.zeros(len(own), np.int64), 0, 0)
            links[own] += group.links
        assert links.tolist() == [sum(i in pair for pair in near) for i in range(len(x))] and near


def test_pairs_of_tiles_count_each_pair_once():
    rng = np.random.default_rng(9)
    x = np.array(around(rng, 8, 1, 90, 0.2))
    tile = rng.integers(0, 3, 90)
    key, total = 0, np.zeros(90)
    for i in range(3):
        for j in range(i, 3):
            own = np.flatnonzero((tile == i) | (tile == j)) if i != j else np.flatnonzero(tile == i)
            group = near_vectors.Group(x[own], np.zeros(len(own), np.int64), np.ones(len(own)), key, 0.95, 1)
            group.run(tile[own], i, j)
            total[own] += group.links
    whole = near_vectors.Group(x, np.zeros(90, np.int64), np.ones(90), key, 0.95, 1)
    whole.run(np.zeros(90, np.int64), 0, 0)
    assert (total == whole.links).all() and total.sum() > 0


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [2.0, 0.0]), (4, [-1.0, 0.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [None, 1.0]), (9, [float("nan"), 1.0]),
        (10, [float("inf"), 1.0]), (None, [1.0, 0.0]), (None, None), (11, [1.0, 0.0, 0.0]), (12, [3e38, 1e36]), (13, [1e-38, 0.0]), (0, [1.0, 0.33]), (14, [0.9, 0.6]),
    ]
    assert linked(spark, rows) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert linked(spark, []) == []
    huge = [(1, [1e300, 1e-300]), (2, [1e-300, 0.0]), (3, [5e-324, 0.0])]
    assert [r[1] for r in linked(spark, huge, "double")] == [2, 2, 2]


def test_bounds_are_met(spark):
    rows = [(1, [4.0, 3.0]), (2, [1.0, 0.0]), (3, [3.0, 4.0])]  # cosines 0.8, 0.96, 0.6
    assert linked(spark, rows, "double", 0.8) == brute(rows, 0.8)
    assert [r[1] for r in linked(spark, rows, "double", 0.8)] == [2, 1, 1]


def test_many_copies(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [0.5] * 16) for i in range(300)] + [(300 + i, v) for i, v in enumerate(around(rng, 16, 1, 40, 0.05) + around(rng, 16, 20, 1, 0.0))]
    assert linked(spark, rows) == brute(rows)
