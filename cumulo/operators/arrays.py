"""Exact nearest neighbours of arrays of points that one task holds: a block's points, or a few that meet.

Both sides are cut at medians into leaves of few points, so all leaves of a side are one array. Pairs of nodes go down both
trees at once while the references can be near enough, and points are compared only in the leaves that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points of a leaf, k at least.
LEAF = 8
#: Numbers in an array of distances.
CHUNK = 1 << 17


def distances(steps: list[np.ndarray], metric: str) -> np.ndarray:
    """Of the differences on each axis, added up as knn.distance2() does."""
    a, b, c = (np.abs(s) if metric == "l1" else s * s for s in steps)
    return a + b + c


def least(low: np.ndarray, high: np.ndarray, to_low: np.ndarray, to_high: np.ndarray, metric: str) -> np.ndarray:
    """From boxes to boxes (... x 3), never more than the distance of two points in them."""
    return distances([np.maximum(0.0, np.maximum(to_low[..., i] - high[..., i], low[..., i] - to_high[..., i])) for i in range(3)], metric)


def most(low: np.ndarray, high: np.ndarray, to_low: np.ndarray, to_high: np.ndarray, metric: str) -> np.ndarray:
    """As least(), to the farthest corner: never less."""
    return distances([np.maximum(high[..., i] - to_low[..., i], to_high[..., i] - low[..., i]) for i in range(3)], metric)


def chunks(n: int, width: int):
    step = max(1, CHUNK // max(1, width))
    return [slice(i, i + step) for i in range(0, n, step)]


def run_lengths(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of arrays in one order: the first index of each run of equal rows, and each row's place in its run."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    starts = np.flatnonzero(new)
    return starts, np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


@dataclass(frozen=True)
class Tree:
    """Leaves of as many points each: `at` are their indices (leaves x width); where they don't come out even, some stand twice, marked by `copy`."""

    depth: int
    at: np.ndarray
    copy: np.ndarray
    points: np.ndarray
    #: Of each level: bounds of the nodes, and how many points they have.
    low: list[np.ndarray]
    high: list[np.ndarray]
    n: list[np.ndarray]


def _ends(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest along the last axis, which is turned to the front where it is short: numpy is slow along short rows."""
    if some.shape[-1] <= 64:
        some = np.ascontiguousarray(np.moveaxis(some, -1, 0))
        return some.min(axis=0), some.max(axis=0)
    return some.min(axis=-1), some.max(axis=-1)


def tree(p: np.ndarray, fewest: int) -> Tree:
    """The tree of points (n x 3, one at least), of leaves of `fewest` points or up to twice that."""
    n, axes = len(p), np.ascontiguousarray(p.T)
    depth = max(0, int(np.log2(max(1.0, n / fewest))))
    width = -(-n // (1 << depth))
    at = np.lexsort(p.T)
    at = np.concatenate([at, at[: (width << depth) - n]])
    for level in range(depth):
        some = axes[:, at].reshape(3, 1 << level, -1)
        # Halves, so that no extent overflows.
        low, high = _ends(some)
        axis = (high / 2 - low / 2).argmax(axis=0)
        key = some[axis, np.arange(1 << level)]
        # Stable, so that points on a plane across the axis are cut by the axis before.
        order = np.argsort(key, axis=1, kind="stable") + np.arange(1 << level)[:, None] * key.shape[1]
        at = at[order.ravel()]
    copy = np.ones(len(at), bool)
    copy[np.unique(at, return_index=True)[1]] = False
    low, high = _ends(axes[:, at].reshape(3, -1, width))
    at, copy = at.reshape(-1, width), copy.reshape(-1, width)
    low, high, held = [low.T], [high.T], [(~copy).sum(axis=1)]
    for _ in range(depth):
        low, high, held = [np.minimum(low[0][::2], low[0][1::2]), *low], [np.maximum(high[0][::2], high[0][1::2]), *high], [held[0][::2] + held[0][1::2], *held]
    return Tree(depth, at, copy, p[at], low, high, held)


def leaf_pairs(q: Tree, r: Tree, k: int, metric: str, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, far, limits): leaves of queries, in their order, beside those of references that can hold one of their k nearest, the farthest that
    points of these are apart, and for each leaf of queries a distance within which all k nearest are. bound: that of each query so far."""
    limits = [bound[q.at].max(axis=1)]
    for _ in range(q.depth):
        limits = [limits[0].reshape(-1, 2).max(axis=1), *limits]
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(1 + max(q.depth, r.depth)):
        if 0 < level <= q.depth:
            limits[level] = np.minimum(limits[level], np.repeat(limits[level - 1], 2))
            # Both halves of a node beside all that it meets: in the order of a.
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(a)))
            twice = np.repeat(counts, 2)
            first = np.repeat(starts, 2)
            inside = np.arange(twice.sum()) - np.repeat(np.cumsum(twice) - twice, twice)
            b = b[np.repeat(first, twice) + inside]
            a = np.repeat((2 * a[starts][:, None] + [0, 1]).ravel(), twice)
        if 0 < level <= r.depth:
            a, b = np.repeat(a, 2), (2 * b[:, None] + [0, 1]).ravel()
        i, j = min(level, q.depth), min(level, r.depth)
        box = q.low[i][a], q.high[i][a], r.low[j][b], r.high[j][b]
        near, far = least(*box, metric), most(*box, metric)
        if len(a):
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            held = np.minimum.reduceat(np.where(r.n[j][b] >= k, far, np.inf), starts)
            limits[i][a[starts]] = np.minimum(limits[i][a[starts]], held)
        keep = near <= limits[i][a]
        a, b, far = a[keep], b[keep], far[keep]
    return a, b, far, limits[-1]


def _chosen(d: np.ndarray, cols: np.ndarray, rows: np.ndarray, last: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k least up to `last` of each row of d, with `cols` as columns' names: by distance, then by name."""
    if d.shape[1] > k:
        last = np.minimum(last, np.partition(d, k - 1, axis=1)[:, k - 1])
    fits = (d <= last[:, None]) & (cols >= 0)
    n = fits.sum(axis=1)
    found = []
    plain = n == k
    if plain.any():
        take = fits[plain]
        names, at = cols[plain][take].reshape(-1, k), d[plain][take].reshape(-1, k)
        order = np.argsort(names, axis=1)
        names, at = np.take_along_axis(names, order, axis=1), np.take_along_axis(at, order, axis=1)
        order = np.argsort(at, axis=1, kind="stable")
        found.append((np.repeat(rows[plain], k), np.take_along_axis(names, order, axis=1).ravel(), np.take_along_axis(at, order, axis=1).ravel()))
    if not plain.all():
        some = np.flatnonzero(~plain)
        i, j = np.nonzero(fits[some])
        i = some[i]
        names, at = cols[i, j], d[i, j]
        order = np.lexsort((names, at, i))
        i, names, at = i[order], names[order], at[order]
        turn = run_lengths(i)[1] < k
        found.append((rows[i[turn]], names[turn], at[turn]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: No query, no reference, no distance.
NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _in_leaves(q: Tree, r: Tree, numbers: np.ndarray, k: int, metric: str, bound: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray):
    """As nearest(), of pairs of leaves."""
    width, wide = q.at.shape[1], r.at.shape[1]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    counts = np.diff(np.append(starts, len(a)))
    own = np.lexsort((far, a))[starts]
    leaves = a[starts]
    # The nearest leaf of references bounds the k-th distance of each query.
    limit = bound[q.at[leaves]]
    if wide >= k:
        for part in chunks(len(leaves), width * wide):
            x, y = q.points[leaves[part]], r.points[b[own[part]]]
            d = distances([x[:, :, None, i] - y[:, None, :, i] for i in range(3)], metric)
            d[np.broadcast_to(r.copy[b[own[part]]][:, None, :], d.shape)] = np.inf
            limit[part] = np.minimum(limit[part], np.partition(d, k - 1, axis=2)[:, :, k - 1])
    group = np.repeat(np.arange(len(leaves)), counts)
    point, other = [], []
    for part in chunks(len(a), 3 * width):
        x, box = q.points[a[part]], (r.low[-1][b[part]][:, None], r.high[-1][b[part]][:, None])
        i, j = np.nonzero((least(x, x, *box, metric) <= limit[group[part]]) & ~q.copy[a[part]])
        point.append(group[part][i] * width + j)
        other.append(b[part][i])
    point, other = np.concatenate(point), np.concatenate(other)
    order = np.argsort(point, kind="stable")
    point, other = point[order], other[order]
    starts = run_lengths(point)[0]
    counts = np.diff(np.append(starts, len(point)))
    names, places, limit = q.at[leaves].ravel(), q.points[leaves].reshape(-1, 3), limit.ravel()
    cols = np.where(r.copy, -1, numbers[r.at])
    found = []
    for count in np.unique(counts):
        ones = starts[counts == count]
        for part in chunks(len(ones), int(count) * wide):
            at = ones[part]
            to = other[at[:, None] + np.arange(count)]
            x, y = places[point[at]], r.points[to].reshape(len(at), -1, 3)
            col = cols[to].reshape(len(at), -1)
            d = distances([x[:, None, i] - y[:, :, i] for i in range(3)], metric)
            d[col < 0] = np.inf
            found.append(_chosen(d, col, names[point[at]], limit[point[at]], k))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else NONE


@np.errstate(over="ignore")
def nearest(q: np.ndarray, r: np.ndarray, numbers: np.ndarray, k: int, metric: str, bound: np.ndarray, look=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, distance) of the k nearest references up to `bound`, references by their numbers, of each query by distance and then by number, queries in their order; and which
    queries were looked at: all, or those of leaves that look(low, high, limit) names, of the leaves' bounds and distances within which all their k nearest are.
    """
    seen = np.ones(len(q), bool)
    if not len(q) or not len(r):
        return *NONE, seen
    if len(r) <= 2 * max(LEAF, k):
        names, found = numbers[None], [NONE]
        for part in chunks(len(q), len(r)):
            d = distances([q[part, None, i] - r[None, :, i] for i in range(3)], metric)
            found.append(_chosen(d, np.broadcast_to(names, d.shape), np.arange(len(q))[part], bound[part], k))
        found = tuple(np.concatenate(x) for x in zip(*found, strict=True))
    else:
        right = tree(r, max(LEAF, k))
        left = right if k <= LEAF and np.array_equal(q, r) else tree(q, LEAF)
        a, b, far, limits = leaf_pairs(left, right, k, metric, bound)
        if look is not None:
            leaf = look(left.low[-1], left.high[-1], limits)
            seen[:] = False
            seen[left.at[leaf][~left.copy[leaf]]] = True
            a, b, far = a[leaf[a]], b[leaf[a]], far[leaf[a]]
        found = _in_leaves(left, right, numbers, k, metric, bound, a, b, far) if len(a) else NONE
    order = np.argsort(found[0], kind="stable")
    return *(x[order] for x in found), seen
