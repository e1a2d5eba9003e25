"""Near-duplicate vectors by a pigeonhole join over subspaces.

Unit vectors with cosine c are sqrt(2 - 2c) apart. They are rotated, which keeps distances, and split into
blocks of BLOCK components or more; of a pair within the whole squared distance some block is within its
proportional share. So each block is joined by range on its own: blocks fall into cells of a grid twice as
wide as the block's radius, and vectors near a cell's lower side also visit the cell below, so that each pair
in range meets in one cell. What any block finds is verified on the whole vectors. A pair counts in the first
block that has it in range, which any task can tell from the two vectors, so pairs are never gathered: a cell
gives the number of links of each of its vectors, and a spanning forest of them.

Equal vectors are one node from the start. Cells are cut into tiles, and each pair of tiles is compared by itself.
How many components a block has, and how many axes its grid, is chosen by what the pairs and copies of a sample cost
(plan()): each axis copies rows, which pays only where vectors are apart on it. The result is the same for any choice.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from .ann import _matrix, hadamard, padded_width, usable
from .common import join_hot
from .minhash import _bounds, _runs, connected_components, tiled

COSINE = 0.95
#: Components of a block, at least, and the most that its grid is laid over.
BLOCK, MOST_AXES = 8, 6
#: Vectors of a tile in a small and a large table, which has TILES of the smaller ones at least, and of the square of pairs that is worked on at once.
TILE, LARGE_TILE, TILES, SQUARE = 8192, 32_768, 8, 512
#: Different vectors, and numbers of theirs, that plan() looks at. It has no part in any result.
SAMPLE_ROWS, SAMPLE_FLOATS = 2048, 1_000_000
#: Nanoseconds for looking at a pair, for each component of its block, and for a copy of a row.
PAIR_NS, COMPONENT_NS, COPY_NS = 0.5, 0.07, 12_000.0
#: The share of a square's pairs in range from which on they are compared as matrices.
DENSE = 0.05
#: Squared distances are wrong by far less than this; what lies nearer to a bound is compared again, exactly and in one fixed order.
SLACK = 1e-9
#: The same for single precision, in which a block's pairs are looked for first.
ROUGH = 1e-5
SEED = 13


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors after a pseudo-random rotation. A row's result depends on nothing but the row, bit by bit."""
    width = padded_width(vectors.shape[1])
    x = np.zeros((len(vectors), width))
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    x[:, : vectors.shape[1]] = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    for turn in range(3):
        x = hadamard(x * np.random.default_rng([SEED, turn, width]).choice([-1.0, 1.0], width))
    return x


class Blocks:
    """The blocks of vectors of one length, each with its share of the whole squared distance."""

    def __init__(self, dim: int, cosine: float, axes: int, block: int = BLOCK):
        width = padded_width(dim)
        self.count = max(1, width // block)
        self.size = width // self.count
        self.share = (2 - 2 * cosine + SLACK) / self.count
        self.radius = math.sqrt(self.share) * (1 + SLACK)
        self.axes = min(axes, self.size)
        self.factors = np.random.default_rng([SEED, dim]).integers(1, 1 << 62, self.axes + 2) | 1

    def cells(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, keys, visits): the cells that rows of rotated vectors go to. visits has a bit for each axis on which a row comes from the cell above.

        A pair in range has homes at most one apart on each axis, so it meets, with no common bit, in exactly one cell.
        """
        side = 2 * self.radius
        for b in range(self.count):
            part = x[:, b * self.size : b * self.size + self.axes]
            home = np.floor(part / side).astype(np.int64)
            below = part - home * side <= self.radius
            base = (home * self.factors[: self.axes]).sum(axis=1) + self.factors[-1] * b
            for visit in range(1 << self.axes):
                bits = (visit >> np.arange(self.axes)) & 1
                rows = np.flatnonzero((below | (bits == 0)).all(axis=1))
                if len(rows):
                    mixed = base[rows] - (bits * self.factors[: self.axes]).sum()
                    yield rows, (mixed & ~np.int64(0xFFFF)) | b, np.full(len(rows), visit, np.int64)

    def block(self, x: np.ndarray, b: int) -> np.ndarray:
        return x[:, b * self.size : (b + 1) * self.size]

    def within(self, x: np.ndarray, y: np.ndarray, b: int) -> np.ndarray:
        """Which pairs (x[i], y[i]) a block has in range; the same for a pair wherever it is asked."""
        step = self.block(x, b) - self.block(y, b)
        total = step[:, 0] * step[:, 0]
        for c in range(1, self.size):
            total = total + step[:, c] * step[:, c]
        return total <= self.share


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * (x @ y.T)


class Group:
    """The vectors of one cell, or of two tiles of it: links counted for each, and which hang together."""

    def __init__(self, vectors: np.ndarray, visits: np.ndarray, copies: np.ndarray, key: int, cosine: float, axes: int, block: int = BLOCK):
        self.blocks = Blocks(vectors.shape[1], cosine, axes, block)
        self.b, self.cosine = key & 0xFFFF, cosine
        self.vectors, self.visits, self.copies = vectors, visits, copies.astype(np.float64)
        self.unit = rotated(vectors)
        self.links, self.tree = np.zeros(len(vectors)), np.arange(len(vectors))
        # The products of a row of `left` and one of `right` are the squared distances in the cell's block, in single precision.
        part = self.blocks.block(self.unit, self.b)
        square, ones = (part * part).sum(axis=1, keepdims=True), np.ones((len(part), 1))
        self.left = np.concatenate([-2 * part, square, ones], axis=1).astype(np.float32)
        self.right = np.concatenate([part, ones, square], axis=1).astype(np.float32)

    def _cosines(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """In double precision from the vectors as they are."""
        out = np.zeros(len(one))
        for s in range(0, len(one), 65_536):
            x, y = self.vectors[one[s : s + 65_536]], self.vectors[other[s : s + 65_536]]
            x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
            out[s : s + 65_536] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
        return out

    def _few(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Which pairs of rows are linked and count here: in range in this block, in none before."""
        fits = (self.visits[one] & self.visits[other]) == 0
        for b in (self.b, *range(self.b)):
            at = np.flatnonzero(fits)
            fits[at] = self.blocks.within(self.unit[one[at]], self.unit[other[at]], b) == (b == self.b)
        at = np.flatnonzero(fits)
        fits[at] = self._cosines(one[at], other[at]) >= self.cosine
        return fits

    def _many(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """_few() of all pairs of rows of one and other, as a matrix. Only what is near a bound is compared pair by pair."""
        x, y, share = self.unit[one], self.unit[other], self.blocks.share
        own = (self.visits[one][:, None] & self.visits[other][None]) == 0
        doubt = np.zeros_like(own)
        for b in (self.b, *range(self.b)):
            d = _squared(self.blocks.block(x, b), self.blocks.block(y, b))
            own &= d <= share + SLACK if b == self.b else d > share - SLACK
            doubt |= np.abs(d - share) <= SLACK
        dots = x @ y.T
        doubt |= np.abs(dots - self.cosine) <= SLACK
        linked = own & ~doubt & (dots >= self.cosine)
        i, j = np.nonzero(own & doubt)
        linked[i, j] = self._few(one[i], other[j])
        return linked

    def compare(self, one: np.ndarray, other: np.ndarray, same: bool) -> None:
        """Links of rows `one` with rows `other`; same: they are the same rows, and a pair is met twice."""
        near = self.left[one] @ self.right[other].T <= self.blocks.share + ROUGH
        i, j = np.divmod(np.flatnonzero(near), len(other))
        if len(i) > DENSE * near.size:
            i, j = np.nonzero(self._many(one, other))
            known = True
        else:
            known = False
        if same:
            i, j = i[i < j], j[i < j]
        i, j = one[i], other[j]
        if not known:
            fits = self._few(i, j)
            i, j = i[fits], j[fits]
        if not len(i):
            return
        self.links += np.bincount(i, self.copies[j], len(self.links)) + np.bincount(j, self.copies[i], len(self.links))
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])).tolist()
        for s, e in zip(starts, [*starts[1:], len(i)], strict=True):
            trees = np.unique(self.tree[np.append(j[s:e], i[s])])
            if len(trees) > 1:
                self.tree[np.isin(self.tree, trees)] = trees[0]

    def run(self, tile: np.ndarray, i: int, j: int) -> None:
        rows = [np.flatnonzero(tile == t) for t in (i, j)]
        squares = [[r[s : s + SQUARE] for s in range(0, len(r), SQUARE)] for r in rows]
        for n, one in enumerate(squares[0]):
            for m, other in enumerate(squares[1][n if i == j else 0 :]):
                self.compare(one, other, i == j and m == 0)


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as (id, digest), and one node for each different vector: node, digest, vec, dim, copies, least."""
    kind = rows.schema["vec"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            vec = batch.column("vec")
            flat = np.asarray(vec.flatten().to_numpy(zero_copy_only=False)) + 0.0  # minus zero is zero
            ends = np.cumsum(batch.column("dim").to_numpy())
            digests = [hashlib.blake2b(flat[e - d : e].tobytes(), digest_size=16).digest() for e, d in zip(ends.tolist(), batch.column("dim").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["id", "vec", "dim", "digest"])

    marked = rows.select("id", "vec", "dim").mapInArrow(run, f"id long, vec {kind}, dim int, digest binary")
    nodes = marked.groupBy("digest").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    # Numbered where they are written out, so that the numbers stay.
    return marked.select("id", "digest"), checkpointed(nodes.select(F.monotonically_increasing_id().alias("node"), "*"))


def plan(sample: list[np.ndarray], total: int, tile: int, cosine: float) -> tuple[int, int]:
    """(components of a block, axes of its grid) that cost least for `total` vectors like the sample's, which has a matrix for each length."""
    sample = [rotated(x) for x in sample]
    seen, widest = sum(len(x) for x in sample), max((x.shape[1] for x in sample), default=BLOCK)
    more, best = max(1.0, total / max(seen, 1)), (math.inf, BLOCK, 0)
    # Two blocks at least, where there are components for them.
    for block in (BLOCK << n for n in range(max(1, (widest // BLOCK).bit_length() - 1))):
        for axes in range(min(MOST_AXES, block) + 1):
            cost = 0.0
            for x in sample:
                blocks = Blocks(x.shape[1], cosine, axes, block)
                n = np.unique(np.concatenate([keys for _, keys, _ in blocks.cells(x)]), return_counts=True)[1].astype(float)
                cost += (PAIR_NS + COMPONENT_NS * blocks.size) * more * more * (n * (n - 1) / 2).sum() + COPY_NS * more * (n * np.maximum(1, n * more / tile)).sum()
            best = min(best, (cost, block, axes))
    return best[1:]


def _sample(nodes: DataFrame, longest: int) -> list[np.ndarray]:
    """Vectors of the nodes that come first by digest, a matrix for each length."""
    rows = nodes.orderBy("digest").limit(max(1, min(SAMPLE_ROWS, SAMPLE_FLOATS // max(longest, 1)))).select("dim", "vec").collect()
    by: dict[int, list] = {}
    for dim, vec in rows:
        by.setdefault(dim, []).append(vec)
    return [np.array(by[dim], np.float64) for dim in sorted(by)]


def _compared(nodes: DataFrame, total: int, longest: int, cosine: float) -> DataFrame:
    """(a, b, n): with b, an edge of a spanning forest of some cell's links; without, n more linked rows of node a."""
    size = max(TILE, min(LARGE_TILE, total // TILES))
    block, axes = plan(_sample(nodes, longest), total, size, cosine)

    def place(batches):
        for batch in batches:
            dims, node = batch.column("dim").to_numpy(), batch.column("node").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = rotated(_matrix(batch.column("vec").take(pa.array(at)), dim))
                for rows, keys, visits in Blocks(dim, cosine, axes, block).cells(x):
                    yield pa.RecordBatch.from_arrays([pa.array(node[at[rows]]), pa.array(keys), pa.array(visits)], names=["node", "key", "visits"])

    keyed = checkpointed(nodes.select("node", "vec", "dim").mapInArrow(place, "node long, key long, visits long"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("tiles", F.ceil(F.col("size") / size))
    members = tiled(join_hot(keyed, sizes, "key", "size", keyed.count()), F.col("tiles"), "node")
    members = members.join(nodes.select("node", "vec", "dim", "copies"), "node").select("dim", "key", "i", "j", "tile", "node", "visits", "copies", "vec")
    groups = ["dim", "key", "i", "j"]
    members = members.repartition(*groups).sortWithinPartitions(*groups)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for table in _runs(batches, groups):
            table = table.combine_chunks()
            edges = _bounds(table, groups)
            node, tile, visits, copies = (table.column(c).to_numpy() for c in ("node", "tile", "visits", "copies"))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                dim, key, i, j = (table.column(c)[s].as_py() for c in groups)
                group = Group(_matrix(table.column("vec").slice(s, e - s).combine_chunks(), dim), visits[s:e], copies[s:e], key, cosine, axes, block)
                group.run(tile[s:e], i, j)
                own, joined, found = node[s:e], np.flatnonzero(group.tree != np.arange(e - s)), np.flatnonzero(group.links)
                a = np.concatenate([own[group.tree[joined]], own[found]])
                b = pa.array([*own[joined].tolist(), *[None] * len(found)], pa.int64())
                n = pa.array([*[None] * len(joined), *group.links[found].astype(np.int64).tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), b, n], schema=schema)

    return members.mapInArrow(run, "a long, b long, n long")


def link(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings (vec_id, embedding), linked from a cosine of `cosine` on.

    Rows count each: equal vectors, also those of one id, are linked with each other. Vectors that are null, empty,
    zero or hold null or non-finite components are linked with nothing, as are those of different lengths with each
    other. A row with a null id is linked with nothing, and has a null component_id and kept. Other columns are not read.
    """
    rows, nodes = _nodes(usable(embeddings, "vec_id", "embedding"))
    total = nodes.agg(F.count(F.lit(1)), F.sum("copies"), F.max("dim")).first()
    found = checkpointed(_compared(nodes, total[0], total[2] or 0, cosine))
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    components = checkpointed(connected_components(found.where(F.col("b").isNotNull()).select("a", "b")).join(nodes.select("node", "least"), "node"))
    least = components.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = join_hot(components.drop("least"), least, "label", "size", components.count())
    told = nodes.select("node", "digest", "copies", "least").join(links, "node", "left").join(named.select("node", "component_id"), "node", "left")
    told = told.select("digest", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = join_hot(rows, told, "digest", "copies", total[1] or 0).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    out = linked.unionByName(unusable(embeddings).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def unusable(embeddings: DataFrame) -> DataFrame:
    """vec_id of the rows that usable() leaves out."""
    vec = F.col("embedding").cast("array<double>")
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    left = F.col("vec_id").isNull() | F.col("embedding").isNull() | ~F.coalesce(fine, F.lit(False))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), left.alias("left")).where("left").select("vec_id")


def oracle_sql() -> str:
    """link() by all pairs and a walk along the links, for tables of one row an id."""
    return f"""
    WITH RECURSIVE v AS MATERIALIZED (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {COSINE}),
    walk AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT walk.vec_id, links.b FROM walk JOIN links ON walk.other = links.a)
    SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, w.component_id, e.vec_id = w.component_id AS kept
    FROM embeddings e JOIN (SELECT vec_id, min(other) AS component_id FROM walk GROUP BY vec_id) w ON w.vec_id = e.vec_id"""
