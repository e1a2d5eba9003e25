"""Nearest neighbours by blocks: cells of both sides that follow their density, in each of which a task looks by itself.

A node of more than BLOCK points is cut by its own bounds into as many parts as bring them down to a block, so a far point
or points on a surface only cost another level. A block's own references bound a query's k-th distance. Where no other
block has references that near, the query is settled. Only the others, near the sides of their blocks, are written out with
what they have, go on to those other blocks, and meet what these hold of references around them for the best of both. So points are
moved twice, and pairs of few queries. The driver and the workers hold the blocks' bounds, a row for some ten thousand points.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.storage import checkpointed, stored
from . import arrays, ranks
from .crop import AXES

#: Points of both sides in a block, and the most parts that a node is cut into on each axis.
BLOCK, CUTS = 65_536, 16
#: Queries of other blocks that meet a block's references in one group, at most on the average.
ASKED = 65_536
#: Characters of a path for each level, and what a path ends with where more than a block's points are at one place.
WIDE, CROWDED = 4, "="
#: Rows of a side table of bounds that is broadcast, at most.
REACHED = 500_000


@dataclass(frozen=True)
class Bounds:
    """The blocks of a shape that have references: paths, how many, and their bounds (blocks x 3)."""

    paths: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _part(a: str) -> Column:
    # Halves, so that no extent overflows.
    share = F.try_divide(F.col(a) / 2 - F.col(f"_min_{a}") / 2, F.col(f"_max_{a}") / 2 - F.col(f"_min_{a}") / 2)
    return F.least(F.col("_cuts") - 1, F.floor(F.coalesce(share, F.lit(0.0)) * F.col("_cuts"))).cast("int")


def placed(points: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """points (shape_id, x, y, z, ...) with the path of their block, of `most` points unless more lie at one place, and those blocks (shape_id, path), if any.

    Levels are joined with the nodes that are cut alone, which are broadcast as long as they are few: no points are moved or written.
    """
    points, level, crowded = points.withColumn("path", F.lit("")), 0, None
    while True:
        left = points.where(F.length("path") == level * WIDE)
        nodes = left.groupBy("shape_id", "path").agg(F.count(F.lit(1)).alias("_n"), *(f(a).alias(f"_{end}_{a}") for end, f in (("min", F.min), ("max", F.max)) for a in AXES))
        wide = functools.reduce(lambda x, y: x | y, (F.col(f"_max_{a}") > F.col(f"_min_{a}") for a in AXES))
        cuts = F.greatest(F.lit(2), F.least(F.lit(CUTS), F.ceil(F.cbrt(2.0 * F.col("_n") / most)))).cast("int")
        nodes = checkpointed(nodes.where(F.col("_n") > most).withColumns({"_cuts": cuts, "_wide": wide}).drop("_n"))
        narrow, nodes = nodes.where(~F.col("_wide")).select("shape_id", "path"), nodes.where("_wide").drop("_wide")
        if not narrow.isEmpty():
            crowded = narrow if crowded is None else crowded.unionByName(narrow)
        if nodes.isEmpty():
            return points, crowded
        part = functools.reduce(lambda x, y: x * CUTS + y, (_part(a) for a in AXES))
        told = ranks.with_group(points, nodes, "shape_id", "path", how="left")
        told = told.withColumn("path", F.when(F.col("_cuts").isNull(), F.col("path")).otherwise(F.concat("path", F.lpad(F.hex(part), WIDE, "0"))))
        points, level = told.select(*points.columns), level + 1
        if level % 4 == 0 or nodes.count() > ranks.SMALL_ROWS:
            points = checkpointed(points)


def _bounds(refs: DataFrame) -> dict[str, Bounds]:
    """The bounds of the blocks by shape, ordered by path."""
    rows = refs.groupBy("shape_id", "path").agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{end}_{a}") for end, f in (("min", F.min), ("max", F.max)) for a in AXES)).toArrow()
    rows = rows.sort_by([("shape_id", "ascending"), ("path", "ascending")])
    shapes, paths, n = rows["shape_id"].to_pylist(), np.array(rows["path"].to_pylist(), object), rows["n"].to_numpy()
    low, high = (np.stack([rows[f"{end}_{a}"].to_numpy() for a in AXES], axis=1) for end in ("min", "max"))
    starts = [i for i in range(len(shapes)) if i == 0 or shapes[i] != shapes[i - 1]] + [len(shapes)]
    return {shapes[i]: Bounds(paths[i:j], n[i:j], low[i:j], high[i:j]) for i, j in zip(starts, starts[1:], strict=False)}


def _holding(far: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The least distance, of each row, within which whole blocks hold k references; infinite where all hold fewer."""
    order = np.argsort(far, axis=1)
    held = np.cumsum(n[order], axis=1) >= k
    at = np.take_along_axis(far, np.take_along_axis(order, held.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
    return np.where(held.any(axis=1), at, np.inf)


def _places(table: pa.Table, prefix: str = "") -> np.ndarray:
    return np.stack([table[f"{prefix}{a}"].to_numpy() for a in AXES], axis=1) if table.num_rows else np.zeros((0, 3))


@np.errstate(over="ignore")
def _between(low: np.ndarray, high: np.ndarray, bound: np.ndarray, others: Bounds, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(box, block) of blocks that begin within the bound of boxes or places; those of small bounds don't meet what those of large ones do."""
    order, rows, cols = np.argsort(bound), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(low), 4096):
        some = order[start : start + 4096]
        to = bound[some]
        near = np.flatnonzero(arrays.least(low[some].min(axis=0), high[some].max(axis=0), others.low, others.high, metric) <= to.max())
        for part in arrays.chunks(len(some), len(near)):
            i, j = np.nonzero(arrays.least(low[some[part], None], high[some[part], None], others.low[near][None], others.high[near][None], metric) <= to[part, None])
            rows.append(some[part][i])
            cols.append(near[j])
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    order = np.lexsort((cols, rows))
    return rows[order], cols[order]


def _kept(refs: pa.Table, k: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """References by id; and, in the order of places, where they are and their rows, without those beyond the first k of a place."""
    refs = refs.take(pc.sort_indices(refs, [("ref_id", "ascending")], null_placement="at_start"))
    at = _places(refs)
    order = np.lexsort(at.T)
    first = order[arrays.run_lengths(*at[order].T)[1] < k]
    return refs, at[first], first


@dataclass(frozen=True)
class Block:
    """A block's queries and references. Queries at one place have the same neighbours, which are looked for once: `turn` has each query's place."""

    asking: pa.Table
    holding: pa.Table
    turn: np.ndarray
    q: np.ndarray
    r: np.ndarray
    numbers: np.ndarray

    @staticmethod
    def of(rows: pa.Table, k: int) -> Block:
        asking, (holding, r, numbers) = rows.filter(rows["_asks"]), _kept(rows.filter(rows["_held"]), k)
        at = _places(asking)
        order = np.lexsort(at.T)
        starts, inside = arrays.run_lengths(*at[order].T)
        turn = np.empty(len(at), np.int64)
        turn[order] = np.cumsum(inside == 0) - 1
        q, own = at[order][starts], arrays.run_lengths(*r.T)[0]
        # Where both sides are at the same places, and hardly two points at one: one tree for both.
        if len(r) <= len(q) * 1.25 and np.array_equal(q, r[own]):
            q, turn = r, own[turn]
        return Block(asking, holding, turn, q, r, numbers)

    def expanded(self, places: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each query the rows of its place, of rows in the order of places."""
        starts = np.searchsorted(places, np.arange(len(self.q) + 1))
        counts = np.diff(starts)[self.turn]
        rows = np.repeat(np.arange(len(counts)), counts)
        at = np.repeat(starts[:-1][self.turn], counts) + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
        return rows, *(x[at] for x in more)

    def found(self, path: str, bounds: Bounds | None, k: int, metric: str, most: float, everywhere: bool):
        """What this block's references give: (place, reference, distance); whether places are unsettled; and (place, block, bound) of blocks that these go on to.

        Unless everywhere, places that are settled for sure aren't looked at.
        """
        crowded, everything = path.endswith(CROWDED), np.full(len(self.q), most)
        others = np.flatnonzero(bounds.paths != path) if bounds is not None else []
        if not len(others):
            found = arrays.nearest(self.q, self.r, self.numbers, k, metric, everything)[:3] if everywhere or crowded else arrays.NONE
            return *found, np.full(len(self.q), crowded), *arrays.NONE
        beside = Bounds(bounds.paths[others], bounds.n[others], bounds.low[others], bounds.high[others])
        look = lambda low, high, limit: np.bincount(_between(low, high, limit, beside, metric)[0], minlength=len(low)) > 0
        rows, cols, d, seen = arrays.nearest(self.q, self.r, self.numbers, k, metric, everything, None if everywhere or crowded else look)
        bound = everything
        full = np.flatnonzero(np.bincount(rows, minlength=len(self.q)) == k)
        bound[full] = d[np.searchsorted(rows, full, side="right") - 1]
        if len(self.r) < k:
            for part in arrays.chunks(len(self.q), len(bounds.n)):
                here = self.q[part, None]
                with np.errstate(over="ignore"):
                    bound[part] = np.minimum(bound[part], _holding(arrays.most(here, here, bounds.low[None], bounds.high[None], metric), bounds.n, k))
        seen = np.flatnonzero(seen)
        place, to = _between(self.q[seen], self.q[seen], bound[seen], beside, metric)
        place, to = seen[place], others[to]
        unsettled = np.full(len(self.q), crowded)
        unsettled[place] = True
        return rows, cols, d, unsettled, place, to, bound[place]


def _blocks(table: pa.Table):
    """(shape, path, rows) of the blocks in a group: one, unless their hashes are the same."""
    keys = table.select(["shape_id", "path"]).group_by(["shape_id", "path"]).aggregate([]).to_pylist()
    for shape, path in (key.values() for key in keys):
        yield shape, path, table if len(keys) == 1 else table.filter(pc.and_(pc.equal(table["shape_id"], shape), pc.equal(table["path"], path)))


def _taken(table: pa.Table, at: np.ndarray, names: list[str], prefix: str) -> list[pa.ChunkedArray]:
    """Columns of rows of a table whose places are called x, y, z."""
    called = {f"{prefix}{a}": a for a in AXES}
    return table.select([called.get(c, c) for c in names]).take(pa.array(at)).columns


def _fields(schema: StructType, prefix: str) -> dict[str, str]:
    return {f.name: "double" if f.name in {f"{prefix}{a}" for a in AXES} else f.dataType.simpleString() for f in schema}


def _answers(points: DataFrame, queries: StructType, refs: StructType, k: int, metric: str, most: float) -> tuple[DataFrame, DataFrame]:
    """What is found for queries that their block settles, and for the others, with the path of their block as _home.

    points: shape_id, path, x, y, z, _asks and _held (whether a row is a query, and a reference) and all other columns of queries and references.
    """
    asks_at = {f"q{a}": "double" for a in AXES}
    asked, told = _fields(queries, "q"), {c: t for c, t in _fields(refs, "r").items() if c != "shape_id"} | {"d2": "double"}
    out, asked = asked, asked | asks_at
    own, more = list(asked), [c for c in told if c != "d2"]
    ddl = lambda *names: ", ".join(f"`{c}` {t}" for c, t in {k: v for part in names for k, v in part.items()}.items())
    held = points.where("_held").select("shape_id", "path", *AXES, *(c for c in more if c not in {f"r{a}" for a in AXES}))
    bounds = points.sparkSession.sparkContext.broadcast(_bounds(held))

    def settle(table: pa.Table) -> pa.Table:
        parts = []
        for shape, path, rows in _blocks(table):
            block = Block.of(rows, k)
            at, cols, d, unsettled, *_ = block.found(path, bounds.value.get(shape), k, metric, most, True)
            keep = ~unsettled[at]
            i, cols, d = block.expanded(at[keep], cols[keep], d[keep])
            rank = (arrays.run_lengths(i)[1] + 1).astype(np.int32)
            parts.append(pa.table([*_taken(block.asking, i, list(out), "q"), *_taken(block.holding, cols, more, "r"), pa.array(d), pa.array(rank)], names=[*out, *told, "rank"]))
        return pa.concat_tables(parts)

    def aim(table: pa.Table) -> pa.Table:
        parts, names = [], [*own, "_home", *told, "_path", "_bound"]
        for shape, path, rows in _blocks(table):
            block, blocks = Block.of(rows, k), bounds.value.get(shape)
            at, cols, d, unsettled, place, to, bound = block.found(path, blocks, k, metric, most, False)
            keep = unsettled[at]
            i, cols, d = block.expanded(at[keep], cols[keep], d[keep])
            home = pa.array([path] * len(i), pa.string())
            here = [*_taken(block.asking, i, own, "q"), home, *_taken(block.holding, cols, more, "r"), pa.array(d), pa.nulls(len(i), pa.string()), pa.nulls(len(i), pa.float64())]
            parts.append(pa.table(here, names=names))
            if len(place):
                i, to, bound = block.expanded(place, to, bound)
                home, nothing = pa.array([path] * len(i), pa.string()), [pa.nulls(len(i), c.type) for c in here[len(own) + 1 : -2]]
                parts.append(pa.table([*_taken(block.asking, i, own, "q"), home, *nothing, pa.array(blocks.paths[to], pa.string()), pa.array(bound)], names=names))
        return pa.concat_tables(parts)

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        right, r, numbers = _kept(right, k)
        i, cols, d, _ = arrays.nearest(_places(left, "q"), r, numbers, k, metric, left["_bound"].to_numpy())
        return pa.table([*left.select([*own, "_home"]).take(pa.array(i)).columns, *_taken(right, cols, more, "r"), pa.array(d)], names=[*own, "_home", *told])

    grouped = points.withColumn("_block", F.xxhash64("shape_id", "path")).groupBy("_block")
    aimed = stored(grouped.applyInArrow(aim, ddl(asked, {"_home": "string"}, told, {"_path": "string", "_bound": "double"})))
    asks = aimed.where("_path is not null").select(*own, "_home", F.col("_path").alias("path"), "_bound")
    # A little more than the bound, so that what a root rounds is inside.
    far = (F.col("_bound") if metric == "l1" else F.sqrt("_bound")) * (1 + 1e-9) + 1e-150
    reach = asks.groupBy("shape_id", "path", "_home").agg(*(c for a in AXES for c in (F.min(F.col(f"q{a}") - far).alias(f"_from_{a}"), F.max(F.col(f"q{a}") + far).alias(f"_to_{a}"))))
    reach = checkpointed(reach.drop("_home").withColumnsRenamed({"shape_id": "_shape", "path": "_at"}))
    inside = functools.reduce(lambda x, y: x & y, (F.col(a).between(F.col(f"_from_{a}"), F.col(f"_to_{a}")) for a in AXES))
    near = held.join(F.broadcast(reach) if reach.count() <= REACHED else reach, (F.col("shape_id") == F.col("_shape")) & (F.col("path") == F.col("_at")) & inside, "left_semi")
    hot = checkpointed(asks.groupBy("shape_id", "path").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("_salts")).where("_salts > 1"))
    if hot.isEmpty():
        asks, near = asks.withColumn("_salt", F.lit(0)), near.withColumn("_salt", F.lit(0))
    else:
        one = F.coalesce("_salts", F.lit(1))
        asks = ranks.with_group(asks, hot, "shape_id", "path", how="left").withColumn("_salt", F.pmod(F.hash("query_id"), one)).drop("_salts")
        near = ranks.with_group(near, hot, "shape_id", "path", how="left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    at = ["shape_id", "path", "_salt"]
    met = asks.groupBy(*at).cogroup(near.groupBy(*at)).applyInArrow(meet, ddl(asked, {"_home": "string"}, told))
    order = Window.partitionBy("shape_id", "query_id").orderBy("d2", "ref_id")
    best = aimed.where("_path is null").select(*met.columns).unionByName(met).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    types = {f.name: f.dataType for f in (*refs, *queries)}
    typed = lambda df, *more: df.select(*(F.col(c).cast(types[c]).alias(c) if c in types else c for c in (*out, *told, "rank", *more)))
    return typed(grouped.applyInArrow(settle, ddl(out, told, {"rank": "int"}))), typed(best, "_home")


def nearest(queries: DataFrame, refs: DataFrame, k: int, metric: str = "l2", most: float = float("inf")) -> DataFrame:
    """knn.knn() of queries of which one lies at a place, and references of which k at most do; only references up to `most` count.

    Both are read several times, so they should be at rest.
    """
    at = lambda p: [F.col(f"{p}{a}").cast("double").alias(a) for a in AXES]
    rest = lambda df, p: [c for c in df.columns if c not in ("shape_id", *(f"{p}{a}" for a in AXES))]
    sides = [df.select("shape_id", *at(p), F.lit(p == "q").alias("_asks"), F.lit(p == "r").alias("_held"), *rest(df, p)) for df, p in ((queries, "q"), (refs, "r"))]
    both, _ = placed(sides[0].unionByName(sides[1], allowMissingColumns=True).where("shape_id is not null"), max(BLOCK, 4 * k))
    settled, others = _answers(both, queries.schema, refs.schema, k, metric, most)
    return settled.unionByName(others.drop("_home"))


def among(points: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """knn.among() of points (shape_id, x, y, z, query_id, ref_id, at rest), which are queries and references at once; any number may lie at a place.

    A place of more points than a block has takes part by its first k, and one of them asks for all.
    """
    queries, refs = (points.select("shape_id", c).schema for c in ("query_id", "ref_id"))
    both, crowded = placed(points.where("shape_id is not null").withColumns({"_asks": F.lit(True), "_held": F.lit(True)}), max(BLOCK, 4 * k))
    if crowded is None:
        settled, others = _answers(both, queries, refs, k, metric, float("inf"))
        return settled.unionByName(others.drop("_home"))
    crowd = stored(ranks.with_group(both, crowded, "shape_id", "path"))
    turn = Window.partitionBy("shape_id", "path").orderBy("ref_id")
    firsts = stored(crowd.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= k))
    firsts = firsts.withColumns({"path": F.concat("path", F.lit(CROWDED)), "_asks": F.col("_turn") == 1}).select(*both.columns)
    apart = ranks.with_group(both, crowded.withColumn("_crowd", F.lit(True)), "shape_id", "path", how="left").where("_crowd is null").select(*both.columns)
    settled, best = _answers(apart.unionByName(firsts), queries, refs, k, metric, float("inf"))
    best = stored(best)
    found = settled.unionByName(best.where(~F.col("_home").endswith(CROWDED)).drop("_home"))
    theirs = best.where(F.col("_home").endswith(CROWDED)).withColumn("path", F.expr(f"substring(_home, 1, length(_home) - {len(CROWDED)})"))
    theirs = theirs.select("shape_id", "path", *(c for c in found.columns if c not in queries.names))
    asking = crowd.select("shape_id", "path", "query_id")
    return found.unionByName(ranks.with_group(asking, theirs, "shape_id", "path").select(*found.columns))
