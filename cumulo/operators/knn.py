"""Exact nearest neighbours within shapes.

While the shapes' sizes, which are counted first, allow it, queries and references of a shape are compared
directly. Beyond that, both sides are cut into blocks that follow their density (blocks.py): a query's own block
bounds its k-th distance, and it goes on to the few blocks that begin nearer than that, so that no pairs are moved.
grid() has cells of a given size instead, as long as these hold few pairs. Ties go to the smaller ref_id.

Hits within a radius go down a tree: a node is cut into 64 by its own bounds, so a far point, shapes far apart or points
on a surface only cost another level. A node that lies within the radius altogether adds its count, and only points of
nodes that the sphere's surface runs through are compared; nodes are cut until few spheres run through each.
candidates() goes down such a tree, of leaves of few points, for the pairs that may be nearest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed, stored
from . import blocks
from .crop import AXES
from .ranks import SMALL_ROWS, with_group

#: Largest number of pairs of one shape, and of all shapes, that are compared directly.
DIRECT_PAIRS, ALL_PAIRS = 4_000_000, 10_000_000
#: Points of a leaf of the tree, k at least, and parts that a node is cut into on each axis.
LEAF, CUT = 16, 4
#: Spheres of queries that may run through a node of the tree that within() doesn't cut, points it may have, and rows of queries beside such nodes that are broadcast.
CROSSED, HEAVY, MET_ROWS = 64, 1_000_000, 400_000
#: An extent that within() doesn't cut any more.
TINY = 1e-300
CELLS = ("_i", "_j", "_k")
#: References around a query, on the average, that grid() compares with it in a round: where there are more, blocks take over.
AROUND = 500


def as_queries(points: DataFrame, *keep: str) -> DataFrame:
    return points.select("shape_id", F.col("point_id").alias("query_id"), *(F.col(a).alias(f"q{a}") for a in AXES), *(F.col(c).alias(f"q_{c}") for c in keep))


def as_refs(points: DataFrame, *keep: str) -> DataFrame:
    return points.select("shape_id", F.col("point_id").alias("ref_id"), *(F.col(a).alias(f"r{a}") for a in AXES), *(F.col(c).alias(f"r_{c}") for c in keep))


def distance2(metric: str = "l2"):
    """Squared L2 distance, or L1 distance, of joined query and reference columns."""
    steps = [F.col(f"q{a}") - F.col(f"r{a}") for a in AXES]
    if metric == "l1":
        return sum((F.abs(s) for s in steps[1:]), F.abs(steps[0]))
    return steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2]


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("shape_id", "query_id").orderBy("d2", "ref_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def direct(queries: DataFrame, refs: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """knn() by comparing all queries with all references of a shape: for shapes of bounded size."""
    return _nearest(queries.join(refs, "shape_id").withColumn("d2", distance2(metric)), k)


PLACE = ("shape_id", *(f"r{a}" for a in AXES))


def _apart(refs: DataFrame, most: int) -> DataFrame:
    """refs without those beyond the first `most`, by ref_id, at one place: they are never among the `most` nearest of any query.

    So a place that very many references share costs each query no more than `most` pairs.
    """
    order = Window.partitionBy(*PLACE).orderBy("ref_id")
    return refs.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= most).drop("_turn")


def _by_cell(points: DataFrame, prefix: str, size: float) -> DataFrame:
    return points.groupBy("shape_id", *(F.floor(F.col(f"{prefix}{a}") / size).alias(c) for a, c in zip(AXES, CELLS, strict=True))).agg(F.count(F.lit(1)).alias(f"_{prefix}"))


def _crowded(queries: DataFrame, refs: DataFrame, size: float) -> bool:
    """Whether cells of `size` give very many pairs, which are counted by cells."""
    near = _by_cell(queries, "q", size)
    asked = near.agg(F.sum("_q")).first()[0] or 0
    for c in CELLS:
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    near = near.groupBy("shape_id", *CELLS).agg(F.sum("_q").alias("_q")).join(_by_cell(refs, "r", size), ["shape_id", *CELLS])
    pairs = near.agg(F.sum(F.col("_q").cast("double") * F.col("_r"))).first()[0] or 0
    return pairs > max(DIRECT_PAIRS, AROUND * asked)


def grid(queries: DataFrame, refs: DataFrame, k: int, size: float, metric: str = "l2", rounds: int = 40) -> DataFrame:
    """knn() by cells of `size` and up. Each round's settled queries are written out, and only the others go on.

    A given size holds more and more points of a denser cloud: queries that would meet very many go through adaptive().
    """
    extent = refs.select(*(f"r{a}" for a in AXES)).unionByName(queries.select(*(F.col(f"q{a}").alias(f"r{a}") for a in AXES)))
    row = extent.agg(*(F.max(f"r{a}") - F.min(f"r{a}") for a in AXES)).first()
    widest = max((v for v in row if v is not None), default=0.0)
    settled, left = None, queries
    refs = checkpointed(_apart(refs, k))
    for _ in range(rounds):
        last = size >= widest
        if _crowded(left, refs, size):
            found = adaptive(left, refs, k, metric)
            return found if settled is None else settled.unionByName(found)
        celled = refs
        near = left
        for a, c in zip(AXES, CELLS, strict=True):
            celled = celled.withColumn(c, F.floor(F.col(f"r{a}") / size))
            at = F.floor(F.col(f"q{a}") / size)
            near = near.withColumn(c, F.explode(F.sequence(at - 1, at + 1)))
        pairs = near.join(celled, ["shape_id", *CELLS]).drop(*CELLS).withColumn("d2", distance2(metric))
        found = _nearest(pairs, k)
        if last:
            done, left = checkpointed(found), None
        else:
            whole = Window.partitionBy("shape_id", "query_id")
            found = found.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_far", F.max("d2").over(whole))
            done = checkpointed(found.where((F.col("_n") == k) & (F.col("_far") < (size * size if metric == "l2" else size))).drop("_n", "_far"))
            left = checkpointed(left.join(done.select("shape_id", "query_id").distinct(), ["shape_id", "query_id"], "left_anti"))
        settled = done if settled is None else settled.unionByName(done)
        if left is None or left.isEmpty():
            return settled
        size *= 2
    raise RuntimeError("the grid did not come to cover the points")


def finite(points: DataFrame, prefix: str) -> DataFrame:
    """points without those that have a null, NaN or infinite coordinate: such points have no distance to any other."""
    for a in AXES:
        points = points.where(F.abs(F.col(f"{prefix}{a}")) < float("inf"))
    return points


NODE = ("side", "shape_id", "path")
_BOX = [f"{end}_{a}" for end in ("min", "max") for a in AXES]


def _boxes(points: DataFrame, *node: str) -> DataFrame:
    """Number of points, n, and bounds of each node."""
    return points.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{end}_{a}") for end, f in (("min", F.min), ("max", F.max)) for a in AXES))


def _wide(width: float = 0.0) -> Column:
    """Whether a node's points are more than `width` apart on some axis: with 0, at more than one place."""
    wide = F.lit(False)
    for a in AXES:
        # Not the difference, which vanishes or overflows where places still differ.
        wide = wide | ((F.col(f"max_{a}") > F.col(f"min_{a}")) & (F.col(f"max_{a}") - F.col(f"min_{a}") >= width))
    return wide


def _part() -> Column:
    """The path of the part of a node that is cut in which a point beside its bounds lies."""
    part = F.lit(0)
    for a in AXES:
        # Halves, so that no extent overflows.
        share = F.try_divide(F.col(a) / 2 - F.col(f"min_{a}") / 2, F.col(f"max_{a}") / 2 - F.col(f"min_{a}") / 2)
        part = part * CUT + F.least(F.lit(CUT - 1), F.floor(F.coalesce(share, F.lit(0.0)) * CUT)).cast("int")
    return F.concat("path", F.char(part + 48))


def _tree(points: DataFrame, most: int, width: float = float("inf")) -> tuple[DataFrame, DataFrame]:
    """Points (side, shape_id, x, y, z, ...) with the path of their leaf, and all nodes: side, shape_id, path, n, leaf and bounds.

    A path has one character a level. A node of more than `most` points, or of more than `width`, is cut by its own bounds, whose ends fall into
    different parts, so each round gets further unless more than `most` points lie at one place, which then is a leaf.
    """
    left, placed, nodes = points.withColumn("path", F.lit("")), None, None
    while True:
        boxes = checkpointed(_boxes(left, *NODE).withColumn("leaf", (F.col("n") <= most) & ~_wide(width) | ~_wide()))
        nodes = boxes if nodes is None else nodes.unionByName(boxes)
        told = with_group(left, boxes, *NODE).withColumn("path", F.when(F.col("leaf"), F.col("path")).otherwise(_part()))
        told = checkpointed(told.select(*left.columns, "leaf"))
        done = told.where("leaf").drop("leaf")
        placed = done if placed is None else placed.unionByName(done)
        left = told.where(~F.col("leaf")).drop("leaf")
        if left.isEmpty():
            return placed, nodes


def _sum(parts: list[Column], metric: str) -> Column:
    parts = parts if metric == "l1" else [p * p for p in parts]
    return parts[0] + parts[1] + parts[2]


def _least_distance(low, high, metric: str) -> Column:
    """From a box or point low(a)..high(a) to the box min_*..max_*, in the units of distance2(); never more than that of two points in them."""
    return _sum([F.greatest(F.lit(0.0), F.col(f"min_{a}") - high(a), low(a) - F.col(f"max_{a}")) for a in AXES], metric)


def _most_distance(low, high, metric: str) -> Column:
    """As _least_distance(), to the farthest corner; never less than the distance of two points in them."""
    return _sum([F.greatest(high(a) - F.col(f"min_{a}"), F.col(f"max_{a}") - low(a)) for a in AXES], metric)


#: Ends of the boxes of leaves of queries, for the two distances.
LEAF_BOX = (lambda a: F.col(f"q_min_{a}"), lambda a: F.col(f"q_max_{a}"))


def _reached(front: DataFrame, k: int, metric: str) -> DataFrame:
    """Pairs of a leaf of queries (q_path, q_min_*, q_max_*) and a node of references that can hold one of the k nearest of its queries."""
    far, near = _most_distance(*LEAF_BOX, metric), _least_distance(*LEAF_BOX, metric)
    leaf = Window.partitionBy("shape_id", "q_path")
    held = F.sum("n").over(leaf.orderBy("_far", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    front = front.withColumns({"_far": far, "_near": near}).withColumn("_held", held)
    bound = F.min(F.when(F.col("_held") >= k, F.col("_far"))).over(leaf)
    front = front.withColumn("bound", F.least(F.col("bound"), F.coalesce(bound, F.lit(float("inf")))))
    return front.where(F.col("_near") <= F.col("bound")).drop("_far", "_near", "_held")


def _side(points: DataFrame, side: str, name: str) -> DataFrame:
    """Queries (side q) or references (r) as points: side, shape_id, x, y, z, and the row under `name`."""
    return points.select(F.lit(side).alias("side"), "shape_id", *(F.col(f"{side}{a}").alias(a) for a in AXES), F.struct("*").alias(name))


def _sides(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Both as points of one table: side, shape_id, x, y, z, and the row as query or ref."""
    return _side(queries, "q", "query").unionByName(_side(refs, "r", "ref"), allowMissingColumns=True)


def _fronts(nodes: DataFrame) -> tuple[DataFrame, Callable[[DataFrame, int], DataFrame]]:
    """Leaves of queries beside the root of their shape's references, and a step from pairs with nodes that are cut to pairs with their parts.

    All other columns of the pairs are carried along.
    """
    asked = nodes.where("leaf and side = 'q'").select("shape_id", F.col("path").alias("q_path"), *(F.col(c).alias(f"q_{c}") for c in _BOX))
    told = ("path", "n", "leaf", *_BOX)
    tree = nodes.where("side = 'r'").select("shape_id", *told)
    kids = tree.where("path <> ''").withColumn("_of", F.expr("substring(path, 1, length(path) - 1)"))

    def down(cut: DataFrame, level: int) -> DataFrame:
        above = cut.select(F.col("path").alias("_of"), *(c for c in cut.columns if c not in told))
        return with_group(above, kids.where(F.length("path") == level), "shape_id", "_of").select(*cut.columns)

    return with_group(asked, tree.where("path = ''"), "shape_id"), down


def _at(a: str) -> Column:
    return F.col(f"query.q{a}")


def candidates(queries: DataFrame, refs: DataFrame, k: int, metric: str = "l2", bound: float = float("inf")) -> DataFrame:
    """Pairs of queries and references with d2, the k nearest of each query up to `bound` among them, whatever the points' density."""
    placed, nodes = _tree(_sides(queries, _apart(refs, k)), max(LEAF, k))
    front, down = _fronts(nodes)
    front, level = front.withColumn("bound", F.lit(float(bound))), 0
    while True:
        front = checkpointed(_reached(front, k, metric))
        # Pairs with leaves of other levels stay for the last step; the nodes that are cut go on as their parts, with the bound so far.
        done, cut = front.where("leaf"), front.where(~F.col("leaf"))
        if cut.isEmpty():
            break
        level += 1
        front = done.unionByName(down(cut, level))
    pairs = placed.where("side = 'q'").select("shape_id", F.col("path").alias("q_path"), "query").join(front.select("shape_id", "q_path", "path", "bound", *_BOX), ["shape_id", "q_path"])
    pairs = pairs.where(_least_distance(_at, _at, metric) <= F.col("bound")).select("shape_id", "path", "query")
    pairs = pairs.join(placed.where("side = 'r'").select("shape_id", "path", "ref"), ["shape_id", "path"])
    more = [c for c in refs.columns if c != "shape_id"]
    return pairs.select("query.*", *(F.col(f"ref.{c}").alias(c) for c in more)).withColumn("d2", distance2(metric))


def _places(refs: DataFrame) -> DataFrame:
    """A row a place, with the number of references that are there."""
    return refs.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_here"))


def _beside(table: DataFrame, rows: int | None = None, most: int = SMALL_ROWS) -> DataFrame:
    """A table for a join, broadcast where it has `most` rows at most."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= most else table


def within(queries: DataFrame, refs: DataFrame, r: float, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits of queries strictly within r, in two tables: sure (shape_id, query_id, hits), of nodes that lie within it altogether, and pairs
    of queries and references (d2) for which that had to be looked at.

    A node of references is cut only while more than CROSSED queries' spheres run through it, or it has more than HEAVY points: so a point
    is compared with that many at most, and how deep the tree goes follows from the queries, not from the number of points. One at a single
    place is never compared. Leaves of queries that are known to have `most` hits don't go on. While nodes are few, no
    point is moved.
    """
    placed, nodes = _tree(_side(queries, "q", "query"), LEAF, r / CUT)
    front = nodes.where("leaf").select("shape_id", F.col("path").alias("q_path"), F.col("n").alias("q_n"), *(F.col(c).alias(f"q_{c}") for c in _BOX))
    front, leaf = front.withColumn("known", F.lit(0).cast("long")), Window.partitionBy("shape_id", "q_path")
    left = refs.select("shape_id", *(F.col(f"r{a}").alias(a) for a in AXES)).withColumn("path", F.lit(""))
    whole, border, level = None, None, 0
    while True:
        boxes = checkpointed(_boxes(left.where(F.length("path") == level), "shape_id", "path"))
        # Nodes meet what crosses the node that they are part of.
        kids = boxes if level == 0 else boxes.withColumn("_of", F.expr("substring(path, 1, length(path) - 1)"))
        front = front.join(_beside(kids), ["shape_id", "_of"] if level else ["shape_id"])
        front = front.withColumns({"_near": _least_distance(*LEAF_BOX, "l2"), "_inside": _most_distance(*LEAF_BOX, "l2") < r * r}).where(F.col("_near") < r * r)
        front = front.withColumn("known", F.col("known") + F.coalesce(F.sum(F.when(F.col("_inside"), F.col("n"))).over(leaf), F.lit(0)))
        front = checkpointed(front.drop("_near", "_of"))
        inside, rest = front.where("_inside").select("shape_id", "q_path", F.col("n").alias("held")), front.where(~F.col("_inside")).drop("_inside")
        if most is not None:
            rest = rest.where(F.col("known") < most)
        crossed = rest.groupBy("shape_id", "path").agg(F.sum("q_n").alias("_crossed"))
        cut = (F.col("n") > LEAF) & _wide(TINY) & ((F.col("_crossed") > CROSSED) | (F.col("n") > HEAVY))
        # The lower end and the parts to a length of each axis, in halves, so that no extent overflows: the work a point is little.
        extent = lambda a: F.col(f"max_{a}") / 2 - F.col(f"min_{a}") / 2
        parts = [c for a in AXES for c in ((F.col(f"min_{a}") / 2).alias(f"_low_{a}"), F.when(extent(a) > TINY, CUT / extent(a)).otherwise(0.0).alias(f"_by_{a}"))]
        cut = checkpointed(boxes.join(crossed, ["shape_id", "path"]).where(cut).select("shape_id", "path", *parts))
        some, at = cut.count(), ["shape_id", "path"]
        table = _beside(cut, some)
        of = table.select(*at)
        done = rest.join(of, at, "left_anti")
        whole, border = (inside, done) if whole is None else (whole.unionByName(inside), border.unionByName(done))
        if not some:
            break
        front = rest.join(of, at).select("shape_id", F.col("path").alias("_of"), "q_path", "q_n", *(f"q_{c}" for c in _BOX), "known")
        i, j, k = (F.least(F.lit(CUT - 1), F.floor((F.col(a) / 2 - F.col(f"_low_{a}")) * F.col(f"_by_{a}")).cast("int")) for a in AXES)
        step = F.char((i * CUT + j) * CUT + k + 48)
        path = F.concat("path", F.when(F.col("_low_x").isNotNull(), step).otherwise("")).alias("path")
        # Written out: a chain of these joins becomes one generated method that is too large for the JIT compiler.
        left, level = checkpointed(left.join(table, at, "left").select("shape_id", *AXES, path)), level + 1
    whole = checkpointed(whole.groupBy("shape_id", "q_path").agg(F.sum("held").alias("hits")))
    border = border.select("shape_id", "q_path", "path", F.col("n").alias("held"), *_BOX)
    if most is not None:
        border = border.join(whole.where(F.col("hits") >= most).select("shape_id", "q_path"), ["shape_id", "q_path"], "left_anti")
    asked = placed.select("shape_id", F.col("path").alias("q_path"), "query")
    # A query's own place may have a leaf inside that its leaf's box has not.
    met = asked.join(border, ["shape_id", "q_path"]).where(_least_distance(_at, _at, "l2") < r * r).withColumn("_inside", _most_distance(_at, _at, "l2") < r * r)
    met = checkpointed(met.select("shape_id", "path", F.col("query.query_id").alias("query_id"), *(_at(a).alias(f"q{a}") for a in AXES), "held", "_inside"))
    sure = asked.join(whole, ["shape_id", "q_path"]).select("shape_id", "query.query_id", "hits").unionByName(met.where("_inside").select("shape_id", "query_id", F.col("held").alias("hits")))
    asking = met.where(~F.col("_inside")).drop("held", "_inside")
    points = left.select("shape_id", "path", *(F.col(a).alias(f"r{a}") for a in AXES))
    pairs = points.join(_beside(asking, most=MET_ROWS), ["shape_id", "path"])
    return sure, pairs.drop("path").withColumn("d2", distance2())


def _struct(df: DataFrame) -> str:
    return df.schema.simpleString()


def adaptive(queries: DataFrame, refs: DataFrame, k: int, metric: str = "l2", bound: float = float("inf")) -> DataFrame:
    """knn() by blocks that follow the density of both sides, of references up to `bound` in the units of d2.

    Queries at one place have the same neighbours, which are found for the first of them.
    """
    place = Window.partitionBy("shape_id", *(f"q{a}" for a in AXES)).orderBy("query_id")
    told = checkpointed(queries.withColumn("_turn", F.row_number().over(place)))
    first, others = told.where("_turn = 1").drop("_turn"), told.where("_turn > 1").drop("_turn")
    found = blocks.nearest(first, checkpointed(_apart(refs, k)), k, metric, bound)
    if others.isEmpty():
        return found
    found = checkpointed(found)
    at = ["shape_id", *(f"q{a}" for a in AXES)]
    theirs = found.select(*(c for c in found.columns if c in at or c not in queries.columns))
    return found.unionByName(others.join(theirs, at).select(*found.columns))


def _few(queries: DataFrame, refs: DataFrame) -> bool:
    """Whether the pairs of queries and references are few, in each shape and altogether."""
    counts = queries.groupBy("shape_id").agg(F.count(F.lit(1)).alias("_q")).join(refs.groupBy("shape_id").agg(F.count(F.lit(1)).alias("_r")), "shape_id")
    largest, total = counts.agg(F.max(F.col("_q") * F.col("_r")), F.sum(F.col("_q").cast("double") * F.col("_r"))).first()
    return (largest or 0) <= DIRECT_PAIRS and (total or 0) <= ALL_PAIRS


def knn(queries: DataFrame, refs: DataFrame, k: int, size: float | None = None, metric: str = "l2") -> DataFrame:
    """Rows of queries (as_queries) with their k nearest of refs (as_refs): d2 and rank from 1 besides all columns of both.

    Fewer rows where a shape has fewer references; points with a coordinate that is null, NaN or infinite take no part.
    Shapes of more than DIRECT_PAIRS pairs, or more than ALL_PAIRS together, go through adaptive(), or over a grid of cells of `size` where that is given.
    """
    queries, refs = finite(queries, "q"), finite(refs, "r")
    if _few(queries, refs):
        return direct(queries, refs, k, metric)
    return adaptive(queries, refs, k, metric) if size is None else grid(queries, refs, k, size, metric)


def among(points: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """knn() of points (shape_id, point_id, x, y, z) among themselves, each its own neighbour too, without places: shape_id, query_id, ref_id, d2, rank.

    A large cloud is moved once for both sides.
    """
    queries, refs = finite(as_queries(points), "q"), finite(as_refs(points), "r")
    found = ["shape_id", "query_id", "ref_id", "d2", "rank"]
    if _few(queries, refs):
        return direct(queries, refs, k, metric).select(*found)
    both = queries.select("shape_id", *(F.col(f"q{a}").cast("double").alias(a) for a in AXES), "query_id", F.col("query_id").alias("ref_id"))
    return blocks.among(stored(both), k, metric).select(*found)


def _hits(sure: DataFrame, pairs: DataFrame, r: float) -> DataFrame:
    """shape_id, query_id, hits of queries with any, from the tables of within()."""
    here = F.col("_here") if "_here" in pairs.columns else F.lit(1).cast("long")
    seen = pairs.where(F.col("d2") < r * r).groupBy("shape_id", "query_id").agg(F.sum(here).alias("hits"))
    return sure.unionByName(seen).groupBy("shape_id", "query_id").agg(F.sum("hits").alias("hits"))


def _by_cells(queries: DataFrame, refs: DataFrame, r: float) -> DataFrame:
    """Pairs strictly within r, by cells of that size: for shapes of bounded size."""
    celled, near = refs, queries
    for a, c in zip(AXES, CELLS, strict=True):
        celled = celled.withColumn(c, F.floor(F.col(f"r{a}") / r))
        at = F.floor(F.col(f"q{a}") / r)
        near = near.withColumn(c, F.explode(F.sequence(at - 1, at + 1)))
    return near.join(celled, ["shape_id", *CELLS]).drop(*CELLS).withColumn("d2", distance2()).where(F.col("d2") < r * r)


def radius(queries: DataFrame, refs: DataFrame, r: float, most: int) -> DataFrame:
    """At most `most` nearest references strictly within r of each query, with d2, rank and hits, the number of all within r.

    Points without a place take no part. Large shapes, or very many, go through blocks and trees, in which hits are counted by whole nodes.
    """
    queries, refs = finite(queries, "q"), finite(refs, "r")
    if not _few(queries, refs):
        found = adaptive(queries, refs, most, bound=r * r).where(F.col("d2") < r * r)
        return found.join(_hits(*within(queries, refs, r), r), ["shape_id", "query_id"])
    places = refs.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_here"), F.min("ref_id").alias("_first"))
    pairs = _by_cells(queries, _apart(refs, most).join(places, list(PLACE)), r)
    whole = Window.partitionBy("shape_id", "query_id")
    hits = F.sum(F.when(F.col("ref_id") == F.col("_first"), F.col("_here")).otherwise(0)).over(whole)
    return _nearest(pairs.withColumn("hits", hits).drop("_here", "_first"), most)


def radius_count(queries: DataFrame, refs: DataFrame, r: float, most: int) -> DataFrame:
    """hits: references strictly within r of each query, at most `most`; queries without any, or without a place, have 0."""
    asked, refs = finite(queries, "q"), finite(refs, "r")
    if not _few(asked, refs):
        sure, pairs = within(asked, refs, r, most)
    else:
        pairs = _by_cells(asked, _places(refs), r)
        sure = pairs.where(F.lit(False)).select("shape_id", "query_id", F.col("_here").alias("hits"))
    hits = F.least(F.coalesce("hits", F.lit(0)), F.lit(most)).cast("long").alias("hits")
    return queries.select("shape_id", "query_id").join(_hits(sure, pairs, r), ["shape_id", "query_id"], "left").select("shape_id", "query_id", hits)


def spacing(points: DataFrame, k: int) -> DataFrame:
    """shape_id, point_id, spacing: the mean distance to the k nearest points, the point itself included."""
    found = knn(as_queries(points), as_refs(points), k)
    return found.groupBy("shape_id", F.col("query_id").alias("point_id")).agg(F.avg(F.sqrt("d2")).alias("spacing"))


def nearest_colour(queries: DataFrame, points: DataFrame) -> DataFrame:
    """query_id and the colour of the nearest point."""
    found = knn(as_queries(queries), as_refs(points, "r", "g", "b"), 1)
    return found.select("shape_id", "query_id", F.col("r_r").alias("r"), F.col("r_g").alias("g"), F.col("r_b").alias("b"))
