"""Sampling, noise and density. Every draw is a function of seed and keys, so results don't depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.vec import Vec, cell, cell_by_remainder
from .crop import AXES
from .ranks import by_digest, with_group


def ranked(points: DataFrame, seed: int, op: str) -> DataFrame:
    """rank: the place of each point in its shape's random order, from 1."""
    return by_digest(points, ["shape_id"], rng.digest(seed, op, "shape_id", "point_id"), "point_id", "rank")


def subsample(points: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most `most` points of each shape, drawn without replacement. The limit is applied before rows move, too."""
    order = Window.partitionBy("shape_id").orderBy(rng.digest(seed, "subsample", "shape_id", "point_id"), "point_id")
    return points.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def _drawn(points: DataFrame, draws: DataFrame, seed: int, op: str, counts: DataFrame) -> DataFrame:
    """Points for draws (shape_id, draw) with replacement: each picks one of the shape's n points."""
    picks = with_group(draws, counts, "shape_id").withColumn("rank", F.floor(rng.uniform(seed, op, "shape_id", "draw") * F.col("n")) + 1).drop("n")
    return picks.join(ranked(points, seed, f"{op}.order"), ["shape_id", "rank"]).drop("rank")


def _counts(points: DataFrame) -> DataFrame:
    return points.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n"))


def _numbers(counts: DataFrame, how_many: Column) -> DataFrame:
    """shape_id, draw: 0 to how_many - 1 for each shape where that is positive."""
    return counts.where(how_many > 0).select("shape_id", F.explode(F.sequence(F.lit(0).cast("long"), how_many.cast("long") - 1)).alias("draw"))


def resize(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows of each shape: a sample of larger ones, all of smaller ones and repeats drawn with replacement. copy: 0, or the repeat's number from 1."""
    counts = _counts(points)
    more = _drawn(points, _numbers(counts, n - F.col("n")), seed, "resize", counts).withColumn("copy", F.col("draw") + 1).drop("draw")
    return subsample(points, n, seed).withColumn("copy", F.lit(0).cast("long")).unionByName(more)


def bound_size(points: DataFrame, most: int, least: int | None = None, seed: int = 0) -> DataFrame:
    """Shapes of fewer than `least` points filled up to it, those of more than `most` sampled, others as they are."""
    counts = _counts(points)
    held = subsample(points, most, seed).withColumn("copy", F.lit(0).cast("long"))
    if not least:
        return held
    more = _drawn(points, _numbers(counts, least - F.col("n")), seed, "resize", counts).withColumn("copy", F.col("draw") + 1).drop("draw")
    return held.unionByName(more)


def jitter(points: DataFrame, deviation: float, seed: int = 0) -> DataFrame:
    """Gaussian noise on positions; none is no operation."""
    if not deviation:
        return points
    return points.withColumns({a: F.col(a) + deviation * rng.normal(seed, f"jitter.{a}", "shape_id", "point_id") for a in AXES})


def outliers(points: DataFrame, ratio: float, seed: int = 0, reach: float = 0.55) -> DataFrame:
    """int(n * ratio) draws with replacement name points of each shape that become outliers.

    Those get a uniform position within reach of the origin on each axis, a random unit normal and a random colour.
    """
    if not ratio:
        return points
    counts = _counts(points)
    picks = with_group(_numbers(counts, F.floor(F.col("n") * ratio)), counts, "shape_id")
    picks = picks.select("shape_id", (F.floor(rng.uniform(seed, "outlier", "shape_id", "draw") * F.col("n")) + 1).alias("rank")).distinct().withColumn("_out", F.lit(True))
    rows = ranked(points, seed, "outlier.order").join(picks, ["shape_id", "rank"], "left")
    draw = lambda name: rng.uniform(seed, f"outlier.{name}", "shape_id", "point_id")
    height, turn = draw("h") * 2.0 - 1.0, draw("t") * (2.0 * math.pi)
    flat = F.sqrt(F.greatest(F.lit(0.0), 1.0 - height * height))
    new = {a: (draw(a) * 2.0 - 1.0) * reach for a in AXES} | {"nx": flat * F.cos(turn), "ny": flat * F.sin(turn), "nz": height} | {c: draw(c) for c in "rgb"}
    return rows.withColumns({n: F.when(F.col("_out"), c).otherwise(F.col(n)) for n, c in new.items() if n in points.columns}).select(*points.columns)


def density(points: DataFrame, size: float, by_remainder: bool = False) -> DataFrame:
    """shape_id, n, cells, density: points for each occupied cell of a shape.

    by_remainder takes a cell's index by floor division instead of the floor of the quotient.
    """
    index = cell_by_remainder if by_remainder else cell
    # Cells are counted up before the distinct ones are: two small aggregations, no list of cells.
    cells = points.groupBy("shape_id", *(index(a, size).alias(n) for a, n in zip(AXES, "ijk", strict=True))).agg(F.count(F.lit(1)).alias("_n"))
    return cells.groupBy("shape_id").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("cells")).withColumn("density", F.col("n") / F.col("cells"))


def voxels(points: DataFrame, size: float) -> DataFrame:
    """Distinct occupied cells: shape_id, i, j, k."""
    return points.select("shape_id", *(cell(a, size).alias(n) for a, n in zip(AXES, "ijk", strict=True))).distinct()


def density_rescale(points: DataFrame, size: float, low: float, high: float, seed: int = 0) -> DataFrame:
    """Scaled by sqrt(density / target), the target drawn for each shape from [low, high]."""
    target = rng.between(F.lit(low), F.lit(high), seed, "density", "shape_id")
    factors = density(points, size).select("shape_id", F.sqrt(F.col("density") / target).alias("_factor"))
    rows = with_group(points, factors, "shape_id")
    return rows.withColumns({n: F.col(n) * F.col("_factor") for p in ("", "s") for n in (f"{p}{a}" for a in AXES) if n in points.columns}).select(*points.columns)


def density_subsample(points: DataFrame, size: float, low: float, high: float, seed: int = 0) -> DataFrame:
    """Sampled to a density drawn from [min(current, low), min(current, high)]."""
    now = F.col("density")
    target = rng.between(F.least(now, F.lit(low)), F.least(now, F.lit(high)), seed, "density", "shape_id")
    sizes = density(points, size).select("shape_id", F.bround(F.col("n") / now * target).cast("long").alias("_most"))
    return with_group(ranked(points, seed, "subsample"), sizes, "shape_id").where(F.col("rank") <= F.col("_most")).select(*points.columns)


def band_samples(points: DataFrame, n: int, spread: float, seed: int = 0) -> DataFrame:
    """n draws of each shape's points with replacement, displaced along the normal by a normal draw times spread."""
    counts = _counts(points)
    rows = _drawn(points, _numbers(counts, F.lit(n)), seed, "band", counts)
    moved = Vec.of() + Vec.of("n") * (rng.normal(seed, "band.step", "shape_id", "draw") * spread)
    return rows.select("shape_id", "draw", "point_id", *(c.alias(a) for a, c in moved.named().items()))


def surface_subsample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement of shapes with more points; others as they are, with draw = point_id."""
    counts = _counts(points)
    many = counts.where(F.col("n") > n)
    drawn = _drawn(points, _numbers(many, F.lit(n)), seed, "surface", counts)
    rest = with_group(points, many.select("shape_id"), "shape_id", how="left_anti").withColumn("draw", F.col("point_id"))
    return drawn.unionByName(rest) if n > 0 else points.withColumn("draw", F.col("point_id"))


def expand(cells: DataFrame, edge: int) -> DataFrame:
    """Cells within a neighbourhood of `edge` cells a side, distinct: 3 gives -1 to 1, 4 gives -1 to 2."""
    low, high = -(edge // 2) + (1 if edge % 2 == 0 else 0), edge // 2
    for n in "ijk":
        cells = cells.withColumn(n, F.explode(F.sequence(F.col(n) + low, F.col(n) + high)))
    return cells.distinct()


def voxel_samples(points: DataFrame, size: float, n: int, edge: int = 0, seed: int = 0) -> DataFrame:
    """n uniform samples of each shape on its occupied cells, after expand() if edge >= 3."""
    cells = voxels(points, size)
    cells = expand(cells, edge) if edge >= 3 else cells
    cells = cells.withColumn("point_id", F.concat_ws(",", "i", "j", "k"))
    counts = _counts(cells)
    rows = _drawn(cells, _numbers(counts, F.lit(n)), seed, "voxel", counts)
    at = {a: (F.col(i) + rng.uniform(seed, f"voxel.{a}", "shape_id", "draw")) * size for a, i in zip(AXES, "ijk", strict=True)}
    return rows.select("shape_id", "draw", *(c.alias(a) for a, c in at.items()))


def schedule(steps: DataFrame, start: float, end: float, seed: int = 0) -> DataFrame:
    """p rises from 0 to 1 between the steps start and end; taken: a draw below it."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("step") - start) / (end - start)))
    return steps.withColumn("p", p).withColumn("taken", rng.uniform(seed, "schedule", "step") < p)
