"""Crops: fixed, many and random boxes, radius, and shapes that are nearly empty."""

from __future__ import annotations

import functools
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.vec import Vec
from ..sources.storage import checkpointed
from .ranks import SMALL_ROWS, with_group

AXES = ("x", "y", "z")
#: The largest exponent of a cell's length, and the largest double.
LEVELS, MOST = 1023, sys.float_info.max


def bounds(points: DataFrame, keys: Sequence[str] = ("shape_id",)) -> DataFrame:
    """min_*, max_* of each shape."""
    return points.groupBy(*keys).agg(*(F.min(a).alias(f"min_{a}") for a in AXES), *(F.max(a).alias(f"max_{a}") for a in AXES))


def crop_box(points: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Points strictly inside a box. The comparisons are pushed down to the scan."""
    inside = F.lit(True)
    for axis, a, b in zip(AXES, low, high, strict=True):
        inside = inside & (F.col(axis) > a) & (F.col(axis) < b)
    return points.where(inside)


def crop_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points strictly inside each box (box_id, min_*, max_*); a point may be in several.

    A box is given to the cells that it touches of a grid whose cells are as long as its longest side or up to twice, a
    power of two: two on an axis, so eight, whatever its size. Points are keyed once for each of the sizes in use and
    joined on the cell, never compared with all boxes. Points in no box are dropped, as those without a place are; boxes
    without an inside, or with a bound that is null or no number, hold none, and infinite bounds are taken as such.
    """
    sane = functools.reduce(lambda x, y: x & y, ((F.col(f"max_{a}") > F.col(f"min_{a}")) & ~F.isnan(f"max_{a}") for a in AXES))
    side = F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in AXES))
    level = F.greatest(F.lit(-1000), F.least(F.lit(LEVELS), F.ceil(F.log2(F.greatest(side, F.lit(1e-300)))))).cast("int")
    spread = boxes.where(sane).select("box_id", *(f"{s}_{a}" for s in ("min", "max") for a in AXES), level.alias("_level"))
    for axis, name in zip(AXES, "ijk", strict=True):
        low, high = (_cell(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col(f"{s}_{axis}")))) for s in ("min", "max"))
        spread = spread.withColumn(f"_{name}", F.explode(F.sequence(low, high)))
    spread = checkpointed(spread)
    # No more sizes than exponents of a double: 2024 at most, one or two as a rule.
    levels = [r[0] for r in spread.select("_level").distinct().collect()]
    celled = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    small = spread.count() <= SMALL_ROWS
    keyed = celled.select("*", *(_cell(F.col(a)).alias(f"_{n}") for a, n in zip(AXES, "ijk", strict=True)))
    joined = keyed.join(F.broadcast(spread) if small else spread, ["_level", "_i", "_j", "_k"])
    for axis in AXES:
        joined = joined.where((F.col(axis) > F.col(f"min_{axis}")) & (F.col(axis) < F.col(f"max_{axis}")))
    return joined.select("box_id", *points.columns)


def _cell(place):
    """The cell of a place on an axis at a row's _level. Cells beyond a long are one, for points and boxes alike."""
    return F.floor(place * F.pow(F.lit(2.0), -F.col("_level")))


def random_boxes(points: DataFrame, min_l: float, max_l: float, low_ratio: float, seed: int | str = 0, tries: int = 20) -> DataFrame:
    """For each shape the box that crop_random() takes: shape_id, low_*, high_*, ratio, proposal.

    A seed may be a column of points, such as draw of mixing.mix_epochs(): each shape then has a box for each of its seeds.

    Proposals have a uniform centre and uniform sides in the shape's bounds, padded by a tenth of the
    extent, and are shifted to lie inside them, or clipped if larger. The first that holds low_ratio of
    the points is taken, otherwise the fullest.
    """
    keys = _keys(seed)
    own = F.col(seed) if isinstance(seed, str) else seed
    box = bounds(points, keys).withColumn("proposal", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    for a in AXES:
        pad = (F.col(f"max_{a}") - F.col(f"min_{a}")) * 0.1
        low, high = F.col(f"min_{a}") - pad, F.col(f"max_{a}") + pad
        centre = rng.between(low, high, own, f"crop.centre.{a}", "shape_id", "proposal")
        side = F.least(rng.between(F.lit(min_l), F.lit(max_l), own, f"crop.side.{a}", "shape_id", "proposal"), high - low)
        start = F.least(F.greatest(centre - side / 2.0, low), high - side)
        box = box.withColumn(f"low_{a}", start).withColumn(f"high_{a}", start + side)
    sides = [*(f"low_{a}" for a in AXES), *(f"high_{a}" for a in AXES)]
    boxes = checkpointed(box.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("proposal", *sides))).alias("_boxes")))

    def inside(box):
        return functools.reduce(lambda x, y: x & y, ((F.col(a) > box[f"low_{a}"]) & (F.col(a) < box[f"high_{a}"]) for a in AXES))

    # A point meets all of its shape's proposals in one row, and a row of counts a shape is all that moves.
    counts = with_group(points.select(*keys, *AXES), boxes, *keys).groupBy(*keys).agg(
        F.array(*(F.sum(inside(F.col("_boxes")[i]).cast("long")) for i in range(tries))).alias("_in"), F.count(F.lit(1)).alias("_all")
    ).join(boxes, list(keys))
    ratio = lambda b: F.col("_in")[b["proposal"]] / F.col("_all")
    told = F.transform("_boxes", lambda b: F.struct((ratio(b) < low_ratio).alias("short"), F.when(ratio(b) < low_ratio, -ratio(b)).otherwise(0.0).alias("worse"), b["proposal"].alias("proposal"), ratio(b).alias("ratio"), *(b[s].alias(s) for s in sides)))
    return counts.select(*keys, F.array_min(told).alias("_best")).select(*keys, *(F.col("_best")[c].alias(c) for c in ("proposal", "ratio", *sides)))


def _keys(seed: int | str) -> tuple[str, ...]:
    return ("shape_id", seed) if isinstance(seed, str) else ("shape_id",)


def crop_random(points: DataFrame, min_l: float, max_l: float, low_ratio: float, seed: int | str = 0) -> DataFrame:
    """Points strictly inside their shape's random box; a shape whose boxes are all empty loses all its points."""
    box = random_boxes(points, min_l, max_l, low_ratio, seed)
    joined = with_group(points, box, *_keys(seed))
    for a in AXES:
        joined = joined.where((F.col(a) > F.col(f"low_{a}")) & (F.col(a) < F.col(f"high_{a}")))
    return joined.select(*points.columns)


def radius_filter(points: DataFrame, radius: float) -> DataFrame:
    """Points nearer than radius to the middle of their shape's bounds."""
    box = bounds(points)
    mid = Vec(*((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2.0 for a in AXES))
    return with_group(points, box, "shape_id").where((Vec.of() - mid).norm() < radius).select(*points.columns)


def empty_shapes(points: DataFrame, shapes: DataFrame, least: int = 64) -> DataFrame:
    """shape_id, n of those of `shapes` with fewer than `least` points, 0 included."""
    counts = points.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n"))
    return with_group(shapes.select("shape_id").distinct(), counts, "shape_id", how="left").select("shape_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where(F.col("n") < least)
