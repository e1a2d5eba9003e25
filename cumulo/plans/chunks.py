"""Functions of whole clouds, run by overlapping chunks: a large scene's core pieces, each with a halo of its surroundings.

A chunk goes to the function as a shape of its own, so that one call does all of them and Spark deals them out.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import knn
from ..operators.crop import AXES
from ..operators.normals import oriented


def _cell(place: Column, size: float) -> Column:
    return F.floor(place / size)


def split(points: DataFrame, size: float, halo: float) -> DataFrame:
    """points once for each chunk that has them: shape_id is `<shape>#<i>,<j>,<k>`, in_core tells a chunk's own from its halo.

    Cores are cubes of `size`; a chunk has what lies within `halo` of its core on each axis, so a point is in (1 + 2 halo / size)^3
    chunks on the average, and in the core of one. Points without a place are in none.
    """
    if size <= 0 or halo < 0:
        raise ValueError("a chunk needs a size, and a halo that is not negative")
    rows = knn.finite(points, "")
    own = []
    for n, a in enumerate(AXES):
        rows = rows.withColumn(f"_c{n}", F.explode(F.sequence(_cell(F.col(a) - halo, size), _cell(F.col(a) + halo, size))))
        own.append(F.col(f"_c{n}") == _cell(F.col(a), size))
    name = F.concat("shape_id", F.lit("#"), F.concat_ws(",", *(F.col(f"_c{n}").cast("string") for n in range(3))))
    return rows.select(*(c if c != "shape_id" else name.alias(c) for c in points.columns), functools.reduce(lambda x, y: x & y, own).alias("in_core"))


def by_chunks(points: DataFrame, run: Callable[[DataFrame], DataFrame], size: float, halo: float) -> DataFrame:
    """What `run` gives for the chunks of points, of each chunk the rows of its core's points alone.

    run() takes the rows of split() and returns rows with shape_id and point_id; it may drop rows and add columns. Where it hands in_core on,
    that tells the core's rows, otherwise they are looked up by shape_id and point_id.
    """
    parts = split(points, size, halo)
    found = run(parts)
    if "in_core" in found.columns:
        found = found.where("in_core").drop("in_core")
    else:
        found = found.join(parts.where("in_core").select("shape_id", "point_id"), ["shape_id", "point_id"], "left_semi")
    return found.withColumn("shape_id", F.regexp_replace("shape_id", "#[^#]*$", ""))


def room(size: float, halo: float, prefix: str = "") -> Column:
    """How far a point can see in the chunk of its core: the distance to the nearest face of core and halo."""
    sides = []
    for a in AXES:
        place = F.col(f"{prefix}{a}")
        low = _cell(place, size) * F.lit(float(size))
        sides += [place - (low - halo), low + (size + halo) - place]
    return F.least(*sides)


def neighbourhoods(points: DataFrame, k: int, size: float, halo: float) -> DataFrame:
    """shape_id, point_id, spacing, whole: spacing among the k nearest in the point's chunk, itself included, and whether they are the k nearest of all.

    They are where the k-th lies nearer than the chunk's faces. Where the chunk has fewer, or the k-th is farther, whole is false and a wider halo is due.
    """

    def run(chunk: DataFrame) -> DataFrame:
        found = knn.knn(knn.as_queries(chunk.where("in_core")), knn.as_refs(chunk), k)
        told = found.groupBy("shape_id", F.col("query_id").alias("point_id"), *(f"q{a}" for a in AXES))
        told = told.agg(F.avg(F.sqrt("d2")).alias("spacing"), F.count(F.lit(1)).alias("n"), F.sqrt(F.max("d2")).alias("far"))
        return told.select("shape_id", "point_id", "spacing", ((F.col("n") == k) & (F.col("far") < room(size, halo, "q"))).alias("whole"), F.lit(True).alias("in_core"))

    return by_chunks(points, run, size, halo)


def oriented_by_chunks(points: DataFrame, size: float, halo: float, k: int = 64, steepest_deg: float = 85.0) -> DataFrame:
    """normals.oriented() by chunks, with whole: whether a point's normal is the one that the whole scene gives."""
    found = by_chunks(points, lambda chunk: oriented(chunk, k, steepest_deg), size, halo)
    return found.join(neighbourhoods(points, k, size, halo).select("shape_id", "point_id", "whole"), ["shape_id", "point_id"])
