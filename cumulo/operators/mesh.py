"""Triangle meshes as rows (shape_id, face_id, and corners ax..cz): areas and uniform samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.vec import Vec
from ..sources.storage import checkpointed
from .ranks import running_sum, with_group


def from_tables(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Corners of faces (shape_id, face_id, a, b, c), whose vertices are (shape_id, vertex_id, x, y, z)."""
    for corner in "abc":
        named = vertices.select("shape_id", F.col("vertex_id").alias(corner), *(F.col(axis).alias(f"{corner}{axis}") for axis in "xyz"))
        faces = faces.join(named, ["shape_id", corner])
    return faces.drop("a", "b", "c")


def placed(vertices: DataFrame, scale: float, loc: tuple[float, float, float]) -> DataFrame:
    """Vertices over scale, less loc over scale."""
    return vertices.withColumns({axis: F.col(axis) / scale - shift / scale for axis, shift in zip("xyz", loc, strict=True)})


def _normal() -> Vec:
    a, b, c = (Vec.of(corner) for corner in "abc")
    return (b - a).cross(c - a)


def areas(triangles: DataFrame) -> DataFrame:
    """shape_id, face_id, area and the unit normal; a face without area has a null normal."""
    return triangles.select("shape_id", "face_id", (_normal().norm() / 2.0).alias("area"), *(c.alias(n) for n, c in _normal().unit().named("n").items()))


def sample(triangles: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points of each shape, uniform by area: shape_id, draw, face_id, x, y, z.

    Faces lie one after the other by area, and draws fall between them. Both are keyed by stretches of a
    face's mean area, of which a face covers as many as it has area for. Shapes without area have none.
    """
    sized = triangles.select("shape_id", "face_id", (_normal().norm() / 2.0).alias("_area")).where("_area > 0")
    sized = checkpointed(running_sum(sized, ["shape_id"], ["face_id"], "_area", "_at").withColumn("_end", F.col("_at") + F.col("_area")))
    whole = sized.groupBy("shape_id").agg(F.max("_end").alias("_all"), (F.max("_end") / F.count(F.lit(1))).alias("_wide"), F.max_by("face_id", "_end").alias("_last"))
    stretch = lambda at: F.floor(F.col(at) / F.col("_wide"))
    faces = with_group(sized, whole.select("shape_id", "_wide"), "shape_id").withColumn("_key", F.explode(F.sequence(stretch("_at"), stretch("_end"))))
    draws = whole.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_draw", rng.uniform(seed, "mesh", "shape_id", "draw") * F.col("_all"))
    met = draws.withColumn("_key", stretch("_draw")).join(faces.select("shape_id", "_key", "face_id", "_at", "_end"), ["shape_id", "_key"], "left").where("_draw >= _at and _draw < _end")
    # Sums of areas may differ in their last bits between blocks: a draw that falls between two faces goes to the later one.
    picks = met.groupBy("shape_id", "draw").agg(F.max("face_id").alias("face_id"))
    root = F.sqrt(rng.uniform(seed, "mesh.r", "shape_id", "draw"))
    turn = rng.uniform(seed, "mesh.t", "shape_id", "draw")
    a, b, c = (Vec.of(corner) for corner in "abc")
    point = a * (1.0 - root) + b * (root * (1.0 - turn)) + c * (root * turn)
    return picks.join(triangles, ["shape_id", "face_id"]).select("shape_id", "draw", "face_id", *(v.alias(axis) for axis, v in point.named().items()))
