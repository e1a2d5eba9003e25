"""Affine transforms of positions, normals and sensor positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.vec import Vec
from .crop import AXES, bounds
from .ranks import with_group

Matrix = Sequence[Sequence[float]]


def _put(points: DataFrame, groups: dict[str, Vec]) -> DataFrame:
    """points with the vectors of each prefix replaced, where it has them."""
    new = {n: c for prefix, v in groups.items() for n, c in v.named(prefix).items() if n in points.columns}
    return points.withColumns(new)


def scale_fixed(points: DataFrame, factor: float) -> DataFrame:
    """Positions and sensor positions times factor."""
    return _put(points, {"": Vec.of() * factor, "s": Vec.of("s") * factor})


def _with_bounds(points: DataFrame, frame: DataFrame | None) -> DataFrame:
    return with_group(points, bounds(points if frame is None else frame), "shape_id")


def _middle() -> Vec:
    return Vec(*((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2.0 for a in AXES))


def bound_scale(points: DataFrame, min_a: float, max_a: float, frame: DataFrame | None = None) -> DataFrame:
    """Centred on the middle of the shape's bounds and scaled so that the larger half-extent lies in [min_a, max_a].

    `frame` gives the bounds if not points itself. A shape without extent keeps its size.
    """
    rows = _with_bounds(points, frame)
    half = F.greatest(*((F.col(f"max_{a}") - F.col(f"min_{a}")) / 2.0 for a in AXES))
    factor = F.coalesce(F.try_divide(F.greatest(F.lit(min_a), F.least(half, F.lit(max_a))), half), F.lit(1.0))
    return _put(rows, {p: (Vec.of(p) - _middle()) * factor for p in ("", "s")}).select(*points.columns)


def centralize(points: DataFrame, noise: float = 0.0, seed: int = 0, frame: DataFrame | None = None) -> DataFrame:
    """Centred on the middle of the shape's bounds, off by up to `noise` of the extent to either side on each axis."""
    rows = _with_bounds(points, frame)
    shift = Vec(*((F.col(f"max_{a}") - F.col(f"min_{a}")) * noise * (rng.uniform(seed, f"centre.{a}", "shape_id") * 2.0 - 1.0) for a in AXES)) if noise else Vec.lit(0, 0, 0)
    return _put(rows, {p: Vec.of(p) - (_middle() + shift) for p in ("", "s")}).select(*points.columns)


def rotation(axis: str, angle: Column) -> list[list[Column]]:
    """The matrix of a turn by `angle` radians about an axis."""
    c, s, one, zero = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return {"x": [[one, zero, zero], [zero, c, -s], [zero, s, c]], "y": [[c, zero, s], [zero, one, zero], [-s, zero, c]], "z": [[c, -s, zero], [s, c, zero], [zero, zero, one]]}[axis]


def _times(matrix, v: Vec) -> Vec:
    return Vec(*(row[0] * v.x + row[1] * v.y + row[2] * v.z for row in matrix))


def rotate_axis(points: DataFrame, axis: str, deg_min: float, deg_max: float, seed: int = 0) -> DataFrame:
    """Positions, sensor positions and normals turned about an axis by an angle drawn for each shape."""
    matrix = rotation(axis, rng.between(F.lit(deg_min), F.lit(deg_max), seed, f"rotate.{axis}", "shape_id") * (math.pi / 180.0))
    return _put(points, {p: _times(matrix, Vec.of(p)) for p in ("", "s", "n")})


def similarity(points: DataFrame, turn: Matrix, shift: Sequence[float], factor: float = 1.0) -> DataFrame:
    """factor * (turn * p + shift) for positions; normals are turned only."""
    matrix = [[F.lit(float(v)) for v in row] for row in turn]
    at = {p: (_times(matrix, Vec.of(p)) + Vec.lit(*shift)) * factor for p in ("", "s")}
    return _put(points, at | {"n": _times(matrix, Vec.of("n"))})


def similarity_4x4(points: DataFrame, matrix: Matrix) -> DataFrame:
    """A 4 x 4 similarity: positions by all of it, normals by its rotation alone."""
    factor = math.sqrt(sum(matrix[0][j] ** 2 for j in range(3)))
    turn = [[matrix[i][j] / factor for j in range(3)] for i in range(3)]
    return similarity(points, turn, [matrix[i][3] / factor for i in range(3)], factor)


def inverse_4x4(matrix: Matrix) -> list[list[float]]:
    """The inverse of a 4 x 4 similarity."""
    square = sum(matrix[0][j] ** 2 for j in range(3))
    turned = [[matrix[j][i] / square for j in range(3)] for i in range(3)]
    shift = [-sum(turned[i][j] * matrix[j][3] for j in range(3)) for i in range(3)]
    return [[*turned[i], shift[i]] for i in range(3)] + [[0.0, 0.0, 0.0, 1.0]]


def transform_bounds(meta: DataFrame, turn: Matrix, shift: Sequence[float], factor: float) -> DataFrame:
    """A volume's bounds under factor * (b + shift). A lattice can't be turned: any rotation but none is refused."""
    if any(abs(turn[i][j] - (i == j)) > 1e-12 for i in range(3) for j in range(3)):
        raise ValueError("a volume can't be rotated")
    return meta.withColumns({f"{end}_{a}": (F.col(f"{end}_{a}") + s) * factor for end in ("min", "max") for a, s in zip(AXES, shift, strict=True)})


def view_direction(points: DataFrame) -> DataFrame:
    """vx, vy, vz: the unit direction to the sensor, over the distance plus 1e-6."""
    return points.withColumns((Vec.of("s") - Vec.of()).unit(1e-6).named("v"))


def face_sensor(points: DataFrame, steepest_deg: float = 85.0) -> DataFrame:
    """Normals turned towards the sensor; points seen at a grazing angle, over steepest_deg, are dropped."""
    cosine = Vec.of("v").dot(Vec.of("n").unit())
    rows = view_direction(points).withColumn("_cos", cosine).where(F.abs("_cos") > math.cos(math.radians(steepest_deg)))
    return rows.withColumns({n: F.when(F.col("_cos") < 0, -F.col(n)).otherwise(F.col(n)) for n in ("nx", "ny", "nz")}).select(*points.columns)
