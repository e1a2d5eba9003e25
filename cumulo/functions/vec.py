"""Vectors of three columns, and scalar helpers with the semantics that the operators need.

Everything is a Column expression, so chains of these stay inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | float | str) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(float(value))


@dataclass(frozen=True)
class Vec:
    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, prefix: str = "", alias: str = "") -> Vec:
        """The columns {prefix}x, {prefix}y, {prefix}z, of the table `alias` if given."""
        dot = f"{alias}." if alias else ""
        return cls(*(F.col(f"{dot}{prefix}{axis}") for axis in "xyz"))

    @classmethod
    def lit(cls, x: float, y: float, z: float) -> Vec:
        return cls(_column(x), _column(y), _column(z))

    def parts(self) -> tuple[Column, Column, Column]:
        return self.x, self.y, self.z

    def _each(self, other, op) -> Vec:
        parts = other.parts() if isinstance(other, Vec) else (_column(other),) * 3
        return Vec(*(op(a, b) for a, b in zip(self.parts(), parts, strict=True)))

    def __add__(self, other) -> Vec:
        return self._each(other, lambda a, b: a + b)

    def __sub__(self, other) -> Vec:
        return self._each(other, lambda a, b: a - b)

    def __mul__(self, other) -> Vec:
        return self._each(other, lambda a, b: a * b)

    def __truediv__(self, other) -> Vec:
        """Null where the divisor is 0."""
        return self._each(other, lambda a, b: F.try_divide(a, b))

    def __neg__(self) -> Vec:
        return Vec(*(-a for a in self.parts()))

    def map(self, op) -> Vec:
        return Vec(*map(op, self.parts()))

    def least(self, other) -> Vec:
        return self._each(other, F.least)

    def greatest(self, other) -> Vec:
        return self._each(other, F.greatest)

    def dot(self, other: Vec) -> Column:
        return self.x * other.x + self.y * other.y + self.z * other.z

    def cross(self, other: Vec) -> Vec:
        return Vec(self.y * other.z - self.z * other.y, self.z * other.x - self.x * other.z, self.x * other.y - self.y * other.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self, epsilon: float = 0.0) -> Vec:
        """Over the norm plus epsilon; null for a zero vector without one."""
        return self / (self.norm() + epsilon if epsilon else self.norm())

    def reflect(self, normal: Vec) -> Vec:
        return self - normal * (normal.dot(self) * 2.0)

    def named(self, prefix: str = "") -> dict[str, Column]:
        return {f"{prefix}{axis}": part for axis, part in zip("xyz", self.parts(), strict=True)}


def clamp(value, low, high) -> Column:
    return F.greatest(_column(low), F.least(_column(value), _column(high)))


def lerp(a, b, t) -> Column:
    return _column(a) + _column(t) * (_column(b) - _column(a))


def frac(value) -> Column:
    return _column(value) - F.floor(_column(value))


def fmod(value, by) -> Column:
    """The remainder with the sign of the value, as a division that is cut off leaves it."""
    return _column(value) % _column(by)


def sign(value) -> Column:
    """1 above 0, else -1: 0 counts as negative."""
    return F.when(_column(value) > 0, 1.0).otherwise(-1.0)


def smoothstep(low, high, value) -> Column:
    y = clamp((_column(value) - _column(low)) / (_column(high) - _column(low)), 0.0, 1.0)
    return y * y * (3.0 - 2.0 * y)


def cell(value, size: float) -> Column:
    """Index of a value's cell: floor of the quotient."""
    return F.floor(_column(value) / size).cast("long")


def cell_by_remainder(value, size: float) -> Column:
    """Index by floor division, which at multiples of size may be one less than cell()."""
    v = _column(value)
    return F.round((v - F.pmod(v, F.lit(size))) / size).cast("long")


def nan_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(float("nan")))
