"""Dense volumes as rows (shape_id, i, j, k, val), with bounds and sizes beside them; missing rows are unknown."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crop import AXES
from .ranks import with_group

INDEX = ("i", "j", "k")


@dataclass(frozen=True)
class Lattice:
    """Corner-aligned: the first and last cells' values stand at the bounds."""

    low: Sequence[float]
    high: Sequence[float]
    n: Sequence[int]

    def __post_init__(self):
        if any(a >= b for a, b in zip(self.low, self.high, strict=True)):
            raise ValueError("bounds must rise")

    def ticks(self, axis: int) -> list[float]:
        step = (self.high[axis] - self.low[axis]) / max(1, self.n[axis] - 1)
        return [self.low[axis] + step * i for i in range(self.n[axis])]


def centres(cells: DataFrame, size: float, low: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """cells (i, j, k, ...) with x, y, z, the middle of each cell of a grid that starts at `low`."""
    return cells.withColumns({a: (F.col(n) + 0.5) * size + float(v) for a, n, v in zip(AXES, INDEX, low, strict=True)})


def with_cells(rows: DataFrame, *levels: DataFrame) -> DataFrame:
    """rows of shapes that have a cell (shape_id) at one level at least; those whose grids are empty at every level are dropped."""
    held = functools.reduce(lambda x, y: x.unionByName(y), (level.select("shape_id") for level in levels)).distinct()
    return with_group(rows, held, "shape_id", how="left_semi")


def lattice_of(lattice: Lattice) -> dict[str, Column]:
    """The columns of a lattice table that hold for all shapes alike."""
    sides = {f"{side}_{a}": F.lit(float(v)) for side, corner in (("min", lattice.low), ("max", lattice.high)) for a, v in zip(AXES, corner, strict=True)}
    return sides | {f"cells_{a}": F.lit(int(n)) for a, n in zip(AXES, lattice.n, strict=True)}


LATTICE = [*(f"{side}_{a}" for side in ("min", "max") for a in AXES), *(f"cells_{a}" for a in AXES)]


def classify(queries: DataFrame, volume: DataFrame, lattice: Lattice | DataFrame, band: float = 1.0) -> DataFrame:
    """kind: 2 outside the box (its faces are inside) or where the nearest cell is unknown, 0 within band of the surface, else 1.

    `lattice` is one for all shapes, or a table with each shape's own (shape_id, min_*, max_*, cells_*, as files.read_lattices()
    gives it); a shape without one is outside. Cells are broadcast where they are counted to be few, so that the many points
    of a cell don't meet.
    """
    if isinstance(lattice, Lattice):
        told = lattice_of(lattice)
        rows = queries.withColumns({f"_{c}": told[c] for c in LATTICE})
    else:
        rows = with_group(queries, lattice.select("shape_id", *(F.col(c).alias(f"_{c}") for c in LATTICE)), "shape_id", how="left")
    inside = F.lit(True)
    for a, name in zip(AXES, INDEX, strict=True):
        low, high, last = F.col(f"_min_{a}"), F.col(f"_max_{a}"), F.col(f"_cells_{a}") - 1
        inside = inside & F.coalesce(F.col(a).between(low, high), F.lit(False))
        place = F.rint((F.col(a) - low) / (high - low) * last)
        rows = rows.withColumn(f"_{name}", F.greatest(F.lit(0), F.least(last, place)).cast("int"))
    cells = volume.select("shape_id", *(F.col(n).alias(f"_{n}") for n in INDEX), "val")
    known = F.col("val").isNotNull() & ~F.isnan("val") & (F.abs("val") < float("inf"))
    kind = F.when(~inside | ~F.coalesce(known, F.lit(False)), 2).when(F.abs("val") < band, 0).otherwise(1)
    return with_group(rows, cells, "shape_id", *(f"_{n}" for n in INDEX), how="left").select(*queries.columns, kind.alias("kind"))


def _ticks(low: Column, step: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: low + step * i)


def _up_to(ticks: str, value: float) -> Column:
    return F.size(F.filter(ticks, lambda t: t <= value))


def _below(ticks: str, value: float) -> Column:
    return F.size(F.filter(ticks, lambda t: t < value))


def crop_each(volume: DataFrame, lattices: DataFrame, low: Sequence[float], high: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """crop() of each shape by its own lattice: cells and the table of lattices that are left, by the same arithmetic."""
    told = lattices.select("shape_id", *LATTICE)
    for axis, a in enumerate(AXES):
        n = F.col(f"cells_{a}")
        step = (F.col(f"max_{a}") - F.col(f"min_{a}")) / F.greatest(F.lit(1), n - 1)
        told = told.withColumn("_ticks", _ticks(F.col(f"min_{a}"), step, n))
        first, last = F.greatest(F.lit(0), _up_to("_ticks", low[axis]) - 1), F.least(_below("_ticks", high[axis]), n - 1)
        told = told.withColumns({f"_first_{a}": first, f"_last_{a}": last})
        told = told.withColumns({f"min_{a}": F.get("_ticks", F.col(f"_first_{a}")), f"max_{a}": F.get("_ticks", F.col(f"_last_{a}")), f"cells_{a}": F.col(f"_last_{a}") - F.col(f"_first_{a}") + 1})
    rows = with_group(volume.select("shape_id", *INDEX, "val"), told.select("shape_id", *(f"_{end}_{a}" for end in ("first", "last") for a in AXES)), "shape_id")
    for a, name in zip(AXES, INDEX, strict=True):
        rows = rows.where(F.col(name).between(F.col(f"_first_{a}"), F.col(f"_last_{a}"))).withColumn(name, F.col(name) - F.col(f"_first_{a}"))
    return rows.select("shape_id", *INDEX, "val"), told.select("shape_id", *LATTICE)


def crop(volume: DataFrame, lattice: Lattice, low: Sequence[float], high: Sequence[float]) -> tuple[DataFrame, Lattice]:
    """The smallest range of ticks that covers a box, from index 0 on, and its lattice."""
    first, last, new_low, new_high = [], [], [], []
    for axis in range(3):
        ticks = lattice.ticks(axis)
        a = min(max(sum(t <= low[axis] for t in ticks) - 1, 0), len(ticks) - 1)
        b = min(max(sum(t < high[axis] for t in ticks), 0), len(ticks) - 1)
        first.append(a)
        last.append(b)
        new_low.append(ticks[a])
        new_high.append(ticks[b])
    rows = volume
    for name, a, b in zip(INDEX, first, last, strict=True):
        rows = rows.where(F.col(name).between(a, b)).withColumn(name, F.col(name) - a)
    return rows, Lattice(new_low, new_high, [b - a + 1 for a, b in zip(first, last, strict=True)])
