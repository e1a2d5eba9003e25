"""Chains of operators over whole records: a shape's input, true points, occupancy samples and true geometry move together.

What an operator draws or measures, it draws from the input once a shape, and applies to every role. So all roles stay
in one frame, and a role's own bounds or points never change what happens to another.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import affine, crop, volume
from ..operators.crop import AXES
from ..operators.ranks import with_group
from ..sources.storage import checkpointed
from .planner import REGISTRY

#: Roles of a record that are points, the input first.
POINTS = ("input", "gt", "occ", "geometry")


@dataclass(frozen=True)
class Record:
    """Tables of one set of shapes; roles that there are none of are None.

    input, gt, occ (with its samples' positions) and geometry (points of the true surface) are points by shape_id; volume
    has cells (shape_id, i, j, k, val) and lattices the bounds and sizes of each shape's volume, both or neither.
    """

    input: DataFrame
    gt: DataFrame | None = None
    occ: DataFrame | None = None
    geometry: DataFrame | None = None
    volume: DataFrame | None = None
    lattices: DataFrame | None = None

    def __post_init__(self):
        if (self.volume is None) != (self.lattices is None):
            raise ValueError("a volume and its lattices come together")

    def each(self, step: Callable[[DataFrame], DataFrame], lattice: Callable[[DataFrame], DataFrame] | None = None) -> Record:
        """The record with `step` applied to all points, and `lattice` to the lattices."""
        new = {role: step(df) for role in POINTS if (df := getattr(self, role)) is not None}
        if lattice is not None and self.lattices is not None:
            new["lattices"] = lattice(self.lattices)
        return dataclasses.replace(self, **new)


Step = Callable[[Record], Record]


def _moved(record: Record, frame: DataFrame) -> Record:
    """(p - mid) * factor for positions and sensors of every role and for lattices' bounds; frame has mid_* and factor a shape."""
    frame = checkpointed(frame.select("shape_id", *(f"mid_{a}" for a in AXES), "factor"))
    place = lambda name, a: ((F.col(name) - F.col(f"mid_{a}")) * F.col("factor")).alias(name)

    def move(df: DataFrame, names: dict[str, str]) -> DataFrame:
        return with_group(df, frame, "shape_id").select(*(place(c, names[c]) if c in names else c for c in df.columns))

    return record.each(lambda df: move(df, {p + a: a for p in ("", "s") for a in AXES}), lambda df: move(df, {f"{end}_{a}": a for end in ("min", "max") for a in AXES}))


def _middles(points: DataFrame) -> DataFrame:
    return crop.bounds(points).withColumns({f"mid_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2.0 for a in AXES})


def fixed_scale(record: Record, scale: float) -> Record:
    """All positions, and lattices' bounds, times a factor above 0."""
    if scale <= 0:
        raise ValueError("a record is scaled by more than 0")
    return record.each(lambda df: affine.scale_fixed(df, scale), lambda df: affine.transform_bounds(df, ((1, 0, 0), (0, 1, 0), (0, 0, 1)), (0.0, 0.0, 0.0), scale))


def bound_scale(record: Record, min_a: float, max_a: float) -> Record:
    """Centred on the middle of the input's bounds and scaled so that its larger half-extent lies in [min_a, max_a]."""
    half = F.greatest(*((F.col(f"max_{a}") - F.col(f"min_{a}")) / 2.0 for a in AXES))
    factor = F.coalesce(F.try_divide(F.greatest(F.lit(min_a), F.least(half, F.lit(max_a))), half), F.lit(1.0))
    return _moved(record, _middles(record.input).withColumn("factor", factor))


def centralize(record: Record, noise: float = 0.0, seed: int = 0) -> Record:
    """Centred on the middle of the input's bounds, off by up to `noise` of its extent, as affine.centralize()."""
    frame = _middles(record.input).withColumn("factor", F.lit(1.0))
    for a in AXES if noise else ():
        frame = frame.withColumn(f"mid_{a}", F.col(f"mid_{a}") + (F.col(f"max_{a}") - F.col(f"min_{a}")) * noise * (rng.uniform(seed, f"centre.{a}", "shape_id") * 2.0 - 1.0))
    return _moved(record, frame)


def rotate_axis(record: Record, axis: str, deg_min: float, deg_max: float, seed: int = 0) -> Record:
    """Every role turned about an axis by its shape's angle. A record with a geometry is refused: lattices can't be turned."""
    if record.geometry is not None or record.lattices is not None:
        raise ValueError("a record with a geometry can't be rotated")
    return record.each(lambda df: affine.rotate_axis(df, axis, deg_min, deg_max, seed))


def crop_box(record: Record, low: Sequence[float], high: Sequence[float]) -> Record:
    """Input and geometry strictly inside a box, the volume cut to the ticks that cover it. A record with true points is refused."""
    if record.gt is not None:
        raise ValueError("a record with true points takes a random box, which is carried to them")
    new = {role: crop.crop_box(df, low, high) for role in ("input", "geometry") if (df := getattr(record, role)) is not None}
    if record.lattices is not None:
        new["volume"], new["lattices"] = volume.crop_each(record.volume, record.lattices, low, high)
    return dataclasses.replace(record, **new)


def crop_random(record: Record, min_l: float, max_l: float, low_ratio: float, seed: int = 0) -> Record:
    """Input and true points strictly inside the box that crop.random_boxes() takes for the input; occupancy samples and geometry stay whole."""
    sides = [f"{end}_{a}" for end in ("low", "high") for a in AXES]
    box = checkpointed(crop.random_boxes(record.input, min_l, max_l, low_ratio, seed).select("shape_id", *(F.col(s).alias(f"_{s}") for s in sides)))

    def inside(df: DataFrame) -> DataFrame:
        rows = with_group(df, box, "shape_id")
        for a in AXES:
            rows = rows.where((F.col(a) > F.col(f"_low_{a}")) & (F.col(a) < F.col(f"_high_{a}")))
        return rows.select(*df.columns)

    return dataclasses.replace(record, input=inside(record.input), gt=None if record.gt is None else inside(record.gt))


# Names as configurations use them.
WHOLE: dict[str, Callable[..., Record]] = {
    "FixedScale": lambda r, scale: fixed_scale(r, scale),
    "BoundScale": lambda r, min_a, max_a: bound_scale(r, min_a, max_a),
    "Centralize": lambda r, noise=0.0, seed=0: centralize(r, noise, seed),
    "FixedAxisRotation": lambda r, axis, deg_min, deg_max, seed=0: rotate_axis(r, axis, deg_min, deg_max, seed),
    "FixedBBoxCrop": lambda r, bbox_min, bbox_max: crop_box(r, bbox_min, bbox_max),
    "BBoxCrop": lambda r, min_l, max_l, low_ratio, seed=0: crop_random(r, min_l, max_l, low_ratio, seed),
}
#: Operators that touch the input alone.
INPUT_ONLY = ("PointcloudNoise", "PointcloudOutliers", "SubsamplePointcloud", "UniformDensityFixedScaleSample")


def compose(configs: Sequence[dict]) -> Step:
    """One function from record to record that applies named operators in order."""
    steps: list[Step] = []
    for config in configs:
        name, args = config["name"], dict(config.get("args") or {})
        if name in WHOLE:
            steps.append(functools.partial(WHOLE[name], **args))
        elif name in INPUT_ONLY:
            step = REGISTRY[name](**args)
            steps.append(lambda r, step=step: dataclasses.replace(r, input=step(r.input)))
        else:
            raise ValueError(f"no operator on whole records is called {name}")
    return lambda record: functools.reduce(lambda r, step: step(r), steps, record)
