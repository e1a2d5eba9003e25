"""From lists of named operators to one function on DataFrames.

Neighbouring fixed scales and similarities are one affine map, so a chain of them is one projection;
operators that do nothing are left out.
"""

from __future__ import annotations

import functools
import json
import posixpath
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..operators import affine, crop, sampling

Step = Callable[[DataFrame], DataFrame]


def _scale(factor: float) -> list[list[float]]:
    return [[factor if i == j and i < 3 else float(i == j) for j in range(4)] for i in range(4)]


def _times(a, b) -> list[list[float]]:
    return [[sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


# Names of operators and of their arguments, so that configurations that there are load.
#: Operators that are a fixed similarity, as matrices.
FIXED = {"FixedScale": lambda scale: _scale(scale), "Similarity": lambda matrix: matrix}
#: All others, by the name that configurations use.
REGISTRY: dict[str, Callable[..., Callable]] = {
    "FixedBBoxCrop": lambda bbox_min, bbox_max: lambda df: crop.crop_box(df, bbox_min, bbox_max),
    "BBoxCrop": lambda min_l, max_l, low_ratio, seed=0: lambda df: crop.crop_random(df, min_l, max_l, low_ratio, seed),
    "BoundScale": lambda min_a, max_a: lambda df: affine.bound_scale(df, min_a, max_a),
    "Centralize": lambda noise=0.0, seed=0: lambda df: affine.centralize(df, noise, seed),
    "FixedAxisRotation": lambda axis, deg_min, deg_max, seed=0: lambda df: affine.rotate_axis(df, axis, deg_min, deg_max, seed),
    "PointcloudNoise": lambda stddev, seed=0: lambda df: sampling.jitter(df, stddev, seed),
    "PointcloudOutliers": lambda ratio, spatial_ratio=1.0, seed=0: lambda df: sampling.outliers(df, ratio, seed),
    "SubsamplePointcloud": lambda N, n_min=None, seed=0: lambda df: sampling.bound_size(df, N, N if n_min is None else n_min, seed).drop("copy"),
    "UniformDensityFixedSampleScale": lambda voxel_size, min_density, max_density, seed=0: lambda df: sampling.density_rescale(df, voxel_size, min_density, max_density, seed),
    "UniformDensityFixedScaleSample": lambda voxel_size, min_density, max_density, seed=0: lambda df: sampling.density_subsample(df, voxel_size, min_density, max_density, seed),
}
_NOTHING = {("PointcloudNoise", "stddev"), ("PointcloudOutliers", "ratio")}


def register(name: str, make: Callable[..., Step]) -> None:
    """Adds an operator of the caller's own under a name."""
    if name in REGISTRY or name in FIXED:
        raise ValueError(f"{name} is taken")
    REGISTRY[name] = make


def plan(configs: Sequence[dict]) -> list[tuple[str, dict]]:
    """The steps left after fusing fixed maps and dropping what does nothing."""
    steps: list[tuple[str, dict]] = []
    for config in configs:
        name, args = config["name"], dict(config.get("args") or {})
        if name not in FIXED and name not in REGISTRY:
            raise ValueError(f"no operator is called {name}")
        if any(n == name and not args.get(a) for n, a in _NOTHING):
            continue
        if name in FIXED:
            matrix = FIXED[name](**args)
            if steps and steps[-1][0] == "Similarity":
                matrix = _times(matrix, steps.pop()[1]["matrix"])
            if max(abs(matrix[i][j] - (i == j)) for i in range(4) for j in range(4)) > 1e-12:
                steps.append(("Similarity", {"matrix": matrix}))
        else:
            steps.append((name, args))
    return steps


def compose(configs: Sequence[dict]) -> Step:
    """One function that applies the operators in order."""
    chain = [(lambda df, m=a["matrix"]: affine.similarity_4x4(df, m)) if n == "Similarity" else REGISTRY[n](**a) for n, a in plan(configs)]
    return lambda df: functools.reduce(lambda d, step: step(d), chain, df)


def merge_configs(*configs: dict) -> dict:
    """Nested configurations merged, later ones over earlier ones; ${a.b} stands for the value at that path."""
    out: dict = {}
    for config in configs:
        for key, value in config.items():
            out[key] = merge_configs(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load_config(text_of: Callable[[str], dict], path: str, overrides: Sequence[str] = ()) -> dict:
    """The configuration at `path` over those it includes, with `a.b=value` overrides put in and ${} and {_name} resolved.

    text_of(path) gives a configuration's dictionary. `include_configs` are paths from the folder of the one that names
    them. Entries whose names start with an underscore are templates: `{_name}` in a string stands for their value.
    """

    def whole(at: str, above: tuple[str, ...] = ()) -> dict:
        if at in above:
            raise ValueError(f"{at} includes itself")
        own = dict(text_of(at))
        folder = at.rpartition("/")[0]
        included = [whole(posixpath.normpath(posixpath.join(folder, p)), (*above, at)) for p in own.pop("include_configs", [])]
        return merge_configs(*included, own)

    config = whole(path)
    for override in overrides:
        key, _, value = override.partition("=")
        nested: dict = {}
        functools.reduce(lambda node, part: node.setdefault(part, {}), key.split(".")[:-1], nested)[key.split(".")[-1]] = _parsed(value)
        config = merge_configs(config, nested)
    names = {k: v for k, v in config.items() if k.startswith("_") and isinstance(v, str)}

    def named(value):
        if isinstance(value, dict):
            return {k: named(v) for k, v in value.items()}
        if isinstance(value, list):
            return [named(v) for v in value]
        return functools.reduce(lambda text, name: text.replace("{" + name + "}", names[name]), names, value) if isinstance(value, str) else value

    return interpolate(named(config))


def _parsed(value: str):
    """A number, a truth value or null as JSON has them, anything else as it is."""
    try:
        return json.loads(value)
    except ValueError:
        return {"True": True, "False": False, "None": None}.get(value, value)


def interpolate(config: dict) -> dict:
    """${path.to.key} in string values replaced by what stands there."""

    def look(path: str):
        return functools.reduce(lambda node, key: node[key], path.split("."), config)

    def put(value):
        if isinstance(value, dict):
            return {k: put(v) for k, v in value.items()}
        if isinstance(value, list):
            return [put(v) for v in value]
        if isinstance(value, str) and value.startswith("${") and value.endswith("}"):
            return put(look(value[2:-1]))
        return value

    return put(config)
