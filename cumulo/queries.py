"""Queries that apply the point-cloud operators to the tables, with the same in DuckDB's SQL.

Doubles are rounded to six places on both sides, as sums may run in any order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rng, vec
from .functions.vec import Vec
from .operators import affine, crop, knn, mesh, metrics, mixing, normals, ranks, report, sampling, sdf, volume
from .plans import chunks, records
from .sources import views

#: Common table expressions of the views, by name, each with those that it needs.
VIEWS = {
    "small_cloud": """SELECT 'label/' || label AS shape_id, vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
        embedding[4]::DOUBLE AS nx, embedding[5]::DOUBLE AS ny, embedding[6]::DOUBLE AS nz, embedding[7]::DOUBLE AS sx, embedding[8]::DOUBLE AS sy, embedding[9]::DOUBLE AS sz,
        (embedding[10]::DOUBLE + 1) / 2 AS r, (embedding[11]::DOUBLE + 1) / 2 AS g, (embedding[12]::DOUBLE + 1) / 2 AS b FROM embeddings""",
    "pred": "SELECT * FROM small_cloud WHERE point_id % 2 = 0",
    "gt": "SELECT * FROM small_cloud WHERE point_id % 2 = 1",
    "scene": """SELECT l_returnflag AS shape_id, ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT,
        round(l_discount * 100)::BIGINT, strftime(l_shipdate, '%Y-%m-%d'))), 1, 15))::BIGINT AS point_id, l_quantity / 50.0 AS x, l_extendedprice / 105000.0 AS y, l_discount * 10.0 AS z, l_tax FROM lineitem""",
    "big_cloud": """SELECT shape_id, point_id, x, y, z, coalesce((x - 0.5) / nullif(l, 0), 0) AS nx, coalesce((y - 0.5) / nullif(l, 0), 0) AS ny, coalesce((z - 0.5) / nullif(l, 0), 0) AS nz, l_tax
        FROM (SELECT *, sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) + (z - 0.5) * (z - 0.5)) AS l FROM scene)""",
    "volume": """SELECT shape_id, i, j, k, sum(round(l_tax * 100)::BIGINT) / 100.0 / count(*) * 10.0 - 0.4 AS val FROM (SELECT shape_id, l_tax, greatest(0, least(15, floor(x * 16)))::INT AS i,
        greatest(0, least(15, floor(y * 16)))::INT AS j, greatest(0, least(15, floor(z * 16)))::INT AS k FROM big_cloud) GROUP BY ALL""",
    "metric_log": "SELECT event_id AS step, event_type AS name, value FROM events",
    "bounds": "SELECT shape_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM small_cloud GROUP BY shape_id",
    "sizes": "SELECT shape_id, count(*) AS n FROM small_cloud GROUP BY shape_id",
}
_NEEDS = {"pred": ["small_cloud"], "gt": ["small_cloud"], "big_cloud": ["scene"], "volume": ["scene", "big_cloud"], "bounds": ["small_cloud"], "sizes": ["small_cloud"]}


def _with(*names: str, body: str, **more: str) -> str:
    """SQL with the views named, those that they need before them, and further expressions after them."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*_NEEDS.get(name, []), name) if n not in order]
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def _round(column, name: str):
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def _r(sql: str, name: str = "") -> str:
    return f"round({sql}, 6) + 0.0 AS {name or sql}"


def _u(seed: int | str, op: str, *keys: str) -> str:
    """A draw; a seed may be a column's name."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join([seed if isinstance(seed, str) else f"'{seed}'", f"'{op}'", *keys])})), 1, 8))::BIGINT / 4294967296.0)"


def _md5(seed: int, op: str, *keys: str) -> str:
    return f"md5(concat_ws('|', {', '.join([f"'{seed}'", f"'{op}'", *keys])}))"


def _n(seed: int, op: str, *keys: str) -> str:
    return f"(sqrt(-2.0 * ln(greatest({_u(seed, op + '.r', *keys)}, {2.0**-33!r}))) * cos({2.0 * math.pi!r} * {_u(seed, op + '.a', *keys)}))"


def _out(df: DataFrame, *keys: str) -> DataFrame:
    """The key columns as they are, and all doubles rounded."""
    return df.select(*(F.col(c) if c in keys or t != "double" else _round(F.col(c), c) for c, t in df.dtypes))


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- metrics ---------------------------------------------------------------------------------------


def _pairs(source: str, target: str) -> str:
    unit = lambda p: f"sqrt({p}.nx * {p}.nx + {p}.ny * {p}.ny + {p}.nz * {p}.nz)"
    return f"""SELECT shape_id, sqrt(d2) AS dist, dot FROM (SELECT q.shape_id, (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z) AS d2,
        abs((q.nx * r.nx + q.ny * r.ny + q.nz * r.nz) / {unit('q')} / {unit('r')}) AS dot, row_number() OVER (PARTITION BY q.shape_id, q.point_id ORDER BY d2, r.point_id) AS n
        FROM {source} q JOIN {target} r USING (shape_id)) WHERE n = 1"""


_SIDES = {"c": _pairs("gt", "pred"), "a": _pairs("pred", "gt")}


def _metric_sql(columns: str) -> str:
    return _with("pred", "gt", **_SIDES, body=f"SELECT {columns}")


@_query(_with("pred", "gt", **_SIDES, body=f"""SELECT shape_id, {_r('cd', 'completeness')}, {_r('cd2', 'completeness2')}, {_r('ad', 'accuracy')}, {_r('ad2', 'accuracy2')}, {_r('(cd + ad) / 2', 'chamfer_l1')}, {_r('(cd2 + ad2) / 2', 'chamfer_l2')}
    FROM (SELECT shape_id, avg(dist) AS cd, avg(dist * dist) AS cd2 FROM c GROUP BY 1) JOIN (SELECT shape_id, avg(dist) AS ad, avg(dist * dist) AS ad2 FROM a GROUP BY 1) USING (shape_id)"""))  # fmt: skip
def chamfer_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("completeness", "completeness2", "accuracy", "accuracy2", "chamfer_l1", "chamfer_l2")
    return _out(metrics.evaluate(views.pred(spark, sf_dir), views.gt(spark, sf_dir), names))


_F_SQL = {n: f"(CASE WHEN a{i} + c{i} = 0 THEN 'nan'::DOUBLE ELSE 2 * a{i} * c{i} / (a{i} + c{i}) END)" for i, n in ((0, "f_score"), (1, "f_score_15"), (2, "f_score_20"), (4, "f_score_outdoor"))}
_SHARES = lambda p: ", ".join(f"avg((dist <= {t})::INT) AS {p}{i}" for i, t in enumerate(metrics.THRESHOLDS))


@_query(_with("pred", "gt", **_SIDES, body=f"""SELECT shape_id, {', '.join(_r(f'c{i}', f'recall_{i}') + ', ' + _r(f'a{i}', f'precision_{i}') for i in range(5))}, {', '.join(_r(s, n) for n, s in _F_SQL.items())}
    FROM (SELECT shape_id, {_SHARES('c')} FROM c GROUP BY 1) JOIN (SELECT shape_id, {_SHARES('a')} FROM a GROUP BY 1) USING (shape_id)"""))  # fmt: skip
def fscore_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*(f"{p}_{i}" for p in ("recall", "precision") for i in range(5)), *metrics.NAMED.values())
    return _out(metrics.evaluate(views.pred(spark, sf_dir), views.gt(spark, sf_dir), names))


@_query(_with("pred", "gt", **_SIDES, body=f"""SELECT shape_id, CASE WHEN shape_id = 'label/0' THEN 'nan'::DOUBLE ELSE round((cd + ad) / 2, 6) + 0.0 END AS chamfer_l1,
    CASE WHEN shape_id = 'label/0' THEN 'nan'::DOUBLE ELSE round({_F_SQL['f_score_outdoor']}, 6) + 0.0 END AS f_score_outdoor
    FROM (SELECT shape_id, avg(dist) AS cd, {_SHARES('c')} FROM c GROUP BY 1) JOIN (SELECT shape_id, avg(dist) AS ad, {_SHARES('a')} FROM a GROUP BY 1) USING (shape_id)"""))  # fmt: skip
def fscore_empty_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction without points, here of label 0, has NaN everywhere."""
    pred = views.pred(spark, sf_dir).where("shape_id <> 'label/0'")
    return _out(metrics.evaluate(pred, views.gt(spark, sf_dir), ("chamfer_l1", "f_score_outdoor")))


@_query(_with("pred", "gt", **_SIDES, body=f"SELECT shape_id, {_r('(cn + an) / 2', 'normal_consistency')} FROM (SELECT shape_id, avg(dot) AS cn FROM c GROUP BY 1) JOIN (SELECT shape_id, avg(dot) AS an FROM a GROUP BY 1) USING (shape_id)"))
def normal_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.evaluate(views.pred(spark, sf_dir), views.gt(spark, sf_dir), ("normal_consistency",)))


@_query(_with("small_cloud", body=f"SELECT shape_id, {_r('count(*) FILTER (WHERE z > 0 AND x + z > 0) / (count(*) FILTER (WHERE z > 0 OR x + z > 0) + 1e-6)', 'iou')} FROM small_cloud GROUP BY shape_id"))
def occupancy_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.iou(views.occupancy(spark, sf_dir)))


# --- bounds and crops --------------------------------------------------------------------------------

_AXES = "xyz"


@_query(_with("big_cloud", body=f"SELECT shape_id, {', '.join(_r(f'min({a})', f'min_{a}') + ', ' + _r(f'max({a})', f'max_{a}') for a in _AXES)} FROM big_cloud GROUP BY shape_id"))
def bounds_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(crop.bounds(views.big_cloud(spark, sf_dir)))


@_query(_with("small_cloud", body=f"SELECT shape_id, {', '.join(_r(f'{f}({a})', f'{n}_{a}') for a in _AXES for n, f in (('mean', 'avg'), ('min', 'min'), ('max', 'max')))} FROM small_cloud GROUP BY shape_id"))
def point_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.point_stats(views.small_cloud(spark, sf_dir)))


_XYZ = ", ".join(_r(a, a) for a in _AXES)


@_query(_with("big_cloud", body=f"SELECT shape_id, point_id, {_XYZ} FROM big_cloud WHERE x > 0.25 AND x < 0.75 AND y > 0.1 AND y < 0.6 AND z > 0.15 AND z < 0.65"))
def crop_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(crop.crop_box(views.big_cloud(spark, sf_dir), (0.25, 0.1, 0.15), (0.75, 0.6, 0.65)).select("shape_id", "point_id", "x", "y", "z"))


#: Boxes that overlap: number, low and high corner.
BOXES = [(0, 0.1, 0.1, 0.1, 0.5, 0.5, 0.55), (1, 0.3, 0.2, 0.05, 0.9, 0.4, 0.95), (2, 2.0, 2.0, 2.0, 3.0, 3.0, 3.0)]


@_query(_with("big_cloud", body=f"""SELECT box_id, shape_id, point_id, {_XYZ} FROM big_cloud JOIN (VALUES {', '.join(map(str, BOXES))}) AS b(box_id, x0, y0, z0, x1, y1, z1)
    ON x > x0 AND x < x1 AND y > y0 AND y < y1 AND z > z0 AND z < z1"""))  # fmt: skip
def crop_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame(BOXES, "box_id int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double")
    return _out(crop.crop_boxes(views.big_cloud(spark, sf_dir).select("shape_id", "point_id", "x", "y", "z"), boxes))


_SIZED = "SELECT n_nationkey AS box_id, " + ", ".join(f"{_u(0, f'box.{a}', 'n_nationkey')} AS c{a}" for a in "xyz") + ", pow(10.0, n_nationkey % 8 - 3) / 2.0 AS h FROM nation"


@_query(_with("big_cloud", sized=_SIZED, body=f"SELECT box_id::INT AS box_id, count(*) AS n, {_r('sum(x)', 'total')} FROM big_cloud JOIN sized ON x > cx - h AND x < cx + h AND y > cy - h AND y < cy + h AND z > cz - h AND z < cz + h GROUP BY box_id"))
def crop_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in boxes whose sides go from a thousandth to ten thousand, counted a box."""
    boxes = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("box_id"), *(rng.uniform(0, f"box.{a}", "n_nationkey").alias(f"c{a}") for a in "xyz"), (F.pow(F.lit(10.0), F.col("n_nationkey") % 8 - 3) / 2.0).alias("h"))
    boxes = boxes.select("box_id", *((F.col(f"c{a}") - F.col("h")).alias(f"min_{a}") for a in "xyz"), *((F.col(f"c{a}") + F.col("h")).alias(f"max_{a}") for a in "xyz"))
    return _out(crop.crop_boxes(views.big_cloud(spark, sf_dir).select("x", "y", "z"), boxes).groupBy("box_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")))


def _random_boxes_sql(min_l: float, max_l: float, low_ratio: float, cloud: str = "big_cloud", seed: int | str = 0) -> dict[str, str]:
    keys = f"shape_id, {seed}" if isinstance(seed, str) else "shape_id"
    axis = []
    for a in _AXES:
        low, high = f"({a}0 - ({a}1 - {a}0) * 0.1)", f"({a}1 + ({a}1 - {a}0) * 0.1)"
        side = f"least({min_l} + ({max_l} - {min_l}) * {_u(seed, f'crop.side.{a}', 'shape_id', 't')}, {high} - {low})"
        centre = f"({low} + ({high} - {low}) * {_u(seed, f'crop.centre.{a}', 'shape_id', 't')})"
        axis.append(f"{side} AS side_{a}, least(greatest({centre} - {side} / 2.0, {low}), {high} - {side}) AS low_{a}")
    inside = " AND ".join(f"{a} > low_{a} AND {a} < low_{a} + side_{a}" for a in _AXES)
    return {
        "bounds3": f"SELECT {keys}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM {cloud} GROUP BY ALL",
        "proposals": f"SELECT {keys}, t AS proposal, {', '.join(axis)} FROM bounds3, range(20) AS g(t)",
        "ratios": f"SELECT {keys}, proposal, count(*) FILTER (WHERE {inside}) / count(*) AS ratio FROM {cloud} JOIN proposals USING ({keys}) GROUP BY ALL",
        "taken": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY (ratio < {low_ratio})::INT, CASE WHEN ratio < {low_ratio} THEN -ratio ELSE 0 END, proposal) AS turn FROM ratios) WHERE turn = 1""",
        "cropped": f"SELECT {cloud}.* FROM {cloud} JOIN (SELECT * FROM taken JOIN proposals USING ({keys}, proposal)) USING ({keys}) WHERE {inside}",
    }


@_query(_with("big_cloud", **_random_boxes_sql(0.2, 0.5, 0.2), body=f"SELECT shape_id, point_id, {_XYZ} FROM cropped"))
def crop_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(crop.crop_random(views.big_cloud(spark, sf_dir), 0.2, 0.5, 0.2).select("shape_id", "point_id", "x", "y", "z"))


_MID = {a: f"({a}0 + {a}1) / 2.0" for a in _AXES}


@_query(_with("bounds", body=f"SELECT shape_id, point_id FROM small_cloud JOIN bounds USING (shape_id) WHERE sqrt({' + '.join(f'({a} - {_MID[a]}) * ({a} - {_MID[a]})' for a in _AXES)}) < 0.2"))
def radius_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop.radius_filter(views.small_cloud(spark, sf_dir), 0.2).select("shape_id", "point_id")


@_query(_with("small_cloud", body="SELECT shape_id, count(*) FILTER (WHERE x > 0.1) AS n FROM small_cloud GROUP BY shape_id HAVING n < 64"))
def empty_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = views.small_cloud(spark, sf_dir)
    return crop.empty_shapes(cloud.where("x > 0.1"), cloud)


# --- affine --------------------------------------------------------------------------------------------

_PS = ", ".join(_r(f"s{a}", f"s{a}") for a in _AXES)


@_query(_with("small_cloud", body=f"SELECT shape_id, point_id, {', '.join(_r(f'{a} * 50.0', a) for a in _AXES)}, {', '.join(_r(f's{a} * 50.0', f's{a}') for a in _AXES)} FROM small_cloud"))
def scale_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(affine.scale_fixed(views.small_cloud(spark, sf_dir), 50.0).select("shape_id", "point_id", "x", "y", "z", "sx", "sy", "sz"))


_HALF = "greatest((x1 - x0) / 2, (y1 - y0) / 2, (z1 - z0) / 2)"
_FACTOR = f"coalesce(greatest(0.5, least({_HALF}, 0.6)) / nullif({_HALF}, 0), 1)"


@_query(_with("bounds", body=f"SELECT shape_id, point_id, {', '.join(_r(f'({a} - {_MID[a]}) * {_FACTOR}', a) for a in _AXES)} FROM small_cloud JOIN bounds USING (shape_id)"))
def scale_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(affine.bound_scale(views.small_cloud(spark, sf_dir), 0.5, 0.6).select("shape_id", "point_id", "x", "y", "z"))


@_query(_with("bounds", body=f"SELECT shape_id, point_id, {', '.join(_r(f'{a} - ({_MID[a]} + ({a}1 - {a}0) * 0.1 * ({_u(0, f'centre.{a}', 'shape_id')} * 2 - 1))', a) for a in _AXES)} FROM small_cloud JOIN bounds USING (shape_id)"))
def centralize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(affine.centralize(views.small_cloud(spark, sf_dir), 0.1).select("shape_id", "point_id", "x", "y", "z"))


_TURN = f"(-30.0 + 90.0 * {_u(0, 'rotate.z', 'shape_id')}) * {math.pi / 180.0!r}"


@_query(_with("small_cloud", body=f"""SELECT shape_id, point_id, {_r(f'cos({_TURN}) * x - sin({_TURN}) * y', 'x')}, {_r(f'sin({_TURN}) * x + cos({_TURN}) * y', 'y')}, {_r('z', 'z')},
    {_r(f'cos({_TURN}) * nx - sin({_TURN}) * ny', 'nx')}, {_r(f'sin({_TURN}) * nx + cos({_TURN}) * ny', 'ny')}, {_r('nz', 'nz')} FROM small_cloud"""))  # fmt: skip
def rotate_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(affine.rotate_axis(views.small_cloud(spark, sf_dir), "z", -30.0, 60.0).select("shape_id", "point_id", "x", "y", "z", "nx", "ny", "nz"))


#: A quarter turn about x, twice the size, and a shift.
POSE = [[2.0, 0.0, 0.0, 1.0], [0.0, 0.0, -2.0, 0.5], [0.0, 2.0, 0.0, -0.25], [0.0, 0.0, 0.0, 1.0]]


@_query(_with("small_cloud", body=f"SELECT shape_id, point_id, {_r('2 * x + 1', 'x')}, {_r('-2 * z + 0.5', 'y')}, {_r('2 * y - 0.25', 'z')}, {_r('nx', 'nx')}, {_r('-nz', 'ny')}, {_r('ny', 'nz')} FROM small_cloud"))
def similarity_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(affine.similarity_4x4(views.small_cloud(spark, sf_dir), POSE).select("shape_id", "point_id", "x", "y", "z", "nx", "ny", "nz"))


@_query(_with("small_cloud", body=f"SELECT shape_id, point_id, {_XYZ} FROM small_cloud"))
def similarity_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = affine.similarity_4x4(views.small_cloud(spark, sf_dir), POSE)
    return _out(affine.similarity_4x4(there, affine.inverse_4x4(POSE)).select("shape_id", "point_id", "x", "y", "z"))


_CHAIN = [{"name": "FixedScale", "args": {"scale": 2.0}}, {"name": "FixedScale", "args": {"scale": 0.5}}, {"name": "FixedBBoxCrop", "args": {"bbox_min": [-0.1, -0.1, -0.1], "bbox_max": [0.1, 0.1, 0.1]}}, {"name": "FixedScale", "args": {"scale": 10.0}}]


@_query(_with("small_cloud", body=f"SELECT shape_id, point_id, {', '.join(_r(f'{a} * 10', a) for a in _AXES)} FROM small_cloud WHERE {' AND '.join(f'{a} > -0.1 AND {a} < 0.1' for a in _AXES)}"))
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.planner import compose

    return _out(compose(_CHAIN)(views.small_cloud(spark, sf_dir)).select("shape_id", "point_id", "x", "y", "z"))


_SEEN = {a: f"(s{a} - {a}) / (sqrt((sx - x) * (sx - x) + (sy - y) * (sy - y) + (sz - z) * (sz - z)) + 1e-6)" for a in _AXES}


@_query(_with("small_cloud", body=f"SELECT shape_id, point_id, {', '.join(_r(_SEEN[a], f'v{a}') for a in _AXES)} FROM small_cloud"))
def view_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(affine.view_direction(views.small_cloud(spark, sf_dir)).select("shape_id", "point_id", "vx", "vy", "vz"))


@_query(_with("small_cloud", seen=f"SELECT *, ({' + '.join(f'{_SEEN[a]} * n{a}' for a in _AXES)}) / sqrt(nx * nx + ny * ny + nz * nz) AS c FROM small_cloud",
    body=f"SELECT shape_id, point_id, {', '.join(_r(f'CASE WHEN c < 0 THEN -n{a} ELSE n{a} END', f'n{a}') for a in _AXES)} FROM seen WHERE abs(c) > {math.cos(math.radians(85.0))!r}"))
def grazing_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(affine.face_sensor(views.small_cloud(spark, sf_dir)).select("shape_id", "point_id", "nx", "ny", "nz"))


# --- density and sampling --------------------------------------------------------------------------------

_CELLS = lambda s, cloud, f="floor({a} / {s})": f"SELECT DISTINCT shape_id, {', '.join(f.format(a=a, s=s) + '::BIGINT AS ' + n for a, n in zip('xyz', 'ijk', strict=True))} FROM {cloud}"


@_query(_with("big_cloud", cells=_CELLS(0.03, "big_cloud"), body=f"SELECT shape_id, n, cells, {_r('n / cells', 'density')} FROM (SELECT shape_id, count(*) AS n FROM big_cloud GROUP BY 1) JOIN (SELECT shape_id, count(*) AS cells FROM cells GROUP BY 1) USING (shape_id)"))
def voxel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sampling.density(views.big_cloud(spark, sf_dir), 0.03))


@_query(_with("small_cloud", cells=_CELLS(0.03, "small_cloud", "round(({a} - ((({a} % {s}) + {s}) % {s})) / {s})"), body=f"SELECT shape_id, n, cells, {_r('n / cells', 'density')} FROM (SELECT shape_id, count(*) AS n FROM small_cloud GROUP BY 1) JOIN (SELECT shape_id, count(*) AS cells FROM cells GROUP BY 1) USING (shape_id)"))
def voxel_density_floordiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sampling.density(views.small_cloud(spark, sf_dir), 0.03, by_remainder=True))


@_query(_with("big_cloud", body=_CELLS(0.07, "big_cloud")))
def voxel_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.voxels(views.big_cloud(spark, sf_dir), 0.07)


_DENSITY = {"cells": _CELLS(0.1, "small_cloud"), "dense": "SELECT shape_id, n, n / c AS density FROM sizes JOIN (SELECT shape_id, count(*) AS c FROM cells GROUP BY 1) USING (shape_id)"}


@_query(_with("sizes", **_DENSITY, body=f"SELECT shape_id, point_id, {', '.join(_r(f'{a} * sqrt(density / (1.0 + 1.0 * {_u(0, 'density', 'shape_id')}))', a) for a in _AXES)} FROM small_cloud JOIN dense USING (shape_id)"))
def density_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sampling.density_rescale(views.small_cloud(spark, sf_dir), 0.1, 1.0, 2.0).select("shape_id", "point_id", "x", "y", "z"))


def _ranked(op: str, source: str = "small_cloud") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY {_md5(0, op, 'shape_id', 'point_id')}, point_id) AS rank FROM {source}"


@_query(_with("sizes", **_DENSITY, ranked=_ranked("subsample"), body=f"""SELECT shape_id, point_id FROM ranked JOIN dense USING (shape_id)
    WHERE rank <= round_even(n / density * (least(density, 0.5) + (least(density, 0.9) - least(density, 0.5)) * {_u(0, 'density', 'shape_id')}), 0)::BIGINT"""))  # fmt: skip
def density_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.density_subsample(views.small_cloud(spark, sf_dir), 0.1, 0.5, 0.9).select("shape_id", "point_id")


@_query(_with("big_cloud", ranked=_ranked("subsample", "big_cloud"), body="SELECT shape_id, point_id FROM ranked WHERE rank <= 1000"))
def subsample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.subsample(views.big_cloud(spark, sf_dir), 1000).select("shape_id", "point_id")


def _drawn(op: str, draws: str) -> dict[str, str]:
    return {
        "picks": f"SELECT shape_id, draw, floor({_u(0, op, 'shape_id', 'draw')} * n)::BIGINT + 1 AS rank FROM ({draws})",
        "ordered": _ranked(f"{op}.order"),
        "drawn": "SELECT p.draw, o.* FROM picks p JOIN ordered o USING (shape_id, rank)",
    }


@_query(_with("sizes", ranked=_ranked("subsample"), **_drawn("resize", "SELECT shape_id, n, unnest(range(60 - n)) AS draw FROM sizes WHERE n < 60"),
    body="SELECT shape_id, point_id, 0::BIGINT AS copy FROM ranked WHERE rank <= 60 UNION ALL SELECT shape_id, point_id, draw + 1 FROM drawn"))
def pad_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.resize(views.small_cloud(spark, sf_dir), 60).select("shape_id", "point_id", "copy")


@_query(_with("small_cloud", ranked=_ranked("subsample"), body="SELECT shape_id, point_id FROM ranked WHERE rank <= 45"))
def bound_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bound_size(views.small_cloud(spark, sf_dir), 45).select("shape_id", "point_id")


@_query(_with("small_cloud", body=f"SELECT shape_id, point_id, {', '.join(_r(f'{a} + 0.005 * {_n(0, f'jitter.{a}', 'shape_id', 'point_id')}', a) for a in _AXES)} FROM small_cloud"))
def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sampling.jitter(views.small_cloud(spark, sf_dir), 0.005).select("shape_id", "point_id", "x", "y", "z"))


_O = lambda name: _u(0, f"outlier.{name}", "shape_id", "point_id")
_H, _T = f"({_O('h')} * 2 - 1)", f"({_O('t')} * {2.0 * math.pi!r})"
_FLAT = f"sqrt(greatest(0.0, 1.0 - {_H} * {_H}))"
_OUTLIER = {a: f"({_O(a)} * 2 - 1) * 0.55" for a in _AXES} | {"nx": f"{_FLAT} * cos({_T})", "ny": f"{_FLAT} * sin({_T})", "nz": _H} | {c: _O(c) for c in "rgb"}


@_query(_with("sizes", ordered=_ranked("outlier.order"), hit=f"SELECT DISTINCT shape_id, floor({_u(0, 'outlier', 'shape_id', 'draw')} * n)::BIGINT + 1 AS rank, true AS o FROM (SELECT shape_id, n, unnest(range(floor(n * 0.2)::BIGINT)) AS draw FROM sizes)",
    body=f"SELECT shape_id, point_id, {', '.join(_r(f'CASE WHEN o THEN {s} ELSE {n} END', n) for n, s in _OUTLIER.items())} FROM ordered LEFT JOIN hit USING (shape_id, rank)"))
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sampling.outliers(views.small_cloud(spark, sf_dir), 0.2).select("shape_id", "point_id", *_OUTLIER))


@_query(_with("sizes", **_drawn("band", "SELECT shape_id, n, unnest(range(100)) AS draw FROM sizes"), body=f"SELECT shape_id, draw, point_id, {', '.join(_r(f'{a} + n{a} * ({_n(0, 'band.step', 'shape_id', 'draw')} * 0.05)', a) for a in _AXES)} FROM drawn"))
def band_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sampling.band_samples(views.small_cloud(spark, sf_dir), 100, 0.05))


@_query(_with("sizes", **_drawn("surface", "SELECT shape_id, n, unnest(range(50)) AS draw FROM sizes WHERE n > 50"), body="SELECT shape_id, draw, point_id FROM drawn UNION ALL SELECT shape_id, point_id, point_id FROM small_cloud JOIN sizes USING (shape_id) WHERE n <= 50"))
def surface_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.surface_subsample(views.small_cloud(spark, sf_dir), 50).select("shape_id", "draw", "point_id")


_WIDE = "SELECT DISTINCT shape_id, i + di AS i, j + dj AS j, k + dk AS k FROM cells, (SELECT unnest([-1, 0, 1]) AS di), (SELECT unnest([-1, 0, 1]) AS dj), (SELECT unnest([-1, 0, 1]) AS dk)"


@_query(_with("small_cloud", cells=_CELLS(0.1, "small_cloud"), wide=_WIDE, named="SELECT *, concat_ws(',', i, j, k) AS point_id FROM wide", ordered=_ranked("voxel.order", "named"),
    picks=f"SELECT shape_id, draw, floor({_u(0, 'voxel', 'shape_id', 'draw')} * n)::BIGINT + 1 AS rank FROM (SELECT shape_id, n, unnest(range(100)) AS draw FROM (SELECT shape_id, count(*) AS n FROM wide GROUP BY 1))",
    body=f"SELECT shape_id, draw, {', '.join(_r(f'({i} + {_u(0, f'voxel.{a}', 'shape_id', 'draw')}) * 0.1', a) for a, i in zip('xyz', 'ijk', strict=True))} FROM picks JOIN ordered USING (shape_id, rank)"))
def voxel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sampling.voxel_samples(views.small_cloud(spark, sf_dir), 0.1, 100, 3))


@_query(f"SELECT event_id AS step, {_r('greatest(0.0, least(1.0, (event_id - 100.0) / 800.0))', 'p')}, {_u(0, 'schedule', 'event_id')} < greatest(0.0, least(1.0, (event_id - 100.0) / 800.0)) AS taken FROM events")
def bernoulli_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = views.metric_log(spark, sf_dir).select("step")
    return _out(sampling.schedule(steps, 100.0, 900.0))


# --- manifests and mixtures --------------------------------------------------------------------------------


@_query(f"""SELECT grp, item, ord, CASE WHEN ord <= floor(n * 0.7) THEN 'train' ELSE 'val' END AS split FROM (SELECT c_mktsegment AS grp, c_name AS item,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_md5(0, 'split', 'c_mktsegment', 'c_name')}, c_name)::INT AS ord, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)""")  # fmt: skip
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.split_manifest(views.manifest(spark, sf_dir), 0.7)


SHARES = {"F": 0.1}
_MIX = """SELECT source, physical, logical, coalesce(sum(logical) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
    FROM (SELECT o_orderstatus AS source, count(*) AS physical, floor(count(*) * CASE WHEN o_orderstatus = 'F' THEN 0.1 ELSE 1.0 END)::BIGINT AS logical FROM orders GROUP BY 1)"""


@_query(_MIX)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(views.mix(spark, sf_dir), SHARES)


@_query(f"""WITH m AS ({_MIX}), p AS (SELECT o_orderstatus AS source, o_orderkey AS item, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS at_row FROM orders),
    t AS (SELECT *, (((at_row - 3 * logical) % physical) + physical) % physical AS turn FROM p JOIN m USING (source)) SELECT (first + turn)::BIGINT AS idx, source, item FROM t WHERE turn < logical""")  # fmt: skip
def mix_epoch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_epoch(views.mix(spark, sf_dir), SHARES, 3)


_EPOCHS_SQL = f"""SELECT epoch, (first + turn)::BIGINT AS idx, source, item, reads, CASE WHEN val THEN '0' ELSE md5(concat_ws('|', '0', 'read', item, reads)) END AS draw, val
    FROM (SELECT *, (((at_row - epoch * logical) % physical) + physical) % physical AS turn, (SELECT count(*) FROM range(5) AS h(past) WHERE past < epoch AND (((at_row - past * logical) % physical) + physical) % physical < logical) AS reads
        FROM p JOIN m USING (source), range(5) AS g(epoch), (VALUES (true), (false)) AS v(val)) WHERE turn < logical"""


@_query(f"""WITH m AS ({_MIX}), p AS (SELECT o_orderstatus AS source, o_orderkey AS item, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS at_row FROM orders), e AS ({_EPOCHS_SQL})
    SELECT epoch::INT AS epoch, idx, source, item, reads, draw, val FROM e WHERE epoch >= 2""")  # fmt: skip
def epoch_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds for what epochs draw, by item and how often it has been read; of validation too."""
    items = views.mix(spark, sf_dir)
    both = [mixing.mix_epochs(items, SHARES, range(2, 5), validation=v).withColumn("val", F.lit(v)) for v in (False, True)]
    return both[0].unionByName(both[1])


#: A mixture of the scenes that shows two of the three an epoch.
SCENES = {"scan": 0.67}


@_query(_with("big_cloud",
    m="SELECT 'scan' AS source, count(*) AS physical, floor(count(*) * 0.67)::BIGINT AS logical, 0 AS first FROM (SELECT DISTINCT shape_id FROM big_cloud)",
    p="SELECT 'scan' AS source, shape_id AS item, row_number() OVER (ORDER BY shape_id) - 1 AS at_row FROM (SELECT DISTINCT shape_id FROM big_cloud)",
    shown=_EPOCHS_SQL,
    drawn="SELECT b.shape_id, x, y, z, epoch, reads, draw, val FROM big_cloud b JOIN shown ON item = b.shape_id WHERE epoch < 3",
    **_random_boxes_sql(0.2, 0.5, 0.2, "drawn", "draw"),
    body=f"SELECT epoch::INT AS epoch, shape_id, reads, val, count(*) AS n, {_r('sum(x)', 'total')} FROM cropped GROUP BY ALL"))
def crop_by_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random crops of scenes that three epochs read: others at each read, but the same in validation."""
    points = views.big_cloud(spark, sf_dir).select("shape_id", "x", "y", "z")
    items = points.select(F.lit("scan").alias("source"), F.col("shape_id").alias("item")).distinct()
    both = [mixing.mix_epochs(items, SCENES, range(3), validation=v).withColumn("val", F.lit(v)) for v in (False, True)]
    shown = both[0].unionByName(both[1]).select(F.col("item").alias("shape_id"), "epoch", "reads", "draw", "val")
    cut = crop.crop_random(ranks.with_group(points, shown, "shape_id"), 0.2, 0.5, 0.2, "draw")
    return _out(cut.groupBy("epoch", "shape_id", "reads", "val").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")))


@_query("SELECT event_id AS batch_idx, event_type AS name FROM events WHERE event_id > 400 OR event_id IN (1, 5, 7)")
def focus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = views.metric_log(spark, sf_dir).select(F.col("step").alias("batch_idx"), "name")
    return batches.where(mixing.focus("g400") | mixing.focus("1,5,7"))


@_query(f"""WITH m AS (SELECT c_mktsegment AS grp, c_name AS item, c_acctbal < 0 AS lost FROM customer), t AS (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY item) AS rank, count(*) OVER (PARTITION BY grp) AS n FROM m WHERE NOT lost)
    SELECT grp, item, item AS read FROM t UNION ALL SELECT m.grp, m.item, t.item FROM m JOIN t ON m.grp = t.grp AND t.rank = floor({_u(0, 'substitute', 'm.grp', 'm.item')} * t.n)::BIGINT + 1 WHERE lost""")  # fmt: skip
def substitute_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = views.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_mktsegment").alias("grp"), F.col("c_name").alias("item"))
    return mixing.substitute_missing(views.manifest(spark, sf_dir), missing)


# --- neighbours ------------------------------------------------------------------------------------------


def _knn(k: int, queries: str = "small_cloud", refs: str = "small_cloud") -> str:
    return f"""SELECT * FROM (SELECT q.shape_id, q.point_id AS query_id, r.point_id AS ref_id, (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z) AS d2,
        row_number() OVER (PARTITION BY q.shape_id, q.point_id ORDER BY d2, r.point_id)::INT AS rank, q.x - r.x AS rx, q.y - r.y AS ry, q.z - r.z AS rz, r.nx, r.ny, r.nz,
        r.nx * (q.x - r.x) + r.ny * (q.y - r.y) + r.nz * (q.z - r.z) AS dot FROM {queries} q JOIN {refs} r USING (shape_id)) WHERE rank <= {k}"""


@_query(_with("pred", "gt", near=_knn(8, "pred", "gt"), body=f"SELECT shape_id, query_id, ref_id, rank, {_r('d2', 'd2')} FROM near"))
def knn_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.knn(knn.as_queries(views.pred(spark, sf_dir)), knn.as_refs(views.gt(spark, sf_dir)), 8)
    return _out(found.select("shape_id", "query_id", "ref_id", "rank", "d2"))


@_query(_with("pred", "gt", near=_knn(8, "pred", "gt"), body=f"SELECT shape_id, query_id, ref_id, rank, {_r('d2', 'd2')} FROM near"))
def knn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the grid, whatever the size."""
    found = knn.grid(knn.as_queries(views.pred(spark, sf_dir)), knn.as_refs(views.gt(spark, sf_dir)), 8, 0.1)
    return _out(found.select("shape_id", "query_id", "ref_id", "rank", "d2"))


@_query(_with("small_cloud", near=_knn(8), body=f"SELECT shape_id, query_id AS point_id, {_r('avg(sqrt(d2))', 'spacing')} FROM near GROUP BY ALL"))
def knn_self_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(knn.spacing(views.small_cloud(spark, sf_dir), 8))


_WITHIN = """SELECT q.shape_id, q.point_id AS query_id, r.point_id AS ref_id, (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z) AS d2
    FROM pred q JOIN gt r USING (shape_id) WHERE d2 < 0.15 * 0.15"""


@_query(_with("pred", "gt", hit=_WITHIN, body=f"SELECT shape_id, query_id, ref_id, rank, hits, {_r('d2', 'd2')} FROM (SELECT *, row_number() OVER (PARTITION BY shape_id, query_id ORDER BY d2, ref_id)::INT AS rank, count(*) OVER (PARTITION BY shape_id, query_id) AS hits FROM hit) WHERE rank <= 4"))
def radius_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.radius(knn.as_queries(views.pred(spark, sf_dir)), knn.as_refs(views.gt(spark, sf_dir)), 0.15, 4)
    return _out(found.select("shape_id", "query_id", "ref_id", "rank", "hits", "d2"))


@_query(_with("pred", "gt", hit=_WITHIN, body="SELECT p.shape_id, p.point_id AS query_id, least(count(h.ref_id), 6) AS hits FROM pred p LEFT JOIN hit h ON p.shape_id = h.shape_id AND p.point_id = h.query_id GROUP BY ALL"))
def radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.radius_count(knn.as_queries(views.pred(spark, sf_dir)), knn.as_refs(views.gt(spark, sf_dir)), 0.15, 6)


@_query(_with("big_cloud", cells=_CELLS(0.1, "big_cloud"), spots="SELECT shape_id, i * 10000 + j * 100 + k AS query_id, (i + 0.5::DOUBLE) * 0.1::DOUBLE AS x, (j + 0.5::DOUBLE) * 0.1::DOUBLE AS y, (k + 0.5::DOUBLE) * 0.1::DOUBLE AS z FROM cells",
    hit="SELECT q.shape_id, q.query_id, count(*) AS n FROM spots q JOIN big_cloud r ON q.shape_id = r.shape_id WHERE (q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z) < 0.3 * 0.3 GROUP BY ALL",
    body="SELECT shape_id, query_id, least(coalesce(n, 0), 1000000) AS hits FROM spots LEFT JOIN hit USING (shape_id, query_id)"))
def radius_count_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points of a scene lie around the middle of each of its cells: large shapes, counted by whole nodes."""
    cloud = views.big_cloud(spark, sf_dir).select("shape_id", "point_id", "x", "y", "z")
    spots = volume.centres(sampling.voxels(cloud, 0.1), 0.1).withColumn("point_id", (F.col("i") * 10000 + F.col("j") * 100 + F.col("k")).cast("long"))
    return knn.radius_count(knn.as_queries(spots), knn.as_refs(cloud), 0.3, 1_000_000)


_ROOM = "least(" + ", ".join(f"q{a} - (floor(q{a} / 0.25) * 0.25 - 0.2), floor(q{a} / 0.25) * 0.25 + 0.45 - q{a}" for a in "xyz") + ")"


@_query(_with("small_cloud", near=_knn(4), body=f"""SELECT shape_id, point_id, whole, CASE WHEN whole THEN {_r('mean')[:-8]} END AS spacing FROM (SELECT n.shape_id, query_id AS point_id, avg(sqrt(d2)) AS mean, count(*) = 4 AND sqrt(max(d2)) < any_value({_ROOM}) AS whole
    FROM near n JOIN (SELECT shape_id, point_id AS query_id, x AS qx, y AS qy, z AS qz FROM small_cloud) USING (shape_id, query_id) GROUP BY ALL)"""))  # fmt: skip
def spacing_by_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing found by overlapping chunks, where these hold all the nearest of a point; the SQL looks at whole shapes."""
    found = chunks.neighbourhoods(views.small_cloud(spark, sf_dir), 4, 0.25, 0.2)
    return _out(found.select("shape_id", "point_id", "whole", F.when(F.col("whole"), F.col("spacing")).alias("spacing")))


@_query(_with("pred", "gt", body=f"""SELECT shape_id, query_id, ref_id, {_r('d', 'l1')} FROM (SELECT q.shape_id, q.point_id AS query_id, r.point_id AS ref_id, abs(q.x - r.x) + abs(q.y - r.y) + abs(q.z - r.z) AS d,
    row_number() OVER (PARTITION BY q.shape_id, q.point_id ORDER BY d, r.point_id) AS n FROM pred q JOIN gt r USING (shape_id)) WHERE n <= 3"""))  # fmt: skip
def knn_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.knn(knn.as_queries(views.pred(spark, sf_dir)), knn.as_refs(views.gt(spark, sf_dir)), 3, metric="l1")
    return _out(found.select("shape_id", "query_id", "ref_id", F.col("d2").alias("l1")))


@_query(_with("pred", "gt", near=_knn(1, "pred", "gt"), body=f"SELECT n.shape_id, n.query_id, {_r('g.r', 'r')}, {_r('g.g', 'g')}, {_r('g.b', 'b')} FROM near n JOIN gt g ON n.shape_id = g.shape_id AND n.ref_id = g.point_id"))
def nearest_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(knn.nearest_colour(views.pred(spark, sf_dir), views.gt(spark, sf_dir)))


@_query()
def knn_grid_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest of every point of the scenes; too many pairs for SQL, so tests compare a small scene with brute force."""
    cloud = views.big_cloud(spark, sf_dir).select("shape_id", "point_id", "x", "y", "z")
    return knn.among(cloud, 8).select("shape_id", "query_id", "ref_id", "rank", "d2")


@_query()
def normals_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normals.estimate(views.small_cloud(spark, sf_dir), 16)


# --- signed distance ----------------------------------------------------------------------------------------

_STD = "SELECT shape_id, query_id AS ref_id, avg(sqrt(d2)) AS std FROM self GROUP BY ALL"


def _vote_sql(stdv: float, std: str = "1.0", k: int = 8) -> str:
    return f"""SELECT shape_id, query_id, sign, tangent, sign * CASE WHEN tangent THEN abs(dot) ELSE sqrt(d2) END AS sdf, dot, d2, rx, ry, rz, nx, ny, nz FROM (SELECT *, CASE WHEN votes > {k // 2} THEN 1.0 ELSE -1.0 END AS sign, sqrt(d2) < {stdv} * {std} AS tangent
        FROM (SELECT *, sum((dot > 0)::INT) OVER (PARTITION BY shape_id, query_id) AS votes FROM near){" JOIN spaced USING (shape_id, ref_id)" if std == "std" else ""} WHERE rank = 1)"""


_NEAR = {"near": _knn(8, "pred", "gt")}


@_query(_with("pred", "gt", **_NEAR, voted=_vote_sql(0.02), body=f"SELECT shape_id, query_id, {_r('sdf', 'sdf')} FROM voted"))
def sdf_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sdf.vote(views.pred(spark, sf_dir), views.gt(spark, sf_dir), 8, 0.02))


@_query(_with("pred", "gt", **_NEAR, voted=_vote_sql(0.08), body=f"""SELECT shape_id, query_id, {_r('sdf', 'sdf')}, {', '.join(_r(f'sign * CASE WHEN tangent THEN CASE WHEN dot > 0 THEN 1 ELSE -1 END * n{a} ELSE coalesce(r{a} / nullif(sqrt(d2), 0), 0) END', f'g{a}') for a in _AXES)} FROM voted"""))
def sdf_vote_grad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sdf.vote(views.pred(spark, sf_dir), views.gt(spark, sf_dir), 8, 0.08, gradient=True))


@_query(_with("pred", "gt", **_NEAR, self=_knn(8, "gt", "gt"), spaced=_STD, voted=_vote_sql(3.0, "std"), body=f"SELECT shape_id, query_id, {_r('-sdf', 'sdf')} FROM voted"))
def sdf_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sdf.geometry_sdf(views.pred(spark, sf_dir), views.gt(spark, sf_dir)))


@_query(_with("pred", "gt", **_NEAR, w="SELECT *, exp((min(d2) OVER (PARTITION BY shape_id, query_id) - d2) / (0.1 * 0.1)) AS w FROM near", body=f"SELECT shape_id, query_id, {_r('sum(dot * w) / sum(w)', 'sdf')}, {', '.join(_r(f'sum(n{a} * w) / sum(w)', f'g{a}') for a in _AXES)} FROM w GROUP BY ALL"))
def sdf_imls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sdf.imls(views.pred(spark, sf_dir), views.gt(spark, sf_dir), 8, 0.1))


def _truncated(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    found = sdf.point_sdf(views.pred(spark, sf_dir), views.gt(spark, sf_dir))
    return _out(found.select("shape_id", "query_id", column(F.col("sdf")).alias("value")))


_POINT = {**_NEAR, "voted": _vote_sql(0.02)}


@_query(_with("pred", "gt", **_POINT, body=f"SELECT shape_id, query_id, {_r('0.1 * tanh(-sdf / 0.1)', 'value')} FROM voted"))
def tsdf_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, lambda v: sdf.truncate(v, 0.1))


@_query(_with("pred", "gt", **_POINT, body=f"SELECT shape_id, query_id, {_r('greatest(-0.1, least(-sdf, 0.1))', 'value')} FROM voted"))
def tsdf_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, lambda v: sdf.truncate(v, 0.1, soft=False))


@_query(_with("pred", "gt", **_POINT, body=f"SELECT shape_id, query_id, {_r('abs(0.1 * tanh(-sdf / 0.1))', 'value')} FROM voted"))
def tudf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, lambda v: F.abs(sdf.truncate(v, 0.1)))


# --- volumes and losses ----------------------------------------------------------------------------------------

LATTICE = volume.Lattice((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (16, 16, 16))
_PLACE = lambda a: f"greatest(0, least(15, round_even(({a} - 0.0) / (1.0 - 0.0) * 15, 0)))::INT"


@_query(_with("volume", body=f"""SELECT q.shape_id, q.point_id, CASE WHEN NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND z BETWEEN 0 AND 1) OR val IS NULL THEN 2 WHEN abs(val) < 0.02 THEN 0 ELSE 1 END AS kind
    FROM (SELECT shape_id, point_id, x, y * 1.5 - 0.25 AS y, z FROM big_cloud) q LEFT JOIN volume v ON q.shape_id = v.shape_id AND v.i = {_PLACE('q.x')} AND v.j = {_PLACE('q.y')} AND v.k = {_PLACE('q.z')}"""))  # fmt: skip
def volume_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.big_cloud(spark, sf_dir).select("shape_id", "point_id", "x", (F.col("y") * 1.5 - 0.25).alias("y"), "z")
    return volume.classify(points, views.volume(spark, sf_dir), LATTICE, 0.02).select("shape_id", "point_id", "kind")


def _record_sql(role: str) -> str:
    """Points of a role under the chain of record_chain: centred by pred's bounds, doubled, and turned about z."""
    mid = lambda a: f"(({a}0 + {a}1) / 2.0 + ({a}1 - {a}0) * 0.1 * ({_u(3, f'centre.{a}', 'shape_id')} * 2.0 - 1.0))"
    at = ", ".join(f"({p}{a} - {mid(a)}) * 2.0 AS {p}{a}" for p in ("", "s") for a in "xyz")
    angle = f"((-30.0 + 60.0 * {_u(5, 'rotate.z', 'shape_id')}) * {math.pi / 180.0!r})"
    turned = ", ".join(f"{_r(f'cos(t) * {p}x - sin(t) * {p}y', p + 'x')}, {_r(f'sin(t) * {p}x + cos(t) * {p}y', p + 'y')}" for p in ("", "s", "n"))
    return f"SELECT '{role}' AS role, shape_id, point_id, {turned}, {_r('z', 'z')}, {_r('sz', 'sz')} FROM (SELECT shape_id, point_id, nx, ny, {at}, {angle} AS t FROM {role} JOIN frame USING (shape_id))"


@_query(_with("pred", "gt", frame="SELECT shape_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM pred GROUP BY shape_id", body=f"{_record_sql('pred')} UNION ALL {_record_sql('gt')}"))
def record_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain over records of two roles: what is drawn and measured on the input moves the true points too."""
    chain = [{"name": "Centralize", "args": {"noise": 0.1, "seed": 3}}, {"name": "FixedScale", "args": {"scale": 2.0}}, {"name": "FixedAxisRotation", "args": {"axis": "z", "deg_min": -30.0, "deg_max": 30.0, "seed": 5}}]
    record = records.compose(chain)(records.Record(views.pred(spark, sf_dir), gt=views.gt(spark, sf_dir)))
    both = [df.select(F.lit(role).alias("role"), "shape_id", "point_id", *(p + a for p in ("", "s", "n") for a in "xy"), "z", "sz") for role, df in (("pred", record.input), ("gt", record.gt))]
    return _out(both[0].unionByName(both[1]))


_RECORD_LOW, _RECORD_HIGH = (-0.31, -0.2, -0.45), (0.27, 0.33, 0.41)
_TICKED = ", ".join(
    f"list_transform(range(16), lambda i: (0.0 - m{a}) * f + (((1.0 - m{a}) * f - (0.0 - m{a}) * f) / 15) * i) AS t{a}" for a in "xyz")
_CUT = ", ".join(
    f"greatest(0, len(list_filter(t{a}, lambda t: t <= {low})) - 1)::INT AS first_{a}, least(len(list_filter(t{a}, lambda t: t < {high})), 15)::INT AS last_{a}" for a, low, high in zip("xyz", _RECORD_LOW, _RECORD_HIGH, strict=True))


@_query(_with("volume", body=f"""SELECT shape_id, {', '.join(f"{_r(f't{a}[first_{a} + 1]', f'min_{a}')}, {_r(f't{a}[last_{a} + 1]', f'max_{a}')}, last_{a} - first_{a} + 1 AS cells_{a}" for a in 'xyz')},
    (SELECT count(*) FROM big_cloud p WHERE p.shape_id = c.shape_id AND {' AND '.join(f"(p.{a} - m{a}) * f > {low} AND (p.{a} - m{a}) * f < {high}" for a, low, high in zip('xyz', _RECORD_LOW, _RECORD_HIGH, strict=True))}) AS points,
    (SELECT count(*) FROM volume v WHERE v.shape_id = c.shape_id AND v.i BETWEEN first_x AND last_x AND v.j BETWEEN first_y AND last_y AND v.k BETWEEN first_z AND last_z) AS cells FROM c""",
    m="SELECT shape_id, (min(x) + max(x)) / 2.0 AS mx, (min(y) + max(y)) / 2.0 AS my, (min(z) + max(z)) / 2.0 AS mz, greatest((max(x) - min(x)) / 2.0, (max(y) - min(y)) / 2.0, (max(z) - min(z)) / 2.0) AS h FROM big_cloud GROUP BY shape_id",
    s="SELECT *, greatest(0.6, least(h, 0.9)) / h AS f FROM m", t=f"SELECT *, {_TICKED} FROM s", c=f"SELECT *, {_CUT} FROM t"))
def record_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain over records with a volume: scaled with the input's bounds and cut to the ticks that cover a box."""
    cloud = views.big_cloud(spark, sf_dir).select("shape_id", "point_id", "x", "y", "z")
    lattices = cloud.select("shape_id").distinct().withColumns(volume.lattice_of(LATTICE))
    chain = [{"name": "BoundScale", "args": {"min_a": 0.6, "max_a": 0.9}}, {"name": "FixedBBoxCrop", "args": {"bbox_min": _RECORD_LOW, "bbox_max": _RECORD_HIGH}}]
    record = records.compose(chain)(records.Record(cloud, volume=views.volume(spark, sf_dir), lattices=lattices))
    counts = [df.groupBy("shape_id").agg(F.count(F.lit(1)).alias(name)) for df, name in ((record.input, "points"), (record.volume, "cells"))]
    return _out(record.lattices.join(counts[0], "shape_id").join(counts[1], "shape_id").select("shape_id", *volume.LATTICE, "points", "cells"))


# Lattices of two kinds: those of shape A and of the others; the outer cells on the first axis are unknown.
_LATTICE_LOW, _LATTICE_HIGH, _LATTICE_CELLS = "(CASE WHEN q.shape_id = 'A' THEN 0.0 ELSE -0.25 END)", "(CASE WHEN q.shape_id = 'A' THEN 1.0 ELSE 1.5 END)", "(CASE WHEN q.shape_id = 'A' THEN 16 ELSE 20 END)"
_LATTICE_AT = lambda a: f"greatest(0, least({_LATTICE_CELLS} - 1, round_even((q.{a} - {_LATTICE_LOW}) / ({_LATTICE_HIGH} - {_LATTICE_LOW}) * ({_LATTICE_CELLS} - 1), 0)))::INT"
_LATTICE_BETWEEN = " AND ".join(f"{a} BETWEEN {_LATTICE_LOW} AND {_LATTICE_HIGH}" for a in "xyz")


def _lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("shape_id") == "A"
    sides = {f"{side}_{a}": F.when(first, own).otherwise(others) for side, own, others in (("min", 0.0, -0.25), ("max", 1.0, 1.5)) for a in "xyz"}
    return views.big_cloud(spark, sf_dir).select("shape_id").distinct().withColumns(sides | {f"cells_{a}": F.when(first, 16).otherwise(20) for a in "xyz"})


def _geometry_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Geometry files of lattices of two kinds under the shared folder."""
    from .sources import files, storage

    folder = storage.shared_dir(spark, "geometry")
    files.write_npz(views.big_cloud(spark, sf_dir).select("shape_id", "point_id", "x", "y", "z"), folder, views.volume(spark, sf_dir).where("i between 2 and 13"), _lattices(spark, sf_dir))
    return files.list_files(folder, ".npz")


@_query(_with("volume", body=f"""SELECT q.shape_id, q.point_id, CASE WHEN NOT ({_LATTICE_BETWEEN}) OR val IS NULL THEN 2 WHEN abs(val) < 0.02 THEN 0 ELSE 1 END AS kind
    FROM (SELECT shape_id, point_id, x, y * 1.5 - 0.25 AS y, z FROM big_cloud) q LEFT JOIN volume v ON q.shape_id = v.shape_id AND v.i BETWEEN 2 AND 13 AND v.i = {_LATTICE_AT('x')} AND v.j = {_LATTICE_AT('y')} AND v.k = {_LATTICE_AT('z')}"""))  # fmt: skip
def volume_classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points classified by the volumes of geometry files, each on its own lattice."""
    from .sources import files

    paths = _geometry_files(spark, sf_dir)
    points = views.big_cloud(spark, sf_dir).select("shape_id", "point_id", "x", (F.col("y") * 1.5 - 0.25).alias("y"), "z")
    return volume.classify(points, files.read_volumes(spark, paths), files.read_lattices(spark, paths), 0.02).select("shape_id", "point_id", "kind")


@_query(_with("volume", body=f"""SELECT q.shape_id, {_LATTICE_LOW}::DOUBLE AS min_x, {_LATTICE_HIGH}::DOUBLE AS max_z, {_LATTICE_CELLS} AS cells_x, {_LATTICE_CELLS} AS cells_y, {_LATTICE_CELLS} AS cells_z,
    count(v.val) AS n, min(v.i)::INT AS first, max(v.i)::INT AS last, {_r('sum(v.val)', 'total')} FROM (SELECT DISTINCT shape_id FROM big_cloud) q LEFT JOIN volume v ON q.shape_id = v.shape_id AND v.i BETWEEN 2 AND 13 GROUP BY ALL"""))  # fmt: skip
def lattice_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattices of geometry files whose outer cells are unknown, with what their cells amount to."""
    from .sources import files

    paths = _geometry_files(spark, sf_dir)
    cells = files.read_volumes(spark, paths).groupBy("shape_id").agg(F.count("val").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"), F.sum("val").alias("total"))
    return _out(files.read_lattices(spark, paths).join(cells, "shape_id").select("shape_id", "min_x", "max_z", "cells_x", "cells_y", "cells_z", "n", "first", "last", "total"))


@_query(_with("volume", body=f"SELECT shape_id, i - 3 AS i, j - 4 AS j, k - 5 AS k, {_r('val', 'val')} FROM volume WHERE i BETWEEN 3 AND 9 AND j BETWEEN 4 AND 11 AND k BETWEEN 5 AND 14"))
def volume_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(volume.crop(views.volume(spark, sf_dir), LATTICE, (0.21, 0.3, 0.35), (0.59, 0.7, 0.93))[0])


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.small_cloud(spark, sf_dir).select("shape_id", F.pmod("point_id", F.lit(3)).cast("int").alias("kind"), F.col("x").alias("truth"), F.col("y").alias("value"), F.col("nx"), F.col("ny"), F.col("nz"), F.col("sx").alias("gx"), F.col("sy").alias("gy"), F.col("sz").alias("gz"))


@_query(_with("small_cloud", body=f"SELECT shape_id, {_r('(coalesce(sum(abs(y - x) / 0.1) FILTER (WHERE point_id % 3 = 0), 0) + coalesce(sum(0.1 * exp(y / 0.2)) FILTER (WHERE point_id % 3 = 1), 0)) / count(*)', 'loss')} FROM small_cloud GROUP BY shape_id"))
def loss_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.spatial_loss(_field(spark, sf_dir), 0.1))


@_query(_with("small_cloud", body=f"SELECT shape_id, {_r('avg(0.5 / (y * y + 0.25))', 'loss')} FROM small_cloud GROUP BY shape_id"))
def loss_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.sharpness_loss(_field(spark, sf_dir)))


@_query(_with("small_cloud", body=f"SELECT shape_id, {_r('avg(abs(y - x)) / 0.1', 'loss')} FROM small_cloud GROUP BY shape_id"))
def loss_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.unsigned_loss(_field(spark, sf_dir), 0.1))


@_query(_with("small_cloud", body=f"SELECT shape_id, {_r('avg(abs(y))', 'value_loss')}, {_r('1 - avg(-(sx * nx + sy * ny + sz * nz) / (sqrt(sx * sx + sy * sy + sz * sz) + 1e-6))', 'normal_loss')} FROM small_cloud GROUP BY shape_id"))
def loss_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.surface_loss(_field(spark, sf_dir)))


@_query(_with("small_cloud", body=f"""SELECT level, {_r('avg(ln(exp(x) + exp(y) + exp(z)) - [x, y, z][truth + 1])', 'cross_entropy')}, {_r('avg((CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END = truth)::INT)', 'accuracy')}
    FROM (SELECT (point_id % 4)::INT AS level, (point_id % 3)::INT AS truth, x, y, z FROM small_cloud) GROUP BY level"""))  # fmt: skip
def loss_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.small_cloud(spark, sf_dir).select((F.col("point_id") % 4).cast("int").alias("level"), F.array("x", "y", "z").alias("logits"), (F.col("point_id") % 3).cast("int").alias("truth"))
    return _out(metrics.structure_loss(rows))


@_query(f"SELECT step % 100 AS step, {_r('sum(CASE name WHEN ' + chr(39) + 'click' + chr(39) + ' THEN 2.0 WHEN ' + chr(39) + 'view' + chr(39) + ' THEN 0.5 ELSE 0.0 END * value)', 'total')} FROM (SELECT event_id AS step, event_type AS name, value FROM events) GROUP BY 1")
def loss_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.metric_log(spark, sf_dir).withColumn("step", F.col("step") % 100)
    return _out(metrics.total_loss(log, {"click": 2.0, "view": 0.5}))


# --- reports --------------------------------------------------------------------------------------------------


@_query(f"SELECT event_type AS name, count(value) AS n, {_r('avg(value)', 'mean')} FROM events GROUP BY 1")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(report.summary(views.metric_log(spark, sf_dir)))


@_query(f"SELECT event_id AS step, event_type AS name, {_r('value', 'value')}, {_r('min(value) OVER (PARTITION BY event_type ORDER BY event_id)', 'best')} FROM events")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(report.best_so_far(views.metric_log(spark, sf_dir)))


@_query("SELECT event_id AS step, sum((value > 90)::INT) OVER (ORDER BY event_id)::BIGINT AS failures FROM events")
def failed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.running_failures(views.metric_log(spark, sf_dir), F.col("value") > 90)


PIVOT = ("click", "error", "purchase", "signup", "view")


@_query(f"SELECT event_id // 100 AS step, {', '.join(_r(f'avg(value) FILTER (WHERE event_type = {chr(39)}{n}{chr(39)})', n) for n in PIVOT)} FROM events GROUP BY 1")
def log_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.metric_log(spark, sf_dir).withColumn("step", F.floor(F.col("step") / 100))
    return _out(report.wide(log, ["step"], list(PIVOT)))


@_query(f"SELECT event_id::VARCHAR AS \"batch-idx\", coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END, '-') AS name, '-' AS absent FROM events")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = views.metric_log(spark, sf_dir).select(F.col("step").alias("batch-idx"), F.when(F.col("step") % 3 == 0, None).otherwise(F.col("name")).alias("name"), F.col("value").alias("later"))
    return report.result_rows(frame, ["name", "absent"])


@_query(f"SELECT event_id AS step, {_r('0.1 * greatest(pow(0.5, floor(event_id / 50.0)), 0.001 / 0.1)', 'rate')} FROM events")
def learning_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(report.learning_rate(views.metric_log(spark, sf_dir).select("step"), 0.1, 0.5, 50.0, 0.001))


# --- functions --------------------------------------------------------------------------------------------------


@_query(_with("small_cloud", body=f"""SELECT point_id, {_r('x * nx + y * ny + z * nz', 'dot')}, {_r('sqrt(x * x + y * y + z * z)', 'norm')}, {_r('y * nz - z * ny', 'cross_x')}, {_r('x / sqrt(x * x + y * y + z * z)', 'unit_x')},
    {_r('x - nx * ((nx * x + ny * y + nz * z) * 2)', 'reflect_x')}, {_r('-x', 'minus')}, {_r('x + nx', 'plus')}, {_r('x - nx', 'less')}, {_r('x * nx', 'times')}, {_r('x / nx', 'over')}, {_r('least(x, nx)', 'low')}, {_r('greatest(x, nx)', 'high')}, {_r('x + 0.25 * (y - x)', 'mixed')},
    {_r('greatest(-0.05, least(x, 0.05))', 'clamped')}, {_r('x * 10 - floor(x * 10)', 'part')}, (CASE WHEN x > 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS sign, {_r('abs(x)', 'size')},
    {_r('greatest(0.0, least((x + 0.1) / 0.2, 1.0)) * greatest(0.0, least((x + 0.1) / 0.2, 1.0)) * (3 - 2 * greatest(0.0, least((x + 0.1) / 0.2, 1.0)))', 'smooth')}, floor(x)::BIGINT AS below, {_r('(x * 10) % 0.3::DOUBLE', 'rest')} FROM small_cloud"""))  # fmt: skip
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = Vec.of(), Vec.of("n")
    out = {
        "dot": p.dot(n), "norm": p.norm(), "cross_x": p.cross(n).x, "unit_x": p.unit().x, "reflect_x": p.reflect(n).x, "minus": (-p).x, "plus": (p + n).x, "less": (p - n).x, "times": (p * n).x, "over": (p / n).x,
        "low": p.least(n).x, "high": p.greatest(n).x, "mixed": vec.lerp("x", "y", 0.25), "clamped": vec.clamp("x", -0.05, 0.05), "part": vec.frac(F.col("x") * 10.0), "sign": vec.sign("x"), "size": p.map(F.abs).x,
        "smooth": vec.smoothstep(-0.1, 0.1, "x"), "below": p.map(F.floor).x, "rest": vec.fmod(F.col("x") * 10.0, F.lit(0.3)),
    }
    return _out(views.small_cloud(spark, sf_dir).select("point_id", *(c.alias(k) for k, c in out.items())))


@_query("""WITH told AS (SELECT c_custkey AS id, [('batch_size', (c_custkey % 5)::VARCHAR), ('beta', (c_custkey % 2)::VARCHAR || '=z'), ('big_step', (c_custkey % 7)::VARCHAR), ('use_sdf', CASE WHEN c_custkey % 3 = 0 THEN 'True' ELSE 'FALSE' END),
        ('model.net.voxel_size', c_mktsegment), ('model.__lr', '0.' || c_nationkey)] AS pairs FROM customer),
    each AS (SELECT id, unnest(range(len(pairs))) AS pos, unnest(pairs) AS pair FROM told WHERE id % 4 <> 0),
    short AS (SELECT id, pos, CASE pair[1] WHEN 'batch_size' THEN 'bs' WHEN 'beta' THEN 'b' WHEN 'big_step' THEN 'bs' WHEN 'use_sdf' THEN 'us' WHEN 'model.net.voxel_size' THEN 'mn.vs' ELSE 'm.l' END AS key,
        CASE lower(split_part(pair[2], '=', 1)) WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE split_part(pair[2], '=', 1) END AS value FROM each),
    latest AS (SELECT id, key, arg_max(value, pos) AS value FROM short GROUP BY id, key)
    SELECT c_custkey AS id, coalesce(string_agg(key || value, '-' ORDER BY key), '') AS name FROM customer LEFT JOIN latest ON id = c_custkey GROUP BY c_custkey""")  # fmt: skip
def run_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of made-up runs, one a customer; every fourth has no overrides. Of two keys that are short for the same the later one counts."""
    text = lambda c: F.col(c).cast("string")
    pairs = F.array(
        F.concat(F.lit("batch_size="), (F.col("c_custkey") % 5).cast("string")), F.concat(F.lit("beta="), (F.col("c_custkey") % 2).cast("string"), F.lit("=z")), F.concat(F.lit("big_step="), (F.col("c_custkey") % 7).cast("string")),
        F.concat(F.lit("use_sdf="), F.when(F.col("c_custkey") % 3 == 0, "True").otherwise("FALSE")), F.concat(F.lit("model.net.voxel_size="), F.col("c_mktsegment")), F.concat(F.lit("model.__lr=0."), text("c_nationkey")),
    )
    overrides = F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<string>")).otherwise(pairs)
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), mixing.run_name(overrides).alias("name"))


@_query("SELECT o_orderkey AS id, i, (('0x' || substr(md5(o_orderkey::VARCHAR), 1 + (i // 4)::INT, 1))::INT >> (3 - i % 4)::INT) & 1 = 1 AS bit FROM orders, range(12) AS g(i)")
def unpack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve bits of each order's digest."""
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unhex(F.md5(F.col("o_orderkey").cast("string"))).alias("packed"))
    return rows.select("id", F.posexplode(mixing.unpack_bits(F.col("packed"), 12)).alias("i", "bit")).select("id", F.col("i").cast("long").alias("i"), "bit")


# --- meshes, files, batches and names ------------------------------------------------------------------------------


def _triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three points with neighbouring ids are a face; all are one shape."""
    points = views.small_cloud(spark, sf_dir).withColumn("face_id", F.floor(F.col("point_id") / 3)).withColumn("corner", F.pmod("point_id", F.lit(3)))
    take = lambda k, a: F.max(F.when(F.col("corner") == k, F.col(a)))
    faces = points.groupBy("face_id").agg(*(take(k, a).alias(f"{c}{a}") for k, c in enumerate("abc") for a in "xyz"))
    return faces.where("cx is not null").withColumn("shape_id", F.lit("all"))


_TRIANGLES = "SELECT 'all' AS shape_id, point_id // 3 AS face_id, " + ", ".join(f"max({a}) FILTER (WHERE point_id % 3 = {k}) AS {c}{a}" for k, c in enumerate("pqr") for a in _AXES) + " FROM small_cloud GROUP BY ALL HAVING rx IS NOT NULL"
_U3, _V3 = ({a: f"({c}{a} - p{a})" for a in _AXES} for c in "qr")
_CROSS = {"x": f"{_U3['y']} * {_V3['z']} - {_U3['z']} * {_V3['y']}", "y": f"{_U3['z']} * {_V3['x']} - {_U3['x']} * {_V3['z']}", "z": f"{_U3['x']} * {_V3['y']} - {_U3['y']} * {_V3['x']}"}
_AREA = f"sqrt({' + '.join(f'({c}) * ({c})' for c in _CROSS.values())}) / 2"


@_query(_with("small_cloud", triangles=_TRIANGLES, sized=f"SELECT *, {_AREA} AS area, coalesce(sum({_AREA}) OVER (ORDER BY face_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM triangles",
    drawn=f"SELECT 'all' AS shape_id, draw::INT AS draw, {_u(0, 'mesh', chr(39) + 'all' + chr(39), 'draw')} * (SELECT sum(area) FROM sized) AS place, sqrt({_u(0, 'mesh.r', chr(39) + 'all' + chr(39), 'draw')}) AS r, {_u(0, 'mesh.t', chr(39) + 'all' + chr(39), 'draw')} AS t FROM range(500) AS g(draw)",
    body=f"SELECT d.shape_id, draw, face_id, {', '.join(_r(f'p{a} * (1 - r) + q{a} * (r * (1 - t)) + r{a} * (r * t)', a) for a in _AXES)} FROM drawn d JOIN sized s ON place >= start AND place < start + area"))
def mesh_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(mesh.sample(_triangles(spark, sf_dir), 500))


@_query(_with("small_cloud", triangles=_TRIANGLES, body=f"SELECT shape_id, face_id, {_r(_AREA, 'area')}, {', '.join(_r(f'({c}) / ({_AREA} * 2)', f'n{a}') for a, c in _CROSS.items())} FROM triangles"))
def mesh_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(mesh.areas(_triangles(spark, sf_dir)))


@_query(_with("small_cloud", body=f"SELECT {', '.join(_r(c, c) for c in ('x', 'y', 'z', 'nx', 'ny', 'nz', 'sx', 'sy', 'sz', 'r', 'g', 'b'))} FROM small_cloud"))
def ply_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes written as ply files under the shared folder and read back, one file a task."""
    from .sources import files, storage

    folder = storage.shared_dir(spark, "ply")
    files.write_ply(views.small_cloud(spark, sf_dir), folder)
    return _out(files.read_points(spark, "ply", files.list_files(folder, ".ply")).select("x", "y", "z", "nx", "ny", "nz", "sx", "sy", "sz", "r", "g", "b"))


@_query(_with("small_cloud", body=f"SELECT shape_id, {', '.join(_r(c, c) for c in ('x', 'y', 'z', 'nx', 'ny', 'nz', 'sx', 'sy', 'sz', 'r', 'g', 'b'))} FROM small_cloud"))
def npz_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes written as npz files under the shared folder and read back under their names."""
    from .sources import files, storage

    cloud, folder = views.small_cloud(spark, sf_dir), storage.shared_dir(spark, "npz")
    files.write_npz(cloud, folder)
    names = {files.file_name(r[0]): r[0] for r in cloud.select("shape_id").distinct().collect()}  # a name a file, as the list of files has them
    paths = files.list_files(folder, ".npz")
    return _out(files.read_points(spark, "npz", paths, names=[names[files.stem(p)] for p in paths]).select("shape_id", "x", "y", "z", "nx", "ny", "nz", "sx", "sy", "sz", "r", "g", "b"))


def _names(rows: DataFrame) -> dict[str, str]:
    """Shapes by the name of their file, of which the list of files has one each as well."""
    from .sources import files

    return {files.file_name(r[0]): r[0] for r in rows.select("shape_id").where("shape_id is not null").distinct().collect()}


@_query(_with("small_cloud", body=f"SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY point_id) - 1 AS point_id, {', '.join(_r(c, c) for c in ('x', 'nz', 'b'))} FROM small_cloud"))
def ply_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes written as ply files and read back by ranges of some 20 records, which number their points in the file."""
    from .sources import files, storage

    cloud, folder = views.small_cloud(spark, sf_dir), storage.shared_dir(spark, "ply")
    files.write_ply(cloud, folder)
    names, paths = _names(cloud), files.list_files(folder, ".ply")
    return _out(files.read_points(spark, "ply", paths, names=[names[files.stem(p)] for p in paths], split_bytes=2000).select("shape_id", "point_id", "x", "nz", "b"))


@_query(_with("small_cloud",
    m="SELECT shape_id AS item, right(shape_id, 1) IN ('3', '7') AS lost FROM (SELECT DISTINCT shape_id FROM small_cloud)",
    t="SELECT item, row_number() OVER (ORDER BY item) AS rank, count(*) OVER () AS n FROM m WHERE NOT lost",
    d="SELECT item, item AS read FROM t UNION ALL SELECT m.item, t.item FROM m JOIN t ON t.rank = floor(" + _u(0, "substitute", "'all'", "m.item") + " * t.n)::BIGINT + 1 WHERE lost",
    body=f"SELECT d.item AS shape_id, read, count(*) AS n, {_r('sum(c.x)', 'total')} FROM d JOIN small_cloud c ON c.shape_id = d.read GROUP BY ALL"))
def fetch_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes fetched from files of which those of labels that end in 3 are cut off and in 7 missing: others take their places."""
    from .sources import files, storage

    cloud, folder = views.small_cloud(spark, sf_dir), storage.shared_dir(spark, "fetch")
    files.write_ply(cloud.where("right(shape_id, 1) <> '7'"), folder)
    names = _names(cloud)
    for name, shape in names.items():
        if shape.endswith("3"):
            files.write_bytes(f"{folder}/{name}.ply", files.read_bytes(f"{folder}/{name}.ply")[:-8])
    rows = files.fetch(spark, "ply", [f"{folder}/{n}.ply" for n in names], list(names.values()), skip_on_error=True)
    return _out(rows.groupBy("shape_id", "read").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")))


@_query(_with("small_cloud", triangles=_TRIANGLES, body=f"SELECT (face_id % 3)::INT AS batch, {', '.join(_r(f'{p}{a}', f'{c}{a}') for p, c in zip('pqr', 'abc', strict=True) for a in _AXES)} FROM triangles"))
def mesh_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meshes written as artifacts mesh/<batch>.ply of vertices and faces, and read back."""
    from .sources import files, storage

    folder = storage.shared_dir(spark, "artifacts")
    rows = _triangles(spark, sf_dir).drop("shape_id").withColumns({"key": F.lit("mesh"), "batch_idx": F.col("face_id") % 3})
    files.write_artifacts(rows, folder, "mesh")
    back = files.read_meshes(spark, files.list_files(folder, ".ply", nested=True), kind="ply")
    return _out(back.select(F.col("shape_id").cast("int").alias("batch"), *(f"{c}{a}" for c in "abc" for a in "xyz")))


@_query(_with("volume", body=f"SELECT shape_id, i::INT AS i, j::INT AS j, k::INT AS k, {_r('val')}, 0.0::DOUBLE AS min_x, 1.0::DOUBLE AS max_z FROM volume"))
def geometry_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes written beside points in geometry files under the shared folder, and read back."""
    from .sources import files, storage

    folder = storage.shared_dir(spark, "geometry")
    cells = views.volume(spark, sf_dir).select("*", *(F.lit(v).alias(f"{side}_{a}") for side, v in (("min", 0.0), ("max", 1.0)) for a in "xyz"))
    points = cells.select("shape_id", (F.col("i") * 256 + F.col("j") * 16 + F.col("k")).cast("long").alias("point_id"), *((F.col(n) / 16.0).alias(a) for a, n in zip("xyz", "ijk", strict=True)))
    files.write_npz(points, folder, cells)
    return _out(files.read_volumes(spark, files.list_files(folder, ".npz")).select("shape_id", "i", "j", "k", "val", "min_x", "max_z"))


_TOLD = "SELECT event_id // 100 AS step, event_type AS name, value, event_id // 100 % 4 AS part FROM events"


def _last_of(name: str) -> str:
    """A metric of the frame in SQL: as the last run that has the step knows it."""
    runs = [("part = 3", "('view')"), ("part IN (1, 2)", "('signup', 'error')"), ("part = 0", "('click', 'error')")]
    return _r("CASE " + " ".join(f"WHEN {which} THEN avg(value) FILTER (WHERE name = '{name}' AND name IN {known})" for which, known in runs) + " END", name)


@_query(f"WITH told AS ({_TOLD}) SELECT step, {', '.join(map(_last_of, ('click', 'error', 'signup', 'view')))} FROM told GROUP BY step, part")
def loss_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs with different metrics appended to one frame; the second repeats some steps of the first."""
    from .sources import frames, storage

    folder = storage.shared_dir(spark, "frame")
    log = views.metric_log(spark, sf_dir).withColumn("step", F.floor(F.col("step") / 100))
    for parts, names in (((0, 1), ("click", "error")), ((1, 2), ("signup", "error")), ((3,), ("view",))):
        frames.append_run(log.where((F.col("step") % 4).isin(*parts) & F.col("name").isin(*names)), folder)
    return _out(frames.read_frame(spark, folder))


@_query("SELECT event_id::VARCHAR AS \"batch-idx\", coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END, '-') AS name, '-' AS absent FROM events")
def results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of result_rows written as csv files under the shared folder, and read back."""
    from .sources import storage

    folder = storage.shared_dir(spark, "results")
    frame = views.metric_log(spark, sf_dir).select(F.col("step").alias("batch-idx"), F.when(F.col("step") % 3 == 0, None).otherwise(F.col("name")).alias("name"), F.col("value").alias("later"))
    report.write_results(frame, ["name", "absent"], folder)
    return spark.read.option("header", True).csv(folder)


@_query("SELECT (row_number() OVER (ORDER BY md5(concat_ws('|', '0', 'order', c_name)), c_name) - 1)::BIGINT AS idx, c_name AS item FROM customer")
def item_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.ordered(views.manifest(spark, sf_dir).select("item"), shuffled=True).select(F.col("idx").cast("long").alias("idx"), "item")


@_query(f"SELECT name, n, CASE WHEN word THEN 'NOT-NUMERIC' ELSE 'number' END AS shown, CASE WHEN NOT word THEN {_r('mean')[:-8]} END AS mean FROM (SELECT event_type AS name, count(*) AS n, arg_min(event_id % 7, event_id) = 0 AS word, avg(value) FILTER (WHERE event_id % 7 <> 0) AS mean FROM events WHERE event_id % 5 <> 0 GROUP BY 1)")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of metrics, but for those whose first value is a word; later words don't count."""
    log = views.metric_log(spark, sf_dir).select("step", "name", F.when(F.col("step") % 5 == 0, None).when(F.col("step") % 7 == 0, "word").otherwise(F.col("value").cast("string")).alias("value"))
    told = report.summary_lines(log)
    word = F.col("shown") == "NOT-NUMERIC"
    return _out(told.select("name", "n", F.when(word, F.col("shown")).otherwise("number").alias("shown"), F.expr("try_cast(shown as double)").alias("mean")))


@_query(_with("small_cloud", body=f"SELECT shape_id, point_id, {_r('0.6', 'nx')}, {_r('0.0', 'ny')}, {_r('0.8', 'nz')} FROM small_cloud"))
def normals_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals of points that lie in planes of one direction, as normals_pca finds them."""
    cloud = views.small_cloud(spark, sf_dir).select("shape_id", "point_id", F.col("x"), F.col("y"), (F.length("shape_id") / 10.0 - F.col("x") * 0.75).alias("z"))
    return _out(normals.estimate(cloud, 16))


@_query(_with("big_cloud", body=f"SELECT DISTINCT shape_id, {', '.join(f'floor({a} / 0.25)::BIGINT AS {n}' for a, n in zip('xyz', 'ijk', strict=True))}, {', '.join(_r(f'(floor({a} / 0.25) + 0.5) * 0.25 + 1.0', a) for a in 'xyz')} FROM big_cloud"))
def voxel_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(volume.centres(sampling.voxels(views.big_cloud(spark, sf_dir), 0.25), 0.25, (1.0, 1.0, 1.0)))


@_query(_with("small_cloud", body="SELECT shape_id, point_id FROM small_cloud WHERE shape_id IN (SELECT shape_id FROM small_cloud WHERE x > 0.45 OR y > 0.45)"))
def shapes_with_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = views.small_cloud(spark, sf_dir)
    return volume.with_cells(cloud.select("shape_id", "point_id"), cloud.where("x > 0.45"), cloud.where("y > 0.45"))


_SCENE_DENSITY = {
    "sizes2": "SELECT shape_id, count(*) AS n FROM big_cloud GROUP BY shape_id", "cells": _CELLS(0.1, "big_cloud"),
    "dense": "SELECT shape_id, n, n / c AS density FROM sizes2 JOIN (SELECT shape_id, count(*) AS c FROM cells GROUP BY 1) USING (shape_id)",
}


@_query(_with("big_cloud", **_SCENE_DENSITY, body=f"SELECT shape_id, point_id, {', '.join(_r(f'{a} * sqrt(density / (1.0 + 1.0 * {_u(0, 'density', 'shape_id')}))', a) for a in _AXES)} FROM big_cloud JOIN dense USING (shape_id)"))
def density_rescale_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sampling.density_rescale(views.big_cloud(spark, sf_dir), 0.1, 1.0, 2.0).select("shape_id", "point_id", "x", "y", "z"))


@_query(_with("big_cloud", **_SCENE_DENSITY, ranked=_ranked("subsample", "big_cloud"), body=f"""SELECT shape_id, point_id FROM ranked JOIN dense USING (shape_id)
    WHERE rank <= round_even(n / density * (least(density, 20.0) + (least(density, 30.0) - least(density, 20.0)) * {_u(0, 'density', 'shape_id')}), 0)::BIGINT"""))  # fmt: skip
def density_subsample_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.density_subsample(views.big_cloud(spark, sf_dir), 0.1, 20.0, 30.0).select("shape_id", "point_id")


@_query("SELECT (o_orderkey // 64)::BIGINT AS batch_idx, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY 1")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.mix(spark, sf_dir).select(F.col("item").alias("idx"), "item")
    return mixing.in_batches(items, 64).select("batch_idx", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


@_query("""SELECT page_id, lpad(page_id::VARCHAR, 6, '0') AS padded, regexp_extract(url, '([^/]+?)(?:\\.[^./]*)?$', 1) AS stem, split_part(url, '/', 3) AS host, regexp_matches(url, 'example\\.(com|org)') AS chosen,
    starts_with(url, 'https://') AND ends_with(url, '5') AS listed, concat_ws('+', split_part(url, '/', 3), split_part(url, '/', 4)) AS shown FROM pages""")  # fmt: skip
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as reports and manifests need them: padded numbers, stems, parts of paths, predicates."""
    part = lambda i: F.split_part("url", F.lit("/"), F.lit(i))
    return views.table(spark, sf_dir, "pages").select(
        "page_id", F.lpad(F.col("page_id").cast("string"), 6, "0").alias("padded"), F.regexp_extract("url", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), part(3).alias("host"), F.col("url").rlike(r"example\.(com|org)").alias("chosen"),
        (F.col("url").startswith("https://") & F.col("url").endswith("5")).alias("listed"), F.concat_ws("+", part(3), part(4)).alias("shown"),
    )
