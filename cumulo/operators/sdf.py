"""Signed distances from oriented points: the vote rule, IMLS, gradients and truncation.

The sign is positive where more than half of the k nearest points have the query on their normal's side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec
from .knn import as_queries, as_refs, knn, spacing


#: Columns that queries and oriented points must have, as doubles or floats.
NEEDED = {"queries": ("x", "y", "z"), "refs": ("x", "y", "z", "nx", "ny", "nz")}


def checked(queries: DataFrame, refs: DataFrame) -> None:
    """Raises ValueError, before any work, where a column is missing or holds no real numbers."""
    for name, df in (("queries", queries), ("refs", refs)):
        types = dict(df.dtypes)
        for column in NEEDED[name]:
            if types.get(column) not in ("double", "float"):
                raise ValueError(f"{name}.{column} must be a double or float, not {types.get(column, 'missing')}")


def _neighbours(queries: DataFrame, refs: DataFrame, k: int, adaptive: int) -> DataFrame:
    """Rows of queries with their k nearest oriented points: d2, rank, dot (normal times ray), std and the ray."""
    checked(queries, refs)
    oriented = as_refs(refs, "nx", "ny", "nz")
    found = knn(as_queries(queries), oriented, k)
    if adaptive:
        near = spacing(refs, adaptive).select("shape_id", F.col("point_id").alias("ref_id"), F.col("spacing").alias("std"))
        found = found.join(near, ["shape_id", "ref_id"])
    else:
        found = found.withColumn("std", F.lit(1.0))
    ray, normal = Vec.of("q") - Vec.of("r"), Vec.of("r_n")
    return found.withColumns({"dot": normal.dot(ray)} | ray.named("ray_"))


def vote(queries: DataFrame, refs: DataFrame, k: int, stdv: float, adaptive: int = 0, gradient: bool = False) -> DataFrame:
    """shape_id, query_id, sdf and, if asked for, gx, gy, gz.

    Nearer than stdv times its spacing (1 if not adaptive) the magnitude is the distance to the
    nearest point's tangent plane, beyond that the distance to the point. A tie of votes is negative.
    """
    found = _neighbours(queries, refs, k, adaptive)
    first = F.col("rank") == 1
    take = lambda c: F.max(F.when(first, F.col(c)))  # noqa: E731  one row a query has rank 1
    columns = ["d2", "std", "dot", *((*(f"ray_{a}" for a in "xyz"), *(f"r_n{a}" for a in "xyz")) if gradient else ())]
    near = found.groupBy("shape_id", "query_id").agg(*(take(c).alias(c) for c in columns), F.sum((F.col("dot") > 0).cast("int")).alias("votes"))
    distance = F.sqrt("d2")
    tangent = distance < stdv * F.col("std")
    sign = F.when(F.col("votes") > k // 2, 1.0).otherwise(-1.0)
    out = {"sdf": sign * F.when(tangent, F.abs("dot")).otherwise(distance)}
    if gradient:
        side = F.when(F.col("dot") > 0, 1.0).otherwise(-1.0)
        unit = Vec.of("ray_").unit()
        for a, n, u in zip("xyz", Vec.of("r_n").parts(), unit.parts(), strict=True):
            out[f"g{a}"] = sign * F.when(tangent, side * n).otherwise(F.coalesce(u, F.lit(0.0)))
    return near.select("shape_id", "query_id", *(c.alias(n) for n, c in out.items()))


def imls(queries: DataFrame, refs: DataFrame, k: int, sigma: float) -> DataFrame:
    """shape_id, query_id, sdf, gx, gy, gz: normals' distances and normals averaged with weights exp((least d2 - d2) / sigma^2)."""
    found = _neighbours(queries, refs, k, 0)
    least = found.where("rank = 1").select("shape_id", "query_id", F.col("d2").alias("_least"))
    rows = found.join(least, ["shape_id", "query_id"]).withColumn("w", F.exp((F.col("_least") - F.col("d2")) / (sigma * sigma)))
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    return rows.groupBy("shape_id", "query_id").agg(mean("dot").alias("sdf"), *(mean(f"r_n{a}").alias(f"g{a}") for a in "xyz"))


def geometry_sdf(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """The adaptive preset: eight votes, threshold three times the spacing of eight; inside is positive."""
    return vote(queries, refs, 8, 3.0, 8).withColumn("sdf", -F.col("sdf"))


def point_sdf(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """The fixed preset: eight votes, threshold 0.02; inside is positive."""
    return vote(queries, refs, 8, 0.02).withColumn("sdf", -F.col("sdf"))


def truncate(value: Column, band: float, soft: bool = True) -> Column:
    """band * tanh(value / band), or a clamp to [-band, band]."""
    return band * F.tanh(value / band) if soft else F.greatest(F.lit(-band), F.least(value, F.lit(band)))
