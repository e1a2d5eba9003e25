"""Normals by principal components of each point's nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import as_queries, as_refs, knn


def covariances(points: DataFrame, k: int) -> DataFrame:
    """shape_id, point_id and the six covariances of each point's k nearest, sums that Spark aggregates.

    Of differences from the point itself, so that a cloud far from the origin keeps all its digits.
    """
    found = knn(as_queries(points), as_refs(points), k).withColumns({f"r{a}": F.col(f"r{a}") - F.col(f"q{a}") for a in "xyz"})
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    mean = lambda c: F.avg(c)
    return found.groupBy("shape_id", F.col("query_id").alias("point_id")).agg(*((mean(F.col(f"r{a}") * F.col(f"r{b}")) - mean(F.col(f"r{a}")) * mean(F.col(f"r{b}"))).alias(f"c{a}{b}") for a, b in pairs))


def estimate(points: DataFrame, k: int = 64) -> DataFrame:
    """shape_id, point_id, nx, ny, nz: the direction of least variance, its largest part positive.

    Only the eigenvectors of the 3 x 3 matrices are found in Python, a batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            xx, xy, xz, yy, yz, zz = (np.asarray(batch.column(i + 2)) for i in range(6))
            matrices = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], 1)
            normal = np.linalg.eigh(matrices)[1][:, :, 0] if len(matrices) else np.zeros((0, 3))
            largest = np.take_along_axis(normal, np.abs(normal).argmax(axis=1)[:, None], axis=1)
            normal = normal * np.where(largest < 0, -1, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(normal[:, i])) for i in range(3))], names=["shape_id", "point_id", "nx", "ny", "nz"])

    return covariances(points, k).mapInArrow(run, "shape_id string, point_id long, nx double, ny double, nz double")


def oriented(points: DataFrame, k: int = 64, steepest_deg: float = 85.0) -> DataFrame:
    """points with normals estimated from k neighbours and turned to the sensor; those seen at a grazing angle are dropped."""
    from .affine import face_sensor

    found = estimate(points.select("shape_id", "point_id", "x", "y", "z"), k)
    return face_sensor(points.drop("nx", "ny", "nz").join(found, ["shape_id", "point_id"]), steepest_deg).select(*points.columns)
