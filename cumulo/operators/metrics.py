"""Reconstruction quality of predicted against true points, by shape, and losses over sampled fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec, nan_if_null
from .knn import as_queries, as_refs, knn

#: Distances at which precision and recall are taken; those with an F-score of their own by name. Fixed values.
THRESHOLDS = (0.01, 0.015, 0.02, 0.002, 0.1)
NAMED = {0.01: "f_score", 0.015: "f_score_15", 0.02: "f_score_20", 0.1: "f_score_outdoor"}
ESSENTIAL = ("chamfer_l1", "f_score", "normal_consistency")


def nearest_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """shape_id, dist, dot of each source point to its nearest target: the distance, and the unit normals' product without sign, NaN where a normal is missing or zero."""
    found = knn(as_queries(source, "nx", "ny", "nz"), as_refs(target, "nx", "ny", "nz"), 1)
    dot = F.abs(Vec.of("q_n").unit().dot(Vec.of("r_n").unit()))
    return found.select("shape_id", F.sqrt("d2").alias("dist"), nan_if_null(dot).alias("dot"))


def _side(pairs: DataFrame, name: str) -> DataFrame:
    """One pass over the pairs gives every mean that the metrics need."""
    shares = [F.avg((F.col("dist") <= t).cast("double")).alias(f"{name}_{i}") for i, t in enumerate(THRESHOLDS)]
    return pairs.groupBy("shape_id").agg(F.avg("dist").alias(f"{name}_d"), F.avg(F.col("dist") * F.col("dist")).alias(f"{name}_d2"), F.avg("dot").alias(f"{name}_n"), *shares)


def evaluate(pred: DataFrame, gt: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each shape of gt or pred; NaN in all metrics of a shape that lacks either. names: columns to keep, by default all."""
    shapes = pred.select("shape_id").unionByName(gt.select("shape_id")).distinct()
    rows = shapes.join(_side(nearest_pairs(gt, pred), "c"), "shape_id", "left").join(_side(nearest_pairs(pred, gt), "a"), "shape_id", "left")
    half = lambda a, b: (F.col(a) + F.col(b)) / 2.0
    out: dict[str, Column] = {
        "completeness": F.col("c_d"), "completeness2": F.col("c_d2"), "accuracy": F.col("a_d"), "accuracy2": F.col("a_d2"),
        "chamfer_l1": half("c_d", "a_d"), "chamfer_l2": half("c_d2", "a_d2"), "normal_consistency": half("c_n", "a_n"),
    }
    for i, threshold in enumerate(THRESHOLDS):
        recall, precision = F.col(f"c_{i}"), F.col(f"a_{i}")
        out |= {f"recall_{i}": recall, f"precision_{i}": precision}
        if threshold in NAMED:
            out[NAMED[threshold]] = F.try_divide(2.0 * precision * recall, precision + recall)
    return rows.select("shape_id", *(nan_if_null(c).alias(n) for n, c in out.items() if names is None or n in names))


def iou(occupancy: DataFrame) -> DataFrame:
    """shape_id, iou of truth and guess: both over either, plus 1e-6."""
    both, either = (F.col("truth") & F.col("guess")).cast("long"), (F.col("truth") | F.col("guess")).cast("long")
    return occupancy.groupBy("shape_id").agg((F.sum(both) / (F.sum(either) + 1e-6)).alias("iou"))


def measure(rows: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """What the measures of these names, of those in MEASURES, say of rows: measures of one's own are added there."""
    return {name: MEASURES[name](rows) for name in names}


def point_stats(points: DataFrame) -> DataFrame:
    """Mean, least and largest of each coordinate."""
    return points.groupBy("shape_id").agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))


def spatial_loss(samples: DataFrame, voxel: float) -> DataFrame:
    """loss of shapes' samples (kind, truth, value): |value - truth| / voxel near the surface, 0.1 exp(value / (2 voxel)) in empty space, none where unknown; over all samples."""
    near = F.when(F.col("kind") == 0, F.abs(F.col("value") - F.col("truth")) / voxel)
    empty = F.when(F.col("kind") == 1, 0.1 * F.exp(F.col("value") / (2.0 * voxel)))
    return samples.groupBy("shape_id").agg(((F.coalesce(F.sum(near), F.lit(0.0)) + F.coalesce(F.sum(empty), F.lit(0.0))) / F.count(F.lit(1))).alias("loss"))


def sharpness_loss(samples: DataFrame, epsilon: float = 0.5) -> DataFrame:
    """Mean of epsilon / (value^2 + epsilon^2)."""
    return samples.groupBy("shape_id").agg(F.avg(epsilon / (F.col("value") * F.col("value") + epsilon * epsilon)).alias("loss"))


def unsigned_loss(samples: DataFrame, voxel: float) -> DataFrame:
    """Mean of |value - truth| / voxel."""
    return samples.groupBy("shape_id").agg((F.avg(F.abs(F.col("value") - F.col("truth"))) / voxel).alias("loss"))


def surface_loss(samples: DataFrame) -> DataFrame:
    """value_loss, the mean magnitude on the surface, and normal_loss, 1 less the mean product of the unit downhill gradient and the normal."""
    down = (-Vec.of("g")).unit(1e-6)
    return samples.groupBy("shape_id").agg(F.avg(F.abs("value")).alias("value_loss"), (1.0 - F.avg(down.dot(Vec.of("n")))).alias("normal_loss"))


def structure_loss(rows: DataFrame) -> DataFrame:
    """cross_entropy and accuracy by level of rows (level, logits, truth); the first of equal logits is the choice."""
    top = F.array_max("logits")
    log_sum = top + F.log(F.aggregate("logits", F.lit(0.0), lambda s, v: s + F.exp(v - F.array_max("logits"))))
    chosen = F.array_position("logits", top) - 1
    return rows.groupBy("level").agg(F.avg(log_sum - F.get("logits", F.col("truth"))).alias("cross_entropy"), F.avg((chosen == F.col("truth")).cast("double")).alias("accuracy"))


def total_loss(losses: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum by step of rows (step, name, value); NaN counts as 0, names without a weight as weight 0."""
    weight = F.coalesce(F.create_map(*(F.lit(v) for kv in weights.items() for v in kv))[F.col("name")], F.lit(0.0))
    return losses.groupBy("step").agg(F.sum(weight * F.nanvl(F.col("value"), F.lit(0.0))).alias("total"))


#: Measures and losses by name, each a function from rows to rows.
MEASURES = {"point_stats": point_stats, "sharpness": sharpness_loss, "surface": surface_loss, "structure": structure_loss, "occupancy_iou": iou}
