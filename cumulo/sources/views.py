"""Point-cloud views of the star-schema and embedding tables.

They stand in for scanned shapes, scenes, volumes, manifests and metric logs. All are projections or
one aggregation, so filters and column selection reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import Vec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape for each label: positions, normals, sensor positions and colours from the first twelve dimensions."""
    part = lambda i: F.get("embedding", F.lit(i)).cast("double")
    names = ["x", "y", "z", "nx", "ny", "nz", "sx", "sy", "sz"]
    columns = [part(i).alias(n) for i, n in enumerate(names)]
    colours = [((part(9 + i) + 1.0) / 2.0).alias(n) for i, n in enumerate("rgb")]
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("label/"), F.col("label").cast("string")).alias("shape_id"), F.col("vec_id").alias("point_id"), *columns, *colours)


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_cloud(spark, sf_dir).where(F.col("point_id") % 2 == 0)


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_cloud(spark, sf_dir).where(F.col("point_id") % 2 == 1)


def occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_cloud(spark, sf_dir).select("shape_id", "point_id", "x", "y", "z", (F.col("z") > 0).alias("truth"), (F.col("x") + F.col("z") > 0).alias("guess"))


def big_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each return flag. Ids are digests of a row's values, so that giving them moves no rows."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    key = F.concat_ws("|", *("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), *map(cents, ("l_quantity", "l_extendedprice", "l_discount")), F.date_format("l_shipdate", "yyyy-MM-dd"))
    at = Vec((F.col("l_quantity") / 50.0), (F.col("l_extendedprice") / 105000.0), (F.col("l_discount") * 10.0))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("shape_id"), F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long").alias("point_id"), *(c.alias(n) for n, c in at.named().items()), "l_tax")
    out = (Vec.of() - 0.5).unit()
    return rows.select("shape_id", "point_id", "x", "y", "z", *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in out.named("n").items()), "l_tax")


def volume(spark: SparkSession, sf_dir: str, n: int = 16, scale: float = 10.0, offset: float = 0.4) -> DataFrame:
    """shape_id, i, j, k, val on an n x n x n lattice over [0, 1]^3; cells without points are missing, which stands for unknown."""
    index = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(c) * n))).cast("int")
    keyed = big_cloud(spark, sf_dir).select("shape_id", index("x").alias("i"), index("y").alias("j"), index("z").alias("k"), "l_tax")
    # Sums of whole hundredths: the same in any order.
    return keyed.groupBy("shape_id", "i", "j", "k").agg((F.sum(F.round(F.col("l_tax") * 100).cast("long")) / 100.0 / F.count(F.lit(1)) * scale - offset).alias("val"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("grp"), F.col("c_name").alias("item"))


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("item"))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, name, value: events by id, of which each is a step."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value")
