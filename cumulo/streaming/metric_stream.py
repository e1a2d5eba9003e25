"""Metric logs as streams: means by step for files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, folder: str, schema: str = "ts timestamp_ntz, name string, value double") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed_means(log: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """n and mean of each metric in windows of event time; rows later than `late` behind the latest are dropped, and a window's state with them."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    means = timed.groupBy(F.window("ts", width), "name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return means.select(F.col("window.start").alias("start"), "name", "n", "mean")
