"""A frame of metrics that grows by runs: each is written on its own under folder/run=<number>, none is written again.

A run's files have all columns of those before it, in their order, and then its own new ones, sorted. So the schema of the
last run is the header of all, which doesn't change but for columns added at its end, and reading looks at one schema
however many runs there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.report import wide
from .files import list_files

DONE = "/_SUCCESS"


def _runs(folder: str) -> list[str]:
    """Folders of the runs that were written to their end, oldest first."""
    return [p.removesuffix(DONE) for p in list_files(folder, DONE, nested=True)]


def header(spark: SparkSession, folder: str) -> list[str]:
    """The frame's columns so far."""
    runs = _runs(folder)
    return spark.read.parquet(runs[-1]).columns if runs else []


def append_run(log: DataFrame, folder: str, keys: Sequence[str] = ("step",)) -> list[str]:
    """Appends a log (keys, name, value) as a run with a row for each of its keys and a column for each metric; returns the header.

    Values of a metric at equal keys are averaged. Rows without a name are left out. A run that fails leaves a folder without the mark of a
    whole one, which is never read; of two writers that take the same number at once one gets an error and may try again.
    """
    spark, keys = log.sparkSession, list(keys)
    runs = _runs(folder)
    before = spark.read.parquet(runs[-1]).schema if runs else None
    frame = wide(log.where(F.col("name").isNotNull()), keys)
    metrics = frame.columns[len(keys) :]
    if len({*keys, *metrics}) < len(frame.columns):
        raise ValueError("a metric is called as a key is")
    if before is not None and [(f.name, f.dataType) for f in before][: len(keys)] != [(f.name, f.dataType) for f in frame.schema][: len(keys)]:
        raise ValueError(f"the frame's keys are {before.simpleString()}")
    old = before.names if before is not None else keys
    names = [*old, *sorted(set(metrics) - set(old))]
    numbers = [int(p.rpartition("run=")[2]) for p in list_files(folder, "") if "run=" in p]
    columns = [F.col(f"`{n}`") if n in frame.columns else F.lit(None).cast("double").alias(n) for n in names]
    frame.select(*columns).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/run={max(numbers, default=-1) + 1:06d}")
    return names


def read_frame(spark: SparkSession, folder: str, keys: Sequence[str] = ("step",)) -> DataFrame:
    """A row for each of the keys, as the last run that has them wrote it, with null for metrics that the run didn't know."""
    runs = _runs(folder)
    if not runs:
        raise ValueError(f"no run was written under {folder}")
    last = spark.read.parquet(runs[-1]).schema
    rows = spark.read.schema(last).option("basePath", folder).parquet(*runs)
    newest = Window.partitionBy(*keys).orderBy(F.desc("run"))
    return rows.withColumn("_turn", F.row_number().over(newest)).where("_turn = 1").select(*(F.col(f"`{n}`") for n in last.names))
