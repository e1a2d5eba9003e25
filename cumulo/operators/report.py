"""Reports over metric logs (step, name, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Columns that wide() makes at most of its own accord.
MOST_NAMES = 1000


def summary(log: DataFrame) -> DataFrame:
    """name, n, mean of values that are there."""
    return log.groupBy("name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))


def summary_lines(log: DataFrame) -> DataFrame:
    """name, n, shown: the mean of a metric whose first value, by step, is a number, otherwise NOT-NUMERIC; values are strings."""
    number = F.expr("try_cast(value as double)")
    told = log.where(F.col("value").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min_by(number.isNotNull(), "step").alias("_number"), F.avg(number).alias("_mean"))
    return told.select("name", "n", F.when(F.col("_number"), F.col("_mean").cast("string")).otherwise("NOT-NUMERIC").alias("shown"))


def _before(blocks: DataFrame, keys: list[str], value: str, total, fan: int = 10_000) -> DataFrame:
    """blocks (keys, _block, value) with _before, `total` of value over the blocks before each; `fan` blocks are taken together first."""
    outer = blocks.withColumn("_outer", F.floor(F.col("_block") / fan))
    earlier = total(F.col("_some")).over(Window.partitionBy(*keys).orderBy("_outer").rowsBetween(Window.unboundedPreceding, -1))
    tops = outer.groupBy(*keys, "_outer").agg(total(F.col(value)).alias("_some")).withColumn("_top", earlier).drop("_some")
    inner = total(F.col(value)).over(Window.partitionBy(*keys, "_outer").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    return outer.withColumn("_inner", inner).join(tops, [*keys, "_outer"]).drop("_outer", value)


def best_so_far(log: DataFrame, block: int = 10_000) -> DataFrame:
    """best: the least value of its name up to each step.

    A name's steps are cut into blocks of ids, whose minima are few; each block runs from the best of
    those before it, so that no name's rows meet in one task.
    """
    keyed = log.withColumn("_block", F.floor(F.col("step") / block))
    minima = keyed.groupBy("name", "_block").agg(F.min("value").alias("_least"))
    within = F.min("value").over(Window.partitionBy("name", "_block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    rows = keyed.withColumn("_within", within).join(_before(minima, ["name"], "_least", F.min), ["name", "_block"])
    return rows.select("step", "name", "value", F.least("_within", "_inner", "_top").alias("best"))


def running_failures(steps: DataFrame, failed, block: int = 10_000) -> DataFrame:
    """failures: how many steps up to each one failed, by blocks of ids as in best_so_far()."""
    keyed = steps.withColumn("_f", failed.cast("long")).withColumn("_block", F.floor(F.col("step") / block))
    sums = keyed.groupBy("_block").agg(F.sum("_f").alias("_sum"))
    within = F.sum("_f").over(Window.partitionBy("_block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    rows = keyed.withColumn("_within", within).join(_before(sums, [], "_sum", F.sum), "_block")
    return rows.select("step", sum((F.coalesce(c, F.lit(0)) for c in ("_inner", "_top")), F.col("_within")).alias("failures"))


def wide(log: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """A column for each metric, by name; names that there are none of stay empty."""
    if names is None:
        names = sorted(r[0] for r in log.select("name").distinct().limit(MOST_NAMES + 1).collect())
        if len(names) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} metrics: name those that columns are wanted for")
    return log.groupBy(*keys).pivot("name", names).agg(F.avg("value"))


def result_rows(frame: DataFrame, header: list[str]) -> DataFrame:
    """Columns of a results file: the header's alone, batch-idx first, `-` where a value is missing."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) if c in frame.columns else F.lit("-") for c in header]
    return frame.select(F.col("`batch-idx`").cast("string").alias("batch-idx"), *(c.alias(n) for c, n in zip(columns, header, strict=True)))


def write_results(frame: DataFrame, header: list[str], folder: str) -> None:
    """result_rows() as csv files in a folder, each with the header, whose columns don't change from batch to batch."""
    result_rows(frame, header).write.option("header", True).csv(folder)


def learning_rate(steps: DataFrame, initial: float, multiplier: float, every: float, least: float, batch: int = 1) -> DataFrame:
    """rate: a staircase that falls by multiplier every so many samples, down to `least`."""
    stairs = F.pow(F.lit(multiplier), F.floor(F.col("step") * batch / every))
    return steps.withColumn("rate", initial * F.greatest(stairs, F.lit(least / initial)))
