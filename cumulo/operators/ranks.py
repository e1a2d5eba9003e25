"""Places, running sums and small side tables within groups of any size: no group has to meet in one task.

A group's rows are dealt over blocks, whose few totals are summed up first; each block then runs from
the total of those before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed

#: Hexadecimal digits of a digest that name a block.
DIGITS = 3
#: Rows of a side table that is broadcast, at most.
SMALL_ROWS = 20_000


def _onto(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """rows (with _block) with their place in their group, from 1."""
    blocks = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, "_block", F.coalesce(before, F.lit(0).cast("long")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    placed = rows.withColumn(name, inside).join(blocks, [*keys, "_block"])
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_before")


def by_digest(rows: DataFrame, keys: Sequence[str], digest: Column, tie: str, name: str) -> DataFrame:
    """rows with their place in the order of a digest (hexadecimal), ties by a column, within their group."""
    rows = rows.withColumn("_digest", digest).withColumn("_block", F.substring("_digest", 1, DIGITS))
    return _onto(rows, keys, ["_digest", tie], name).drop("_digest")


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows in ranges of keys and order, with _block, the number of the range. Written out, as ranges are drawn from a sample."""
    return checkpointed(rows.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))


def by_value(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with their place in the order of columns within their group."""
    return _onto(in_ranges(rows, keys, order), keys, order, name)


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over those before them in their group."""
    ranged = in_ranges(rows, keys, order)
    blocks = ranged.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn(name, F.coalesce(inside, F.lit(0.0))).join(blocks.withColumn("_before", F.coalesce(before, F.lit(0.0))).drop("_sum"), [*keys, "_block"])
    return placed.withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_before")


def with_group(rows: DataFrame, table: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a group.

    Groups are few as a rule and then hold very many rows each: the table is worked out once and broadcast where it is
    counted to have SMALL_ROWS at most, so that no rows move.
    """
    table = checkpointed(table)
    return rows.join(F.broadcast(table) if table.count() <= SMALL_ROWS else table, list(keys), how)
