"""Randomness from counters: a draw is a function of a seed, an operator's name and the row's keys.

It depends neither on partitions nor on the order of rows, so a task that runs again draws the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | Column, op: str, *keys: Column | str) -> Column:
    """An order that is reproducible and looks random. The seed may be a row's own."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), F.lit(op), *(c.cast("string") for c in columns)))


def uniform(seed: int | Column, op: str, *keys: Column | str) -> Column:
    """A draw from [0, 1) with 32 bits."""
    return F.conv(F.substring(digest(seed, op, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def between(low, high, seed: int | Column, op: str, *keys) -> Column:
    return low + (high - low) * uniform(seed, op, *keys)


def normal(seed: int | Column, op: str, *keys: Column | str) -> Column:
    """A standard normal draw, by the Box-Muller transform of two uniform ones."""
    first = F.greatest(uniform(seed, f"{op}.r", *keys), F.lit(2.0**-33))
    return F.sqrt(-2.0 * F.log(first)) * F.cos(2.0 * math.pi * uniform(seed, f"{op}.a", *keys))
