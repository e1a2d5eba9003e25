"""Manifests, splits, mixtures of sources, and selection of batches."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from .ranks import by_digest, by_value, with_group


def available(wanted: list[str], columns: list[str]) -> list[str]:
    """Wanted columns that there are, in the order wanted; others are dropped."""
    return [c for c in wanted if c in columns]


def parse_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines of a list file, blank ones dropped."""
    return lines.select(F.trim("value").alias("item")).where(F.length("item") > 0)


def split_manifest(manifest: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """split: train for the first int(n * ratio) items of each group in a random order, val for the others."""
    sizes = manifest.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    rows = with_group(by_digest(manifest, ["grp"], rng.digest(seed, "split", "grp", "item"), "item", "ord"), sizes, "grp")
    return rows.withColumn("split", F.when(F.col("ord") <= F.floor(F.col("_n") * ratio), "train").otherwise("val")).drop("_n")


def mix_sources(items: DataFrame, shares: dict[str, float]) -> DataFrame:
    """source, physical, logical, first: each source's items, int(items * share) of them, and where it starts in the mixture.

    One row a source; sources without a share are taken whole. A mixture is no source of another.
    """
    if "logical" in items.columns:
        raise ValueError("mixtures can't be nested: mix the sources themselves")
    share = F.coalesce(F.create_map(*(F.lit(v) for kv in shares.items() for v in kv))[F.col("source")], F.lit(1.0)) if shares else F.lit(1.0)
    sizes = items.groupBy("source").agg(F.count(F.lit(1)).alias("physical")).withColumn("logical", F.floor(F.col("physical") * share))
    before = F.sum("logical").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("first", F.coalesce(before, F.lit(0).cast("long")))


def mix_epoch(items: DataFrame, shares: dict[str, float], epoch: int) -> DataFrame:
    """idx, source, item: what an epoch shows. A source's window of logical items rolls on by its length each epoch, around its end."""
    return mix_epochs(items, shares, [epoch]).select("idx", "source", "item")


def mix_epochs(items: DataFrame, shares: dict[str, float], epochs: Sequence[int], seed: int = 0, validation: bool = False) -> DataFrame:
    """epoch, idx, source, item, reads, draw of several epochs, whose items are placed once.

    reads counts the epochs before that showed the item. draw, of (item, reads, seed), is the seed for what is drawn for
    that read: other epochs draw anew, and one that is run again draws the same. Validation draws the same at every read.
    """
    rows = with_group(by_value(items, ["source"], ["item"], "_at"), mix_sources(items, shares), "source")
    rows = rows.withColumn("epoch", F.explode(F.array(*(F.lit(e) for e in epochs)))).withColumn("_shown", F.col("epoch") * F.col("logical"))
    turn = F.pmod(F.col("_at") - 1 - F.col("_shown"), F.col("physical"))
    # Windows lie end to end around the items, so a place was shown once for each round that they have begun beyond it.
    reads = F.greatest(F.lit(0), F.floor((F.col("_shown") - F.col("_at") + F.col("physical")) / F.col("physical")))
    shown = rows.where(turn < F.col("logical")).select("epoch", (F.col("first") + turn).alias("idx"), "source", "item", reads.alias("reads"))
    return shown.withColumn("draw", F.lit(str(seed)) if validation else rng.digest(seed, "read", "item", "reads"))


def focus(grammar: str, column: str = "batch_idx") -> Column:
    """A predicate from `none`, `all`, `gN` (above N), `lN` (below N), `a,b,c` or `N`."""
    if grammar == "none":
        return F.lit(False)
    if grammar == "all":
        return F.lit(True)
    if match := re.fullmatch(r"([gl])(\d+)", grammar):
        return F.col(column) > int(match[2]) if match[1] == "g" else F.col(column) < int(match[2])
    return F.col(column).isin([int(n) for n in grammar.split(",")])


def substitute_missing(manifest: DataFrame, missing: DataFrame, seed: int = 0) -> DataFrame:
    """read: the item itself, or for missing ones an item of the same group, drawn from all that are there."""
    there = manifest.join(missing.select("grp", "item"), ["grp", "item"], "left_anti")
    there = by_value(there.select("grp", "item"), ["grp"], ["item"], "_rank")
    sizes = there.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    lost = manifest.join(missing.select("grp", "item"), ["grp", "item"], "left_semi")
    lost = with_group(lost, sizes, "grp").withColumn("_rank", F.floor(rng.uniform(seed, "substitute", "grp", "item") * F.col("_n")) + 1)
    found = lost.join(there.withColumnRenamed("item", "read"), ["grp", "_rank"]).select("grp", "item", "read")
    return there.select("grp", "item", F.col("item").alias("read")).unionByName(found)


def in_batches(items: DataFrame, size: int) -> DataFrame:
    """batch_idx and the batch's items as a list, in order of idx."""
    return items.groupBy(F.floor(F.col("idx") / size).alias("batch_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "item"))), lambda s: s["item"]).alias("items"))


def ordered(items: DataFrame, shuffled: bool, seed: int = 0) -> DataFrame:
    """items (item) with idx from 0: in a seeded random order where that is wanted, by item otherwise."""
    rows = items.withColumn("_all", F.lit(0))
    placed = by_digest(rows, ["_all"], rng.digest(seed, "order", "item"), "item", "idx") if shuffled else by_value(rows, ["_all"], ["item"], "idx")
    return placed.withColumn("idx", F.col("idx") - 1).drop("_all")


def fields(feature: str | None) -> list[str]:
    """Columns that a model with this feature mode reads; `normal` and `sensor` add theirs."""
    more = {"normal": ["nx", "ny", "nz"], "sensor": ["sx", "sy", "sz"]}.get(feature or "", [])
    return ["shape_id", "point_id", "x", "y", "z", *more]


def run_parts(path: Column) -> Column:
    """user, project, run and ckpt of `user/project/run:ckpt`; ckpt is null without a colon."""
    part = lambda i: F.regexp_extract(path, r"^([^/]+)/([^/]+)/([^:]+)(?::(.*))?$", i)
    return F.struct(part(1).alias("user"), part(2).alias("project"), part(3).alias("run"), F.when(path.contains(":"), part(4)).alias("ckpt"))


def run_name(overrides: Column) -> Column:
    """A short name from `key=value` overrides: short keys with values, by short key, joined by `-`; a later one of a short key wins.

    A short key has the initials of the words of each dotted part of the key, with a dot before the last
    part alone; true and false are 1 and 0, and a value ends at a second `=`.
    """
    initials = lambda part: F.array_join(F.transform(F.filter(F.split(part, "_"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), "")

    def bound(value: Column, made) -> Column:
        """made(value), which is worked out once however often made() names it."""
        return F.get(F.transform(F.array(value), made), F.lit(0))

    def short(parts):
        return F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), ""), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "."))

    value = lambda v: F.when(F.lower(v) == "true", "1").when(F.lower(v) == "false", "0").otherwise(v)
    key = lambda name: bound(F.transform(F.split(name, r"\."), initials), short)
    told = F.transform(F.transform(overrides, lambda o: F.split(o, "=")), lambda o: F.struct(key(o[0]).alias("key"), value(o[1]).alias("value")))

    def joined(told):
        keys = F.array_sort(F.array_distinct(F.transform(told, lambda t: t["key"])))
        return F.array_join(F.transform(keys, lambda k: F.concat(k, F.element_at(F.filter(told, lambda t: t["key"] == k), -1)["value"])), "-")

    return bound(told, joined)


def unpack_bits(packed: Column, n: int) -> Column:
    """The first n bits of a binary column, the high one of each byte first."""
    byte = lambda i: F.conv(F.hex(F.substring(packed, (i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(byte(i), (7 - i % 8).cast("int")) == 1)
