"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-random rotation - three rounds of random signs and a fast Hadamard transform - turns each
vector, and the nearest signed axis is its bucket. There are TABLES rotations; a query looks into those
buckets of each whose axes are nearest to it, as many as a bounded sample of the vectors needs for a
recall of AIM. Buckets are dealt over parts of about PART_FLOATS numbers. A query goes once to each part
that holds buckets of its, is compared with their rows alone, and takes along its best of the part by
exact inner products; what it found in all parts is merged. A query that met fewer than k candidates
goes on to all buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed

#: Rotations, and neighbours.
TABLES, NEAREST = 2, 20
#: The sample that the number of probed buckets is fitted on: rows and numbers at most, queries, and the recall aimed at.
SAMPLE_ROWS, SAMPLE_FLOATS, SAMPLE_QUERIES, AIM = 20_000, 4_000_000, 200, 0.97
#: Dimensions with fewer sampled rows have probes() buckets, whose share is LEAST at least; the others no fewer than FEWEST.
LEAST_ROWS, LEAST, FEWEST = 400, 0.5, 4
#: Numbers of a part's vectors at most, about, and parts a table and rows of a part at least where there are few rows; larger buckets are split.
PART_FLOATS, PARTS, PART_ROWS = 1_000_000, 16, 1000
#: Buckets whose sizes are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_BUCKETS = 100_000
SEED = 11
#: A near vector lies about LEAN * sqrt(2 ln(2 * width) / width) standard deviations nearer to a query's axes than chance.
LEAN = 2.6


def probes(width: int) -> int:
    """Buckets of a table to look into for vectors padded to `width` of which too few are sampled: most of the near ones are met.

    The wider the vectors, the less an axis tells, so the share of buckets rises with the width.
    """
    lean = LEAN * math.sqrt(2 * math.log(2 * width) / width)
    return math.ceil(2 * width * min(1.0, max(LEAST, 2 * math.erfc(lean / math.sqrt(2)) / 2)))


def padded_width(dim: int) -> int:
    return 1 << (dim - 1).bit_length()


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def axes(vectors: np.ndarray, table: int, most: int) -> np.ndarray:
    """The signed axes nearest to each vector after a table's rotation, nearest first: 2 * axis, and 1 more if negative."""
    width = padded_width(vectors.shape[1])
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for turn in range(3):
        x = hadamard(x * np.random.default_rng([SEED, table, turn, width]).choice([-1.0, 1.0], width))
    # An axis and its opposite are both buckets; the farther half is probed once the nearer is through.
    score = np.stack([x, -x], axis=2).reshape(len(x), 2 * width)
    most = min(most, 2 * width)
    if most == 1:
        return score.argmax(axis=1)[:, None]
    top = np.argpartition(-score, most - 1, axis=1)[:, :most]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim): rows without an id, and vectors that are null, empty, zero or hold null or non-finite parts, are left out.

    vec stays single where it is; it is worked with in double precision.
    """
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine).withColumn("dim", F.size("vec"))


def _matrix(vec: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vec.flatten().to_numpy(), np.float64).reshape(-1, dim)


def fitted_probes(base: DataFrame, tables: int = TABLES) -> dict[int, int]:
    """For each dimension with enough vectors, the buckets a table that SAMPLE_QUERIES of a sample need to meet AIM of their nearest in it.

    The nearest in a sample are farther off than the nearest in all, and so need no fewer probes.
    """
    total, most = base.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not most:
        return {}
    place = F.xxhash64("id", "vec")
    thin = base.where(F.pmod(place, F.lit(1_000_000)) * F.lit(total) < 2_000_000 * SAMPLE_ROWS)
    rows = thin.orderBy(place, "id").limit(min(SAMPLE_ROWS, max(LEAST_ROWS, SAMPLE_FLOATS // most))).collect()
    by_dim: dict[int, list] = {}
    for vector in dict.fromkeys(tuple(row["vec"]) for row in rows):  # equal vectors count once
        by_dim.setdefault(len(vector), []).append(vector)
    out = {}
    for dim, vectors in by_dim.items():
        if len(vectors) < LEAST_ROWS:
            continue
        x = np.array(vectors, np.float64)
        q, n = x[:SAMPLE_QUERIES], min(SAMPLE_QUERIES, len(x))
        score = q @ x.T
        score[np.arange(n), np.arange(n)] = -np.inf
        best = np.argpartition(-score, NEAREST - 1, axis=1)[:, :NEAREST]
        turn = np.full(best.shape, 2 * padded_width(dim))
        for t in range(tables):
            order = axes(q, t, 2 * padded_width(dim))
            ranks = np.empty_like(order)
            np.put_along_axis(ranks, order, np.arange(order.shape[1])[None].repeat(n, axis=0), axis=1)
            turn = np.minimum(turn, np.take_along_axis(ranks, axes(x, t, 1)[:, 0][best], axis=1))
        out[dim] = max(FEWEST, int(np.quantile(turn, AIM, method="higher")) + 1)
    return out


def _keys(rows: DataFrame, most: dict[int, int] | int, tables: int) -> DataFrame:
    """(id, vec, dim, buckets): the nearest buckets of each row in each table, `most` a table, by dimension or probes() if missing there.

    A bucket's number holds its table: 2 * width * table + its axis.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            buckets = [None] * batch.num_rows
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                width = padded_width(int(dim))
                n = most if isinstance(most, int) else most.get(int(dim)) or probes(width)
                found = np.concatenate([axes(_matrix(batch.column(1).take(pa.array(at)), dim), t, n) + t * 2 * width for t in range(tables)], axis=1)
                for i, row in zip(at, found, strict=True):
                    buckets[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(buckets, pa.list_(pa.int64()))], names=["id", "vec", "dim", "buckets"])

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("id", "vec", "dim").mapInArrow(run, f"id long, vec {kind}, dim int, buckets array<long>")


def nearest(base: DataFrame, queries: DataFrame, k: int = NEAREST, tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among base, by inner product in double precision.

    base and queries have (id, vec, dim) as from usable(). A query's own id is no candidate; ties go
    to smaller ids; vectors of another dimension are none either. Repeated rows of an id are one
    candidate for each different vector. A query has fewer than k rows only where there are fewer
    candidates. `probes` is the number of buckets a table; without it, it is fitted.
    """
    most = probes or fitted_probes(base, tables)
    base, queries = base.dropDuplicates(["id", "vec"]), queries.dropDuplicates(["id", "vec"])
    found = checkpointed(_probed(base, queries, k, tables, most))
    whole = found.where(F.col("rank") == k).select("query_id")
    short = queries.join(whole.withColumnRenamed("query_id", "id"), "id", "left_anti")
    if short.isEmpty():
        return found
    # All buckets of one table hold every row once.
    return found.join(whole, "query_id", "left_semi").unionByName(_probed(base, short, k, 1, 1 << 40))


def _parts(keyed: DataFrame, tables: int) -> DataFrame:
    """dim, bucket, part, splits: small buckets share a part, large ones are split over some."""
    fair = F.sum("n").over(Window.partitionBy("dim")) / (PARTS * tables)
    rows = F.least(F.lit(PART_FLOATS) / F.col("dim"), F.greatest(F.lit(PART_ROWS), fair))
    sizes = keyed.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("rows", F.greatest(F.lit(1), F.floor(rows)))
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("dim", "bucket", F.floor(F.coalesce(before, F.lit(0)) / F.col("rows")).alias("part"), F.ceil(F.col("n") / F.col("rows")).cast("int").alias("splits"))


def _probed(base: DataFrame, queries: DataFrame, k: int, tables: int, probes: dict[int, int] | int) -> DataFrame:
    """nearest() among what the probed buckets hold."""
    keyed = checkpointed(_keys(base, 1, tables)).withColumn("bucket", F.explode("buckets"))  # read twice
    parts = checkpointed(_parts(keyed.select("dim", "bucket"), tables))
    if parts.count() <= BROADCAST_BUCKETS:
        parts = F.broadcast(parts)
    split = F.expr("part + pmod(xxhash64(id), splits)")
    keyed = keyed.join(parts, ["dim", "bucket"]).select("dim", split.alias("part"), "id", "vec", "buckets", "bucket").withColumn("buckets", F.array("bucket")).drop("bucket")
    # A query's vector goes to each part once, with its buckets there.
    kind = F.xxhash64("vec").alias("kind")
    asked = _keys(queries, probes, tables).select("id", kind, "dim", F.explode("buckets").alias("bucket")).join(parts, ["dim", "bucket"])
    asked = asked.withColumn("part", F.explode(F.expr("sequence(part, part + splits - 1)"))).groupBy("id", "kind", "dim", "part").agg(F.collect_list("bucket").alias("buckets"))
    asked = asked.join(queries.select("id", kind, "dim", "vec"), ["id", "kind", "dim"])
    columns = ["dim", "part", "id", "vec", "buckets", "asks"]
    rows = keyed.withColumn("asks", F.lit(0)).select(*columns).unionByName(asked.withColumn("asks", F.lit(1)).select(*columns))
    rows = rows.repartition("dim", "part").sortWithinPartitions("dim", "part", "asks")

    def rank(batches: Iterator[pa.RecordBatch]):
        part, now = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "part", "asks")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e == s:
                    continue
                if now != (key := tuple(keys[:2, s].tolist())):
                    part, now = Part(int(keys[0, s]), k), key
                piece = batch.slice(s, e - s)
                if keys[2, s]:
                    yield from part.best(piece)
                else:
                    part.add(piece)

    found = rows.mapInArrow(rank, "query long, ids array<long>, scores array<double>")
    merged_schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def merge(batches: Iterator[pa.RecordBatch]):
        from .minhash import _bounds, _runs

        for table in _runs(batches, ["query"]):
            edges = _bounds(table, ["query"])
            query, ids, scores = table.column("query").to_numpy(), table.column("ids").to_pylist(), table.column("scores").to_pylist()
            out = [[], [], [], []]
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                all_ids, all_scores = np.concatenate(ids[s:e]).astype(np.int64), np.concatenate(scores[s:e])
                order = np.lexsort((all_ids, -all_scores))
                _, first = np.unique(all_ids[order], return_index=True)
                order = order[np.sort(first)][:k]
                out[0] += [query[s]] * len(order)
                out[1] += range(1, len(order) + 1)
                out[2] += all_ids[order].tolist()
                out[3] += all_scores[order].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, merged_schema, strict=True)], schema=merged_schema)

    return found.repartition("query").sortWithinPartitions("query").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


class Part:
    """The vectors of a part, by bucket, and what queries find in their buckets there."""

    #: Inner products held at once, and candidates beyond k that are looked at more closely.
    PRODUCTS, MORE = 2_000_000, 8
    SCHEMA = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def __init__(self, dim: int, k: int):
        self.dim, self.k, self.held, self.sorted = dim, k, [], False

    def add(self, rows: pa.RecordBatch) -> None:
        self.held.append((rows.column("id").to_numpy(), _matrix(rows.column("vec"), self.dim), rows.column("buckets").flatten().to_numpy()))

    def best(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Each query's k nearest among the rows of its buckets, its own id left out."""
        if not self.held:
            return
        if not self.sorted:
            ids, x, buckets = (np.concatenate(c) for c in zip(*self.held, strict=True))
            order = np.argsort(buckets, kind="stable")
            self.ids, self.x, self.sorted, self.held = ids[order], x[order], True, [None]
            self.names, starts = np.unique(buckets[order], return_index=True)
            self.edges = [*starts.tolist(), len(ids)]
        step = max(1, self.PRODUCTS // len(self.ids))
        for start in range(0, rows.num_rows, step):
            yield self._block(rows.slice(start, step))

    def _block(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        own, q = rows.column("id").to_numpy(), _matrix(rows.column("vec"), self.dim)
        lists = rows.column("buckets")
        at = np.searchsorted(self.names, flat := lists.flatten().to_numpy())
        at[at == len(self.names)] = 0
        here = self.names[at] == flat
        asks = np.zeros((len(own), len(self.names)), bool)
        asks[np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy())[here], at[here]] = True
        rough = np.full((len(own), len(self.ids)), -np.inf)
        for b in np.flatnonzero(asks.any(axis=0)).tolist():
            who, (first, last) = np.flatnonzero(asks[:, b]), self.edges[b : b + 2]
            rough[who, first:last] = q[who] @ self.x[first:last].T
        rough[own[:, None] == self.ids[None]] = -np.inf
        near = min(rough.shape[1], self.k + self.MORE)
        top = np.argpartition(-rough, near - 1, axis=1)[:, :near]
        value = -np.sort(-np.take_along_axis(rough, top, axis=1), axis=1)
        # Products of one order for every row, so that equal vectors score alike.
        exact = np.where(np.isneginf(np.take_along_axis(rough, top, axis=1)), -np.inf, (self.x[top] * q[:, None]).sum(axis=2))
        ids = self.ids[top]
        order = np.lexsort((ids, -exact), axis=-1)[:, : self.k]
        ids, exact = (np.take_along_axis(a, order, axis=1) for a in (ids, exact))
        kth = value[:, min(self.k, near) - 1]
        # Where more rows than were looked at come as near as the k-th, all of them are.
        tied = (near < rough.shape[1]) & np.isfinite(kth) & (value[:, -1] >= kth - 1e-9 * np.maximum(1.0, np.abs(kth)))
        out_ids, out_scores = [], []
        for i in range(len(own)):
            if tied[i]:
                all_near = np.flatnonzero(rough[i] >= kth[i] - 1e-9 * max(1.0, abs(kth[i])))
                scores = (self.x[all_near] * q[i]).sum(axis=1)
                order_i = np.lexsort((self.ids[all_near], -scores))[: self.k]
                out_ids.append(self.ids[all_near[order_i]])
                out_scores.append(scores[order_i])
            else:
                fine = ~np.isneginf(exact[i])
                out_ids.append(ids[i][fine])
                out_scores.append(exact[i][fine])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((own, out_ids, out_scores), self.SCHEMA, strict=True)], schema=self.SCHEMA)


def search_table(embeddings: DataFrame, every: int = 20) -> DataFrame:
    """nearest() for the rows whose vec_id is divisible by `every`, against all rows."""
    rows = usable(embeddings, "vec_id", "embedding")
    return nearest(rows, rows.where(F.col("id") % every == 0))
