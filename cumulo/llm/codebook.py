"""Vector codes: each part of an integer vector is replaced by the number of its nearest codebook entry.

Components become integers, so all that is learned and assigned is exact. Every part position has a
vantage-point tree over its entries. A search goes down it with a whole batch of parts at once, and leaves
out a side only where the triangle inequality says that all its entries are farther off than the best so
far: radii are rounded outwards, sides that may hold an equal distance are visited, and what decides is the
integer distance itself. Tasks add up the parts of each entry; only those sums, as many as the codebooks
have numbers, come to the driver between rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from .common import join_hot

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components beyond this count as it, so that sums of any rows are exact in 38 digits.
LARGEST = 1 << 40
#: What errors that don't fit into a long are given as.
MOST = (1 << 63) - 1
#: Radii and distances are roots of exact integers; this is far above their rounding.
SLACK = 1e-12


class Tree:
    """A vantage-point tree over numbered entries: `near` and `far` are (tree, least, largest distance from the vantage point)."""

    def __init__(self, entries: np.ndarray, numbers: list[int]):
        self.number, self.entry, self.sides = numbers[0], entries[numbers[0]], []
        rest = sorted(numbers[1:], key=lambda n: (self._squared(entries[n : n + 1])[0], n))
        half = (len(rest) + 1) // 2
        for side in (rest[:half], rest[half:]):
            if side:
                d = np.sqrt(self._squared(entries[side]).astype(np.float64))
                self.sides.append((Tree(entries, sorted(side)), d.min() * (1 - SLACK), d.max() * (1 + SLACK)))

    def _squared(self, parts: np.ndarray) -> np.ndarray:
        step = parts - self.entry
        return (step * step).sum(axis=1)

    def search(self, parts: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Puts the squared distance of the nearest entry into best[rows], and its number, the least of equally near ones, into at[rows]."""
        if not len(rows):
            return
        squared = self._squared(parts[rows])
        wins = (squared < best[rows]) | ((squared == best[rows]) & (self.number < at[rows]))
        best[rows[wins]], at[rows[wins]] = squared[wins], self.number
        if not self.sides:
            return
        d = np.sqrt(squared.astype(np.float64))
        gaps = [np.maximum(least - d * (1 + SLACK), d * (1 - SLACK) - largest) for _, least, largest in self.sides]
        first = gaps[0] <= gaps[-1]
        for turn in (first, ~first):  # each part goes to the likelier side first, so that the other is left out more often
            for (side, _, _), gap, mine in zip(self.sides, gaps, (turn, ~turn), strict=False):
                side.search(parts, rows[mine & (gap <= np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK))], best, at)


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(4096 * x) of the components of vectors of one length, within +-LARGEST."""
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(vectors), dim)
    return np.clip(np.floor(x * SCALE), -LARGEST, LARGEST).astype(np.int64)


def edges_of(dim: int) -> list[int]:
    """Where the parts of a vector begin and end. They differ by one component where the length isn't a multiple of PARTS."""
    return [dim * p // PARTS for p in range(PARTS + 1)]


class Codebooks:
    """The entries of each part position, for vectors of one length."""

    def __init__(self, dim: int, parts: list[np.ndarray]):
        self.dim, self.parts = dim, parts
        self.trees = [Tree(self._wide(p, p), list(range(len(p)))) for p in parts]

    @staticmethod
    def _wide(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """part as it is where squared distances fit into 64 bits, or as Python's integers."""
        largest = max((int(np.abs(a).max()) for a in (part, entries) if a.size), default=0)
        return part.astype(object) if (2 * largest) ** 2 * max(1, part.shape[1]) >= 1 << 62 else part

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry for each vector and part, and the squared distances."""
        at, errors = np.full((len(vectors), PARTS), ENTRIES), []
        edges = edges_of(self.dim)
        for p in range(PARTS):
            part = vectors[:, edges[p] : edges[p + 1]]
            wide = self._wide(part, self.parts[p])
            best = np.full(len(part), 1 << 100 if wide.dtype == object else (1 << 63) - 1, wide.dtype)
            own = at[:, p].copy()
            self.trees[p].search(wide, np.arange(len(part)), best, own)
            at[:, p] = own
            errors.append(best)
        return at, np.stack(errors, axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for p in self.parts for entry in p.tolist() for v in entry).encode()).hexdigest()


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def kept(embeddings: DataFrame) -> DataFrame:
    """(id, vec, dim, label): vectors that are null or hold null or non-finite components are left out."""
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    vec = F.col("embedding").cast("array<float>" if single else "array<double>")
    label = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec"), label.alias("label"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vec").isNotNull() & fine).withColumn("dim", F.size("vec"))


def first_codebooks(rows: DataFrame) -> dict[int, Codebooks]:
    """The parts of the ENTRIES vectors of least id, for each length of vectors. Of several vectors of an id the least counts; a null id comes last."""
    order = Window.partitionBy("dim").orderBy(F.col("id").asc_nulls_last())
    ids = rows.select("dim", "id").distinct().withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= ENTRIES)
    # ENTRIES rows a length of vectors: a bounded broadcast, and what is collected is a codebook.
    first = rows.alias("r").join(F.broadcast(ids.alias("i")), (F.col("r.dim") == F.col("i.dim")) & F.col("r.id").eqNullSafe(F.col("i.id")))
    found: dict[int, list] = {}
    for row in sorted(first.groupBy("r.dim", "turn").agg(F.min("vec").alias("vec")).collect(), key=lambda r: (r["dim"], r["turn"])):
        found.setdefault(row["dim"], []).append(row["vec"])
    out = {}
    for dim, vectors in found.items():
        x = integers(pa.array(vectors, pa.list_(pa.float64())), dim)
        out[dim] = Codebooks(dim, [x[:, a:b] for a, b in zip(edges_of(dim)[:-1], edges_of(dim)[1:], strict=True)])
    return out


def refined(rows: DataFrame, books: dict[int, Codebooks]) -> dict[int, Codebooks]:
    """Each entry replaced by the floored mean of the parts assigned to it; unused ones stay."""
    schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for dim, own in _by_dim(batch):
                x, edges = integers(own.column("vec"), dim), edges_of(dim)
                at, _ = books[dim].assign(x)
                out = [[], [], [], [], []]
                for p in range(PARTS):
                    for e in np.unique(at[:, p]).tolist():
                        mine = at[:, p] == e
                        for c, v in zip(out, (dim, p, e, int(mine.sum()), x[mine, edges[p] : edges[p + 1]].sum(axis=0)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    sums = rows.select("vec", "dim").mapInArrow(run, "dim int, part int, entry int, n long, sums array<long>")
    counts = F.sum(F.col("n").cast("decimal(38,0)")).alias("n")
    total = sums.select("dim", "part", "entry", "n", F.posexplode("sums").alias("pos", "value")).groupBy("dim", "part", "entry", "pos").agg(counts, F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    new = {dim: [p.copy() for p in book.parts] for dim, book in books.items()}
    for row in total.collect():
        new[row["dim"]][row["part"]][row["entry"], row["pos"]] = int(row["total"]) // int(row["n"])
    return {dim: Codebooks(dim, parts) for dim, parts in new.items()}


def coded(rows: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """id, label, code, error and dim of each row."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64()), ("dim", pa.int32())])

    def run(batches):
        for batch in batches:
            for dim, own in _by_dim(batch):
                at, errors = books[dim].assign(integers(own.column("vec"), dim))
                codes = [bytes(row).hex() for row in at.astype(np.uint8)]
                error = [min(MOST, sum(map(int, row))) for row in errors]
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("label"), pa.array(codes), pa.array(error, pa.int64()), pa.array([dim] * len(own), pa.int32())], schema=schema)

    return rows.select("id", "label", "vec", "dim").mapInArrow(run, "id long, label string, code string, error long, dim int")


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row of embeddings (vec_id, embedding, label) that is kept().

    Vectors of each length have codebooks of their own, as fewer entries as there are fewer ids. Repeated rows
    are coded and counted each. Components beyond +-LARGEST in integers count as that, errors beyond a long as MOST.
    An empty vector has the code of the first entry and no error. Other columns are not read.
    """
    rows = kept(embeddings)
    books = first_codebooks(rows)
    for _ in range(rounds):
        books = refined(rows, books)
    found = checkpointed(coded(rows, books))  # read for the labels' sums and for the rows
    exact = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    sums = found.groupBy("label").agg(exact.alias("label_error"), F.count(F.lit(1)).alias("size"))
    digest = F.lit(None).cast("string")
    for dim, book in books.items():
        digest = F.when(F.col("dim") == dim, book.digest()).otherwise(digest)
    joined = join_hot(found, sums, "label", "size", found.count())
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    """compress() for vectors of one length that PARTS divides, as one statement a round."""
    nearest = "SELECT vec_id, p, min(list_sum(list_transform(list_zip(s, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + entry) AS m FROM parts JOIN {0} USING (p) GROUP BY vec_id, p"
    steps = [f"""
        whole AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, p, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS s FROM whole, range({PARTS}) AS t(p)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole ORDER BY vec_id LIMIT {ENTRIES}),
        c0 AS MATERIALIZED (SELECT p, entry, s AS c FROM first JOIN parts USING (vec_id))"""]  # fmt: skip
    for i in range(rounds):
        steps.append(f"""
        a{i} AS MATERIALIZED ({nearest.format(f"c{i}")}),
        n{i} AS (SELECT p, entry, pos, sum(v) AS t, count(*) AS n FROM (SELECT p, m % 16 AS entry, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS v FROM a{i} JOIN parts USING (vec_id, p)) GROUP BY p, entry, pos),
        m{i} AS (SELECT p, entry, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM n{i} GROUP BY p, entry),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.p, c{i}.entry, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.p = m{i}.p AND c{i}.entry = m{i}.entry)""")
    steps.append(f"""
        last AS MATERIALIZED ({nearest.format(f"c{rounds}")}),
        rows AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % 16 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM last GROUP BY vec_id),
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM c{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM rows JOIN whole USING (vec_id), digest""")
    return "WITH" + ",".join(steps)
