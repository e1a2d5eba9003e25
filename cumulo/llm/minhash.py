"""MinHash near-duplicate linking with sequential Bayesian verification.

1. Each text gives its set of word shingles, a MinHash signature and band keys. Texts with equal
   sets become one node, so groups of copies cost one row each from here on.
2. Nodes that share a band key are candidates. Inside a bucket, signatures are compared a batch of
   positions at a time, and a pair is dropped once the posterior probability that its similarity
   reaches the threshold is below MISS. Buckets emit a spanning forest of what survives, not pairs.
3. Survivors that hang together are verified on full sets; clusters beyond TILE_SHINGLES are cut
   into tiles and each pair of tiles is a task's work. Again a spanning forest of links comes out.
4. Connected components of the links, by star contraction.

Joins on keys that many rows may share - buckets, clusters, hubs, sets of copies - go through join_hot().
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import checkpointed
from .common import join_hot, slices

WORDS = 5
#: Links need 100 * intersection >= percent * union; this is the percent of op4_minhash.
PERCENT = 85
#: Bands at PERCENT, and hash functions a band; hashes() has the number for other thresholds. Bands miss a pair with
#: probability BAND_MISS at most: 4e-7 at similarity 0.85 with 25 bands, 1e-7 at 0.80 with 40.
BANDS, ROWS, BAND_MISS = 25, 5, 5e-7
HASHES = BANDS * ROWS
#: Positions compared before each posterior bound is looked up, and the chosen miss probability.
BATCH, MISS = 25, 1e-6
#: Rows of a bucket, and shingles of a cluster, that one task compares with each other at once.
BUCKET_TILE, TILE_SHINGLES = 2048, 400_000

_rng = np.random.default_rng(20)
_SYMBOL = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)


@functools.cache
def hashes(percent: int = PERCENT) -> int:
    """Hash functions, in whole bands and batches, whose bands miss a pair at the threshold with probability BAND_MISS at most."""
    bands = np.log(BAND_MISS) / np.log1p(-((percent / 100) ** ROWS)) if percent < 100 else 1
    return int(np.ceil(bands * ROWS / BATCH)) * BATCH


@functools.cache
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of the first `count` hash functions, as columns."""
    more = np.random.default_rng(21).integers(1, 1 << 63, (max(0, count - HASHES), 2), dtype=np.uint64)
    a, b = np.concatenate([_A, more[:, 0] | np.uint64(1)]), np.concatenate([_B, more[:, 1]])
    return a[:count, None], b[:count, None]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z count as a-z. A text with fewer words gives its whole sequence as one shingle; without words or text, none.
    """
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)  # bytes.lower changes A-Z alone
    inside = ~_SPACE[raw]
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(begins):
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, begins)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    # A character counts by its place in the word; the place enters through an odd power that wraps around.
    power = np.cumprod(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, np.uint64))
    word = _mix(np.add.reduceat(_SYMBOL[raw[at]] * power[place], first) + lengths.astype(np.uint64))
    n = min(words, len(word))
    total = np.full(len(word) - n + 1, n, np.uint64)
    for j in range(n):
        total += word[j : len(word) - n + 1 + j] * _PLACE[j]
    return np.unique(_mix(total))


def signature(found: np.ndarray, count: int = HASHES) -> np.ndarray:
    """The least value of each of `count` hash functions over a set that isn't empty."""
    a, b = _functions(count)
    least = np.full(count, 0xFFFFFFFF, np.uint64)
    for start in range(0, len(found), 4096):
        values = (found[None, start : start + 4096] * a + b) >> np.uint64(32)
        least = np.minimum(least, values.min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    mixed = (_mix(least).reshape(-1, ROWS) * _PLACE[:ROWS]).sum(axis=1, dtype=np.uint64)
    return _mix(mixed + np.arange(len(mixed), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


@functools.cache
def least_agreement(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """For each number of positions compared, the fewest agreeing ones that keep a pair.

    The prior on the similarity is uniform, so after m of k agree the posterior is Beta(m + 1, k - m + 1).
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for k in range(BATCH, hashes(percent) + 1, BATCH):
        for m in range(k + 1):
            log = m * np.log(grid) + (k - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= percent / 100].sum() / density.sum() >= miss:
                break
        out[k] = m
    return out


def surviving(one: np.ndarray, others: np.ndarray, bounds: dict[int, int]) -> np.ndarray:
    """Which rows of others the sequential test keeps against the signature `one`."""
    alive, agree = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, bound in bounds.items():
        agree = agree + (others[alive, k - BATCH : k] == one[k - BATCH : k]).sum(axis=1)
        keep = agree >= bound
        alive, agree = alive[keep], agree[keep]
    return alive


def forest(n: int, linked, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (least row of its tree, row) of the graph in which linked(row, rows) gives a row's partners among rows.

    Each row is compared with those not yet reached alone, so a group that hangs together costs few comparisons. With
    `side`, only rows on different sides are compared.
    """
    left, edges = np.arange(n), []
    while len(left):
        tree, todo = [int(left[0])], [int(left[0])]
        left = left[1:]
        while todo and len(left):
            row = todo.pop()
            open_rows = left if side is None else left[side[left] != side[row]]
            if len(open_rows):
                found = open_rows[linked(row, open_rows)]
                if len(found):
                    left = left[~np.isin(left, found)]
                    tree.extend(found.tolist())
                    todo.extend(found.tolist())
        edges += [(tree[0], row) for row in tree[1:]]
    return edges


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by keys: each ends where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held:
            last = held[-1]
            if any(last.column(k)[last.num_rows - 1].as_py() != c[0] for k, c in zip(keys, cols, strict=True)):
                yield pa.Table.from_batches(held)
                held = []
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    cols = [table.column(k).to_numpy() for k in keys]
    change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
    return np.concatenate([[0], change, [table.num_rows]])


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], schema=_EDGES)


def _mark():
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64("text")


def describe(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, digest of the set, signature (a byte a hash function) and bands of each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                cols = [[] for _ in range(4)]
                for text in piece.column(2).to_pylist():
                    found = shingles(text)
                    least = signature(found, hashes(percent)) if len(found) else None
                    row = (len(found), None, None, None) if least is None else (len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), (least & np.uint64(255)).astype(np.uint8).tobytes(), band_keys(least))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:], strict=True))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), _mark().alias("mark"), "text").mapInArrow(run, "doc_id long, mark long, n_shingles long, digest binary, signature binary, bands array<long>")


def tiled(rows: DataFrame, tiles, node: str) -> DataFrame:
    """Each row once for every pair of tiles that its tile is part of, as columns i <= j and its own tile.

    With one tile that is the row itself; the pairs of tiles together compare all rows of a key."""
    rows = rows.withColumn("_tiles", tiles.cast("int")).withColumn("tile", F.expr(f"cast(pmod(xxhash64({node}), _tiles) as int)"))
    rows = rows.withColumn("_other", F.explode(F.expr("sequence(0, _tiles - 1)")))
    return rows.withColumn("i", F.least("tile", "_other")).withColumn("j", F.greatest("tile", "_other")).drop("_other", "_tiles")


def survivors(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b): a spanning forest, for each bucket, of the candidates that the sequential test keeps; percent as in describe()."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("tiles", F.ceil(F.col("size") / BUCKET_TILE))
    members = join_hot(keyed, sizes, "key", "size", nodes.count() * (hashes(percent) // ROWS))
    members = tiled(members.join(nodes.select("node", "signature", "n_shingles"), "node"), F.col("tiles"), "node").select("key", "i", "j", "tile", "node", "signature", "n_shingles")
    members = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    groups = ["key", "i", "j"]

    def run(batches):
        bounds = least_agreement(percent)
        for table in _runs(batches, groups):
            edges = _bounds(table, groups)
            node, n = table.column("node").to_numpy(), table.column("n_shingles").to_numpy()
            tile, i, j = (table.column(c).to_numpy() for c in ("tile", "i", "j"))
            marks = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, hashes(percent))
            start, size = edges[:-1], np.diff(edges)
            # Buckets of two, most of all, are compared side by side.
            p = start[(size == 2) & (i[start] == j[start])]
            a, b, agree = p, p + 1, np.zeros(len(p), np.int64)
            keep = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b, agree = a[keep], b[keep], agree[keep]
            for k, bound in bounds.items():
                agree = agree + (marks[a, k - BATCH : k] == marks[b, k - BATCH : k]).sum(axis=1)
                keep = agree >= bound
                a, b, agree = a[keep], b[keep], agree[keep]
            out_a, out_b = [node[a]], [node[b]]
            for s, m in zip(start.tolist(), size.tolist(), strict=True):
                if m < 2 or m == 2 and i[s] == j[s]:
                    continue
                own, counts, ids = marks[s : s + m], n[s : s + m], node[s : s + m]

                def linked(row, rows, own=own, counts=counts):
                    near = np.flatnonzero(100 * np.minimum(counts[row], counts[rows]) >= percent * np.maximum(counts[row], counts[rows]))
                    return near[surviving(own[row], own[rows[near]], bounds)]

                found = forest(m, linked, None if i[s] == j[s] else tile[s : s + m])
                if found:
                    x, y = np.array(found).T
                    out_a.append(ids[x])
                    out_b.append(ids[y])
            yield _edges(np.concatenate(out_a), np.concatenate(out_b))

    return members.mapInArrow(run, "a long, b long")


def verified(clusters: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b): a spanning forest of the links within clusters, on full sets.

    Clusters are (node, label, n_shingles, doc_id, mark); the last two name the row of docs that holds a node's text.
    """
    sums = clusters.groupBy("label").agg(F.ceil(F.sum("n_shingles") / TILE_SHINGLES).alias("tiles"), F.count(F.lit(1)).alias("size"))
    placed = join_hot(clusters.select("node", "label", "doc_id", "mark"), sums, "label", "size", clusters.count())
    # Rows that are alike meet where they are joined; one of each goes on.
    rows = docs.select("doc_id", _mark().alias("mark"), "text").join(placed, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    rows = tiled(rows, F.col("tiles"), "node").select("label", "i", "j", "tile", "node", "text")
    rows = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
    groups = ["label", "i", "j"]

    def run(batches):
        for table in _runs(batches, groups):
            edges = _bounds(table, groups)
            node = table.column("node").to_numpy()
            tile, i, j = (table.column(c).to_numpy() for c in ("tile", "i", "j"))
            out_a, out_b = [], []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sets = [shingles(t) for t in table.column("text").slice(s, e - s).to_pylist()]
                sizes = np.array([len(x) for x in sets])
                names, flat = np.unique(np.concatenate(sets), return_inverse=True)
                starts = np.cumsum(sizes) - sizes
                mark = np.zeros(len(names), np.int64)

                def linked(row, rows, sizes=sizes, starts=starts, flat=flat, mark=mark):
                    own = flat[starts[row] : starts[row] + sizes[row]]
                    mark[own] = 1
                    # All rows are counted at once while most are open, and one by one later.
                    if len(rows) * 4 > len(sizes):
                        both = np.add.reduceat(mark[flat], starts)[rows]
                    else:
                        both = np.array([mark[flat[starts[r] : starts[r] + sizes[r]]].sum() for r in rows])
                    mark[own] = 0
                    return 100 * both >= percent * (sizes[row] + sizes[rows] - both)

                for x, y in forest(e - s, linked, None if i[s] == j[s] else tile[s:e]):
                    out_a.append(node[s + x])
                    out_b.append(node[s + y])
            yield _edges(out_a, out_b)

    return rows.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) with the least node of each component, for the nodes of edges (a, b).

    Star contraction: each node's larger neighbours, then its smaller ones, are hung on the least of
    them, until nothing changes. No node's neighbours are ever gathered: only their minimum is, and a
    hub's rows meet it without being moved. Every round is checkpointed.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_hot(both, least, "u", "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, least, "u", "n", state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, component (its number; null without words) and component_id of each row of docs."""
    described = checkpointed(describe(docs, percent))
    told = described.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = told.groupBy("digest").agg(
        F.min(F.struct("doc_id", "mark")).alias("row"), F.first("signature").alias("signature"), F.first("bands").alias("bands"),
        F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies"),
    )
    # Rows of one id may differ in text, so nodes have numbers of their own; written out, they stay the same.
    nodes = checkpointed(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "row.*", "signature", "bands", "n_shingles", "copies"))
    clusters = connected_components(survivors(nodes, percent)).join(nodes.select("node", "doc_id", "mark", "n_shingles"), "node")
    components = connected_components(verified(checkpointed(clusters), docs, percent))
    named = checkpointed(components.join(nodes.select("node", "doc_id"), "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    named = join_hot(named.drop("doc_id"), least, "label", "size", named.count())
    sets = nodes.select("node", "digest", "doc_id", "copies").join(named, "node", "left")
    # Written out, because the last join reads them twice: plans that hold each other's joins again and again fill the driver.
    sets = checkpointed(sets.select("digest", "copies", F.coalesce("label", "node").alias("component"), F.coalesce("least", "doc_id").alias("component_id")))
    rows = described.select("doc_id", "mark", "n_shingles", "digest")
    with_words = join_hot(rows.where(F.col("digest").isNotNull()), sets, "digest", "copies", told.count(), "left").drop("digest")
    without = rows.where(F.col("digest").isNull()).select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without)


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs, linked from a similarity of percent / 100 on.

    Documents without words are linked with nothing. Repeated rows give repeated rows that are alike; each
    row is judged by its own text, also where several have one id. A row with a null id is linked with
    nothing and has a null component_id and kept. Columns besides doc_id and text are not read.
    """
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return _linked(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of docs, with all its columns, for each component: that of its least doc_id.

    Of a component's rows with this id, that whose text has the least hash stays; of rows with the same id
    and text one. Rows of one id whose texts are not linked are judged each by itself. Rows with a null id
    all stay. No column of docs, whatever its name, is touched.
    """
    linked = _linked(docs, percent).where(F.col("doc_id").isNotNull())
    # A row without words is a component of its own. linked is read once, so that its joins are planned once.
    alone = [F.when(F.col("component").isNull(), F.col(c)).alias(f"_{c}") for c in ("doc_id", "mark")]
    stay = linked.groupBy("component", *alone).agg(F.min(F.struct("doc_id", "mark")).alias("_row")).select("_row.*")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"))
    # All columns that can be hashed choose among rows of one id and text.
    hashed = F.xxhash64(*(F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()))
    once = rows.where(F.col("doc_id").isNotNull()).withColumn("_turn", F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy(hashed))).where("_turn = 1")
    held = once.join(stay, ["doc_id", "mark"], "left_semi")
    return held.select("row.*").unionByName(rows.where(F.col("doc_id").isNull()).select("row.*"))
