"""Collocations: phrases of two to four words that occur more often than their parts suggest.

Each task counts what follows each word, up to four words deep, in tries of some SHARD_TOKENS tokens. A
trie is serialised in the order of its words - for each path how many words it shares with the one before,
the words that differ, and a count - and cut into ranges of paths, which a bounded sample places so that
they are about equally large. Each range's tries are merged, k runs at a time, into one, and a walk over it
gives each phrase's count and those of its left parts. A phrase whose paths lie in more than one range is on
the outermost path of each, so such counts are added up across ranges. Links to phrases without their first
words give the right parts.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import with_group
from ..sources.storage import checkpointed
from .common import join_hot, slices

DEPTH, LEAST, TOP = 4, 30, 2000
#: A phrase is dropped for a longer one that has this share of its occurrences, in percent.
COVERED = 80
SCORE = 2_000_000
#: Tokens of a trie that a task builds, characters of text behind a range, paths merged at once, and ranges at most.
SHARD_TOKENS, RANGE_CHARS, MERGE_PATHS, RANGES = 2_000_000, 4_000_000, 4_000_000, 100_000
#: The sample that places the ranges: pieces of texts, and their length. It has no part in any count.
SAMPLE_PIECES, PIECE_CHARS = 1500, 2000
#: Salts of each language's first rows, before they are ranked.
SALTS = 64

#: A-Z as a-z, white space within pieces as a space, and what ends a piece as a full stop.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, and a full stop between pieces."""
    return text.translate(_PLAIN).replace(b".", b" . ").split()


def _lang():
    return F.coalesce(F.col("lang").cast("string"), F.lit("und"))


def combined(paths: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of `paths` (DEPTH word numbers from 1 to `words`, 0 after the end) and their summed counts."""
    base = words + 1
    halves = np.concatenate([paths[:, 0] * base + paths[:, 1], paths[:, 2] * base + paths[:, 3]])
    pairs, at = np.unique(halves, return_inverse=True)
    key = at[: len(paths)] * len(pairs) + at[len(paths) :]
    order = np.argsort(key, kind="stable")  # merges the runs that the tries are
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    first = key[starts]
    one, other = pairs[first // max(1, len(pairs))], pairs[first % max(1, len(pairs))]
    return np.stack([one // base, one % base, other // base, other % base], axis=1), np.add.reduceat(counts[order], starts) if len(key) else counts


class Trie:
    """Paths of words with their counts: `names` are the words in byte order, `paths` their numbers from 1, in order."""

    def __init__(self, names: list[bytes], paths: np.ndarray, counts: np.ndarray):
        self.names, self.paths, self.counts = names, paths, counts

    def cut(self, ends: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Trie]]:
        """The parts of the trie between the paths `ends`, with their numbers, without those that are empty."""
        at = [self._place(end) for end in ends]
        for n, (s, e) in enumerate(zip([0, *at], [*at, len(self.paths)], strict=True)):
            if s < e:
                used = np.zeros(len(self.names) + 1, np.int64)
                used[self.paths[s:e]] = 1
                used[0] = 0
                yield n, Trie([self.names[w - 1] for w in np.flatnonzero(used).tolist()], (np.cumsum(used) * used)[self.paths[s:e]], self.counts[s:e])

    def _place(self, end: tuple[bytes, ...]) -> int:
        """The first path that doesn't come before `end`."""
        low, high = 0, len(self.paths)
        for depth, word in enumerate(end):
            number = bisect.bisect_left(self.names, word) + 1 if word else 0
            column = self.paths[low:high, depth]
            if word and not (number <= len(self.names) and self.names[number - 1] == word):
                return low + int(np.searchsorted(column, number))
            low, high = low + int(np.searchsorted(column, number)), low + int(np.searchsorted(column, number, "right"))
        return low

    def packed(self) -> bytes:
        """Shared words, words that differ and counts, each compressed."""
        differs = np.ones(self.paths.shape, bool)
        differs[1:] = np.logical_or.accumulate(self.paths[1:] != self.paths[:-1], axis=1)
        kind = np.uint16 if len(self.names) < 1 << 16 else np.uint32
        small = self.counts.astype(np.uint8) if int(self.counts.max()) < 256 else self.counts
        parts = [b" ".join(self.names), np.dtype(kind).str.encode(), small.dtype.str.encode(), differs.sum(axis=1).astype(np.uint8).tobytes(), self.paths[differs].astype(kind).tobytes(), small.tobytes()]
        head = np.array([len(p) for p in parts], np.int64).tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        raw = zstandard.ZstdDecompressor().decompress(data)
        ends = 48 + np.cumsum(np.frombuffer(raw[:48], np.int64))
        names, kind, small, fresh, words, counts = (raw[a:b] for a, b in zip([48, *ends[:-1].tolist()], ends.tolist(), strict=True))
        fresh = np.frombuffer(fresh, np.uint8)
        differs = np.arange(DEPTH) >= DEPTH - fresh[:, None]
        paths = np.zeros(differs.shape, np.int64)
        paths[differs] = np.frombuffer(words, np.dtype(kind.decode()))
        # A word that is shared is the one that last differed at its depth.
        last = np.maximum.accumulate(np.where(differs, np.arange(len(paths))[:, None], 0), axis=0)
        return cls(names.split(b" ") if names else [], np.take_along_axis(paths, last, axis=0), np.frombuffer(counts, np.dtype(small.decode())).astype(np.int64))

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        names = sorted(set().union(*(t.names for t in tries)))
        number = dict(zip(names, range(1, len(names) + 1), strict=True))
        paths = [np.array([0, *(number[w] for w in t.names)], np.int64)[t.paths] for t in tries]
        return cls(names, *combined(np.concatenate(paths), np.concatenate([t.counts for t in tries]), len(names)))

    def nodes(self, least: int) -> Iterator[tuple[bytes, int, list[int], bool]]:
        """(phrase, count, counts of its left parts, is it on an outermost path?) of phrases counted `least` times or on such a path, the empty one too."""
        paths, n = self.paths, len(self.paths)
        yield b"", int(self.counts.sum()), [], True
        before = np.zeros(n, bool)
        before[0] = True
        above: list[np.ndarray] = []  # for each depth passed, the count of the node that each path is below
        for depth in range(DEPTH):
            before[1:] |= paths[1:, depth] != paths[:-1, depth]
            starts = np.flatnonzero(before)
            total = np.add.reduceat(self.counts, starts)
            of = np.cumsum(before) - 1
            outer = (starts == 0) | (of[starts] == of[-1])
            for s, f, edge in zip(*(a[(paths[starts, depth] > 0) & ((total >= least) | outer)].tolist() for a in (starts, total, outer)), strict=True):
                yield b" ".join(self.names[w - 1] for w in paths[s, : depth + 1].tolist()), f, [int(a[s]) for a in above], edge
            above.append(total[of])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


class Counter:
    """Tries of the texts of one language, shard by shard."""

    def __init__(self):
        self.carry: list[bytes] = []
        self._clear()

    def _clear(self) -> None:
        self.numbers, self.held, self.size = _Numbers({b".": 0}), [], 0
        self._add(self.carry)

    def _add(self, words: list[bytes]) -> None:
        self.held.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def add(self, words: list[bytes]) -> Trie | None:
        """Counts words that follow those before; gives a trie once a shard is full."""
        self._add(words)
        return self.shard() if self.size >= SHARD_TOKENS else None

    def shard(self, last: bool = False) -> Trie | None:
        """The trie of what was added. The last words start no path yet, unless nothing follows: the next shard begins with them."""
        x = np.concatenate(self.held)
        names = list(self.numbers)
        self.carry = [] if last else [names[i] for i in x[max(0, len(x) - (DEPTH - 1)) :].tolist()]
        order = sorted(range(1, len(names)), key=names.__getitem__)
        rank = np.zeros(len(names), np.int64)
        rank[order] = np.arange(1, len(names))
        x = np.append(rank[x], np.zeros(DEPTH - 1 if last else 0, np.int64))
        n = max(0, len(x) - (DEPTH - 1))
        paths = np.stack([x[d : d + n] for d in range(DEPTH)], axis=1)
        paths *= np.logical_and.accumulate(paths > 0, axis=1)
        paths = paths[paths[:, 0] > 0]
        self._clear()
        if not len(paths):
            return None
        return Trie([names[i] for i in order], *combined(paths, np.ones(len(paths), np.int64), len(order)))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end where a word does."""
    start = 0
    while len(text) - start > 4_000_000:
        spaces = [text.find(c, start + 2_000_000) for c in (b" ", b"\n", b".")]
        cut = min((s for s in spaces if s >= 0), default=len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def placed_ranges(docs: DataFrame, count: int, chars: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """At most count - 1 (lang, path) that cut the paths of a sample of all texts into equal parts, in order."""
    rate = min(1.0, 2 * SAMPLE_PIECES * PIECE_CHARS / max(1, chars))
    numbers = F.sequence(F.lit(0), F.floor(F.length("text") / PIECE_CHARS))
    pieces = docs.select(F.col("doc_id").alias("id"), _lang().alias("lang"), "text", F.explode(numbers).alias("piece")).withColumn("place", F.xxhash64("id", F.length("text"), "piece"))
    start = (F.col("piece") * PIECE_CHARS + 1).cast("int")
    chosen = pieces.where(F.pmod("place", F.lit(1_000_000)) < rate * 1_000_000).select("lang", "place", F.substring("text", start, PIECE_CHARS).alias("text"))
    rows = chosen.orderBy("place", "lang", "text").limit(SAMPLE_PIECES).collect()
    by_lang: dict[str, Counter] = {}
    for row in rows:
        by_lang.setdefault(row["lang"], Counter())._add([*tokens(row["text"].encode()), b"."])
    paths = []
    for lang in sorted(by_lang, key=str.encode):
        trie = by_lang[lang].shard(last=True)
        if trie is not None:
            paths += [(lang, tuple(trie.names[w - 1] if w else b"" for w in path)) for path in trie.paths.tolist()]
    return [paths[i] for i in sorted({len(paths) * k // count for k in range(1, count)} - {0})] if paths else []


def shards(docs: DataFrame, ends: list[tuple[str, tuple[bytes, ...]]]) -> DataFrame:
    """(lang, part, trie): the serialised tries of each task, cut at `ends`."""
    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("trie", pa.binary())])
    langs = [lang.encode() for lang, _ in ends]

    def rows(lang: str, trie: Trie) -> pa.RecordBatch:
        first, last = bisect.bisect_left(langs, lang.encode()), bisect.bisect_right(langs, lang.encode())
        found = [(first + n, part.packed()) for n, part in trie.cut([path for _, path in ends[first:last]])]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([n for n, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], schema=schema)

    def run(batches):
        counters: dict[str, Counter] = {}
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column(1).cast(pa.binary())
                for lang, text in zip(piece.column(0).to_pylist(), texts.to_pylist(), strict=True):
                    counter = counters.setdefault(lang, Counter())
                    for part in _pieces(text):
                        if (trie := counter.add(tokens(part))) is not None:
                            yield rows(lang, trie)
                    counter._add([b"."])
        for lang, counter in counters.items():
            if (trie := counter.shard(last=True)) is not None:
                yield rows(lang, trie)

    return docs.select(_lang().alias("lang"), "text").mapInArrow(run, "lang string, part int, trie binary")


def merged(tries: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f, lefts, edge): the nodes of each range's merged trie, see Trie.nodes()."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64()), ("lefts", pa.list_(pa.int64())), ("edge", pa.bool_())])

    def told(lang: str, tries: list[Trie]) -> Iterator[pa.RecordBatch]:
        rows = list(Trie.merged(tries).nodes(least))
        for s in range(0, len(rows), 10_000):
            phrase, f, lefts, edge = zip(*rows[s : s + 10_000], strict=True)
            depth = [p.count(b" ") + 1 if p else 0 for p in phrase]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(([lang] * len(f), [p.decode() for p in phrase], depth, f, lefts, edge), schema, strict=True)], schema=schema)

    def run(batches):
        now, held, size = None, [], 0
        for batch in batches:
            for part, lang, data in zip(*(batch.column(c).to_pylist() for c in ("part", "lang", "trie")), strict=True):
                if now != (part, lang):
                    if held:
                        yield from told(now[1], held)
                    now, held, size = (part, lang), [], 0
                held.append(Trie.unpacked(data))
                size += len(held[-1].paths)
                if size >= MERGE_PATHS and len(held) > 1:
                    held = [Trie.merged(held)]
                    size = len(held[0].paths) // 2  # so that a trie that has outgrown MERGE_PATHS isn't merged anew with each that comes
        if held:
            yield from told(now[1], held)

    ranges = tries.repartition("part", "lang").sortWithinPartitions("part", "lang")
    return ranges.mapInArrow(run, "lang string, phrase string, words int, f long, lefts array<long>, edge boolean")


def counted(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, phrase, words, f, lefts) counted `least` times, and the counts of those on outermost paths, for the empty one the words of a language."""
    docs = docs.where(F.length("text") > 0)
    chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    ends = placed_ranges(docs, max(1, min(RANGES, chars // RANGE_CHARS)), chars)
    nodes = checkpointed(merged(shards(docs, ends), least))
    totals = checkpointed(nodes.where("edge").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")))
    whole = nodes.where(~F.col("edge")).select("lang", "phrase", "words", "f", "lefts")
    split = totals.where((F.col("f") >= least) & (F.col("words") > 0)).select("lang", "phrase", "words", "f", F.lit(None).cast("array<long>").alias("lefts"))
    return whole.unionByName(split), totals.select("lang", "phrase", "f")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` collocations in documents' text and lang.

    Repeated rows count each; null and empty texts have no words, a null lang is `und`. Long texts are counted whole.
    Ties in score and count go to the phrase that is less in UTF-8. Other columns are not read, except doc_id for the
    sample that places the ranges.
    """
    phrases, totals = counted(docs, least)
    phrases = checkpointed(phrases)
    # Each cut after the first k words; left parts from the walk, or the sums of those that several ranges hold.
    cuts = phrases.where("words > 1").withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    sums = totals.select("lang", F.col("phrase").alias("left"), F.col("f").alias("_sum"))
    cuts = with_group(cuts, sums, "lang", "left", how="left").withColumn("l", F.coalesce("_sum", F.expr("get(lefts, k - 1)")))
    cuts = checkpointed(cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", "l", F.struct("lang", F.col("right").alias("phrase")).alias("link")))
    uses = cuts.groupBy("link").agg(F.count(F.lit(1)).alias("uses"))
    known = phrases.select(F.struct("lang", "phrase").alias("link"), F.col("f").alias("r")).join(uses, "link")
    scored = join_hot(cuts, known, "link", "uses", cuts.count())
    scored = scored.withColumn("score", F.expr(f"(cast({SCORE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # The most frequent longer phrase around each; the words of a phrase have at most five shorter stretches of two words or more.
    stretches = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(split(phrase, ' ', -1), s, m), ' '))))")
    around = phrases.where("words > 2").select("lang", "f", F.explode(stretches).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    best = best.join(around, ["lang", "phrase"], "left")
    best = best.where(F.col("longest").isNull() | (F.lit(100).cast("decimal(10,0)") * F.col("longest").cast("decimal(20,0)") < F.lit(COVERED).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")))
    # A language may be most of the corpus: its first rows are found among salts first.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = totals.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return with_group(ranked, words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, top: int = TOP) -> str:
    """mine() by listing all phrases."""
    return f"""
    WITH plain AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM plain),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
    n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
    all_phrases AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda s: array_to_string(w[s : s + m - 1], ' '))) AS phrase FROM words, range(1, {DEPTH + 1}) AS t(m) WHERE len(w) >= m),
    f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS f FROM all_phrases GROUP BY lang, phrase, m HAVING count(*) >= {least}),
    cuts AS (SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS p, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS q FROM f, range(1, {DEPTH}) AS t(k) WHERE k < m),
    scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST({SCORE}::HUGEINT * c.a // (x.f + y.f) AS BIGINT) AS score
        FROM cuts c JOIN f x ON c.lang = x.lang AND c.p = x.phrase JOIN f y ON c.lang = y.lang AND c.q = y.phrase),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, f, unnest(list_transform(range(1, m - d + 2), lambda s: array_to_string(string_split(phrase, ' ')[s : s + d - 1], ' '))) AS phrase FROM f, range(2, {DEPTH}) AS t(d) WHERE d < m),
    around AS (SELECT lang, phrase, max(f) AS longest FROM inside GROUP BY lang, phrase),
    held AS (SELECT b.* FROM best b LEFT JOIN around o ON b.lang = o.lang AND b.phrase = o.phrase WHERE o.longest IS NULL OR 100::HUGEINT * o.longest < {COVERED}::HUGEINT * b.a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM held) JOIN n USING (lang) WHERE rank <= {top}"""
