"""What the corpus operators share: table access, folds, bounded samples, token memo, shared files."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text handed to one vectorised step inside a task, in characters.
SLICE_CHARS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id, parts: int, out: int):
    """True in the fold that is never learned from; false for a null id, which isn't learned from either."""
    return F.coalesce(fold(doc_id, parts) == out, F.lit(False))


def order_key(*cols):
    """A reproducible pseudo-random order that depends on nothing but the values."""
    return F.xxhash64(*cols, F.lit("sample"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, out: int, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """Texts of each class of `label`, off the held-out fold, as (text, class): per_class rows and max_chars / 2 characters at most.

    Rows are chosen from ids and labels alone and taken whole, of any length, in a reproducible order
    until the class has used up its characters; the last one is cut there. Both bounds hold before
    anything is collected. Null ids, labels and texts take no part.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), parts) != out))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col(label) == value).select("doc_id", F.col(label).cast("int").alias("_class"))
        part = part.dropDuplicates(["doc_id"]).orderBy(order_key(F.col("doc_id")), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class rows of two numbers: a proven bound for the broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = first_rows(texts, "_class", per_class, max_chars // 2).collect()
    return [(row["text"], row["_class"]) for row in sorted(rows, key=lambda r: (r["_turn"], r["_class"]))]


def first_rows(texts: DataFrame, group: str, most: int, chars: int) -> DataFrame:
    """Of each group the rows (doc_id, text) first in order_key(), `most` rows and `chars` characters at most; _turn is a row's place.

    The row that uses up the characters is cut there; null and empty texts take no part. Of an id's texts that with the
    least hash counts, once. Rows are chosen by lengths alone: no more of any text moves than is taken, and a group has
    as many rows to rank as it has ids. texts is read twice.
    """
    texts = texts.where(F.length("text") > 0)
    lengths = texts.groupBy(group, "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("_mark"), F.length("text").alias("_length"))).alias("_text"))
    order = Window.partitionBy(group).orderBy(order_key(F.col("doc_id")), "doc_id")
    ranked = lengths.select(group, "doc_id", "_text.*").withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= most)
    before = F.sum("_length").over(Window.partitionBy(group).orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1))
    taken = ranked.withColumn("_left", chars - F.coalesce(before, F.lit(0).cast("long"))).where("_left > 0").drop("_length")
    # `most` rows of numbers a group.
    rows = texts.withColumn("_mark", F.xxhash64("text")).join(F.broadcast(taken), [group, "doc_id", "_mark"])
    cut = F.col("text").substr(F.lit(1), F.least(F.col("_left"), F.length("text")).cast("int"))
    return rows.select(group, "doc_id", "_turn", cut.alias("text")).dropDuplicates([group, "doc_id"])


#: Keys that hold more than 1 / HOT_KEYS of the rows of a join are hot; there are fewer of them than this.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with `table`, which has one row for each key; `count` tells how many of the `total` rows have it.

    The rows of hot keys stay where they are: what table says of those keys, HOT_KEYS rows at most, is
    broadcast. So no task gets more than a small part of all rows, whatever the keys. Both sides are read twice.
    """
    more = [c for c in table.columns if c not in (key, count)]
    is_hot = F.col(count) * HOT_KEYS > max(total, 1)
    hot = table.where(is_hot).select(key, F.struct(*more).alias("_hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    held = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, "_hot.*")
    rest = marked.where(F.col("_hot").isNull()).drop("_hot").join(table.where(~is_hot).select(key, *more), key, how)
    return held.unionByName(rest.select(*rows.columns, *more))


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[list[list]], list[list]]]) -> DataFrame:
    """Map batches of rows to batches of rows inside tasks.

    `make` runs once a task and gives a function from the input columns (lists) to the output
    columns (lists). Batches are cut so that the first string column holds about SLICE_CHARS.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in slices(batch):
                cols = [c.to_pylist() for c in piece.columns]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(step(cols), out_schema, strict=True)], schema=out_schema)

    return df.select(*columns).mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of df, with all their columns, whose value in `column` the function from make() keeps. No rows move between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = make()
        for batch in batches:
            for piece in slices(batch):
                yield piece.filter(pa.array(keeps(piece.column(0).field(column).to_pylist()), pa.bool_()))

    whole = df.select(F.struct("*").alias("row"))  # so that names don't matter
    return whole.mapInArrow(run, whole.schema).select("row.*")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has some SLICE_CHARS bytes, or one row."""
    if not batch.num_rows:
        return
    per_row = max(1, batch.nbytes // batch.num_rows)
    n = max(1, SLICE_CHARS // per_row)
    for start in range(0, batch.num_rows, n):
        yield batch.slice(start, n)


#: Runs of what may be letters: numeric signs such as fractions and Roman numerals are among them.
_ALNUM = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)


def letter_runs(token: str) -> list[str]:
    """The runs of letters of a token; numeric signs, such as fractions, are none."""
    runs = _ALNUM.findall(token)
    if all(map(str.isalpha, runs)):
        return runs
    return [part for run in runs for part in "".join(c if c.isalpha() else " " for c in run).split()]


def words_and_runs(token: str) -> list[str]:
    """A white-space token without the signs at its ends, and its runs of letters where it isn't one."""
    found, runs = _WORD.search(token), letter_runs(token)
    return runs if found is None or runs == [found.group()] else [found.group(), *runs]


class _Places(dict):
    def __missing__(self, token: str) -> int:
        return -1


class TokenMemo:
    """Scores of white-space tokens; those of up to LONGEST characters are worked out once a worker and kept, up to a number.

    `words` gives a lower-case token's words, and `score` maps a list of words to an array with one row
    of figures for each; a token's figures are the sums over its words, 0 without any.
    """

    LONGEST = 64

    def __init__(self, score: Callable[[list[str]], np.ndarray], width: int, most: int = 300_000, words: Callable[[str], list[str]] = letter_runs):
        self.score, self.width, self.most, self.words = score, width, most, words
        self.rows = _Places()
        self.values = np.zeros((1024, width))
        self.filled = 0

    def _figures(self, tokens: list[str]) -> np.ndarray:
        words, owner = [], []
        for i, token in enumerate(tokens):
            for word in self.words(token):
                words.append(word)
                owner.append(i)
        out = np.zeros((len(tokens), self.width))
        if words:
            np.add.at(out, np.array(owner), self.score(words))
        return out

    def _keep(self, tokens: list[str]) -> None:
        add = self._figures(tokens)
        while self.filled + len(tokens) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.filled : self.filled + len(tokens)] = add
        self.rows.update(zip(tokens, range(self.filled, self.filled + len(tokens)), strict=True))
        self.filled += len(tokens)

    def totals(self, texts: list[str]) -> np.ndarray:
        """One row of sums for each text."""
        if self.filled > self.most:
            self.rows, self.values, self.filled = _Places(), np.zeros((1024, self.width)), 0
        split = [t.lower().split() for t in texts]
        missing = [t for t in set().union(*split) - self.rows.keys() if len(t) <= self.LONGEST]
        if missing:
            self._keep(missing)
        place = self.rows.__getitem__
        out = np.zeros((len(texts), self.width))
        for i, tokens in enumerate(split):
            if tokens:
                at = np.fromiter(map(place, tokens), np.int64, len(tokens))
                kept = at >= 0
                if kept.all():
                    out[i] = self.values[at].sum(axis=0)
                else:
                    out[i] = self.values[at[kept]].sum(axis=0) + self._figures([t for t in tokens if len(t) > self.LONGEST]).sum(axis=0)
        return out


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words in a matrix, 0 beyond each word's end; and the words' lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max(initial=0))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(words), width), np.uint32)
    out[np.arange(width) < lengths[:, None]] = codes
    return out, lengths
