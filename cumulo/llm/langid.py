"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's likelihood is
the sum over all ways to cut it into pieces, found by a forward pass; a text's is the product over
its words. The probabilities come from expectation-maximisation over a bounded sample.
"""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TokenMemo, first_rows, fold, held_out, keep_rows, letter_runs, map_rows, order_key, padded

#: Documents a language, characters in all, and languages, the most frequent first, that the probabilities are learned
#: from. Languages share the characters equally.
PER_LANGUAGE, SAMPLE_CHARS, LANGUAGES = 300, 8_000_000, 1000
#: Letter runs are learned from in pieces of RUN_CHARS.
RUN_CHARS = 24
#: Words of more letters are summed over in blocks, SEGMENT letters at a time.
BLOCK, SEGMENT = 512, 131_072
#: Words that are summed over at once. This and SEGMENT hold for up to FEW languages, and are divided by how many times more there are.
GROUP, FEW = 4096, 16
START = "▁"
FOLDS, OUT = 3, 1
#: Posterior below which a filter rejects a document.
LEAST_SCORE = 0.5
#: Probability of a character that no piece covers, and weight of the pooled probabilities.
UNKNOWN, POOLED = 1e-6, 1e-3
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary's lower-case letter pieces, found by hash in a matrix of code points."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
        keep = sorted(p for p in pieces if p and p == p.lower() and (p == START or p.removeprefix(START).isalpha()))
        hashes = np.array([self._hash(p) for p in keep], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.n, self.longest = hashes[order], len(keep), max(map(len, keep))

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def index(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length, the index of the piece that starts at each column: n for an unknown character, n + 1 for none."""
        wide, out = codes.astype(np.uint64), []
        h = np.zeros_like(wide)
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            h = h[:, : codes.shape[1] - length + 1] * _BASE + wide[:, length - 1 :]
            at = np.minimum(np.searchsorted(self.hashes, h), self.n - 1)
            out.append(np.where(self.hashes[at] == h, at, self.n if length == 1 else self.n + 1))
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _share(size: int, langs: int) -> int:
    """size, or less where languages are many, for the same memory."""
    return max(1, size * FEW // max(FEW, langs))


def _groups(words: list[str], most: int = GROUP):
    """Indexes of words, in groups of like length and of `most` words at most, so that memory doesn't follow their number."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kind = np.where(lengths < 64, np.ceil(np.log2(np.maximum(lengths, 4))), lengths)
    for k in np.unique(kind):
        alike = np.flatnonzero(kind == k)
        for start in range(0, len(alike), most):
            yield alike[start : start + most]


def _step(window: list[np.ndarray], index: list[np.ndarray], end: int, table: np.ndarray) -> np.ndarray:
    """Forward sums at column `end` from those before it, the latest last: by row, initial state and language."""
    total = np.zeros_like(window[-1])
    for length in range(1, min(len(index), end, len(window)) + 1):
        piece = index[length - 1][:, end - length]
        at = np.flatnonzero(piece < len(table) - 1)  # long pieces are rare
        if len(at):
            total[at] += window[-length][at] * table[piece[at]][:, None]
    return total


def _scaled(window: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The window over its latest sums' largest, and the logs of these."""
    scale = window[-1].max(axis=1, keepdims=True)
    scale[scale == 0] = 1
    return [w / scale for w in window], np.log(scale[:, 0])


def log_likelihoods(words: list[str], found: Pieces, table: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of each word, for each language (columns of table)."""
    out = np.zeros((len(words), table.shape[1]))
    for group in _groups(words, _share(GROUP, table.shape[1])):
        if len(words[group[0]]) > 2 * BLOCK:
            for i in group:
                out[i] = _long_word(words[i], found, table)
            continue
        codes, lengths = padded([START + words[i] for i in group])
        index = found.index(codes)
        logs = np.zeros((len(group), table.shape[1]))
        window = [np.ones((len(group), 1, table.shape[1]))]
        for end in range(1, codes.shape[1] + 1):
            window = [*window[1 - found.longest :], _step(window, index, end, table)]
            done = lengths == end
            if done.any():
                out[group[done]] = np.log(window[-1][done, 0]) + logs[done]
            if end % 8 == 0:
                window, more = _scaled(window)
                logs += more
    return out


def _long_word(word: str, found: Pieces, table: np.ndarray) -> np.ndarray:
    """log_likelihoods() of one word, in time that follows its length.

    The last sums before a block give those at its end by a matrix. Blocks' matrices are worked out side by
    side, and applied one after the other.
    """
    deep, langs = found.longest, table.shape[1]
    codes = np.concatenate([np.zeros(deep, np.uint32), np.frombuffer((START + word).encode("utf-32-le"), np.uint32)])
    state, logs, at = np.zeros((deep, langs)), np.zeros(langs), 0
    state[0] = 1  # the latest sum first
    while left := len(codes) - deep - at:
        size = min(left, BLOCK)
        rows = max(1, min(left, _share(SEGMENT, langs)) // size)
        index = found.index(np.lib.stride_tricks.sliding_window_view(codes[at : at + rows * size + deep], size + deep)[::size])
        window = [np.zeros((rows, deep, langs)) for _ in range(deep)]
        for k in range(deep):
            window[-1 - k][:, k] = 1
        scales = np.zeros((rows, langs))
        for end in range(deep + 1, deep + size + 1):
            window = [*window[1:], _step(window, index, end, table)]
            if end % 8 == 0:
                window, more = _scaled(window)
                scales += more
        for row in range(rows):
            state = np.stack([(w[row] * state).sum(axis=0) for w in reversed(window)])
            largest = state.max(axis=0)
            state, logs = state / largest, logs + scales[row] + np.log(largest)
        at += rows * size
    return np.log(state[0]) + logs


def _expected(words: list[str], weights: np.ndarray, found: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words."""
    counts = np.zeros(len(p))
    for group in _groups(words):
        codes, lengths = padded([START + words[i] for i in group])
        index, n, width = found.index(codes), len(group), codes.shape[1]
        ahead = np.zeros((width + 1, n))
        ahead[0] = 1
        for end in range(1, width + 1):
            for length in range(1, min(found.longest, end) + 1):
                ahead[end] += ahead[end - length] * p[index[length - 1][:, end - length]]
        back = np.zeros((width + 1, n))
        back[lengths, np.arange(n)] = 1
        for start in range(width - 1, -1, -1):
            for length in range(1, min(found.longest, width - start) + 1):
                back[start] += back[start + length] * p[index[length - 1][:, start]]
        share = weights[group] / back[0]
        for start in range(width):
            for length in range(1, min(found.longest, width - start) + 1):
                i = index[length - 1][:, start]
                counts += np.bincount(i, ahead[start] * p[i] * back[start + length] * share, len(p))
    return counts


def fit(sample: list[tuple[str, str]], path: str, rounds: int = 4) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and their piece probabilities in columns, from (text, lang) pairs."""
    from collections import Counter

    found = pieces(path)
    by_lang: dict[str, Counter] = {}
    for text, lang in sample:
        by_lang.setdefault(lang, Counter()).update(w[i : i + RUN_CHARS] for w in letter_runs(text.lower()) for i in range(0, len(w), RUN_CHARS))
    langs = sorted(lang for lang, words in by_lang.items() if words)
    columns = []
    for lang in langs:
        words, weights = list(by_lang[lang]), np.array(list(by_lang[lang].values()), float)
        p = np.full(found.n + 2, 1.0 / found.n)
        p[found.n], p[found.n + 1] = UNKNOWN, 0
        for _ in range(rounds):
            counts = _expected(words, weights, found, p)[: found.n]
            p[: found.n] = (counts + 1e-3) / (counts.sum() + 1e-3 * found.n)
        columns.append(p)
    if not columns:
        return [], np.zeros((found.n + 2, 0))
    table = np.array(columns).T
    table[: found.n] = (1 - POOLED) * table[: found.n] + POOLED * table[: found.n].mean(axis=1, keepdims=True)
    return langs, table


def draw_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most per_language texts a language, max_chars in all, chosen by ids alone off the held-out fold.

    Each language has an equal share of the characters, whatever the others have: its texts, whole and of
    any length, in turn until the share is used; the last of them is cut there.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != OUT)).select("doc_id", "lang").distinct()
    key = order_key(F.col("doc_id"))
    # Thinned by each language's count first, so that the ranking sees a few times per_language rows of each.
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_size")).orderBy(F.desc("_size"), "lang").limit(LANGUAGES)
    known = known.join(F.broadcast(sizes), "lang").where(F.pmod(key, F.lit(1_000_000)) * F.col("_size") < 3_000_000 * per_language)
    first = Window.partitionBy("lang").orderBy(key, "doc_id")
    chosen = known.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language).select("doc_id", F.col("lang").alias("_lang"))
    # per_language * LANGUAGES small rows at most: a proven bound for the broadcast.
    chosen = chosen.dropDuplicates(["doc_id"])
    share = max(1, max_chars // max(1, sizes.count()))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = first_rows(texts, "_lang", per_language, share).collect()
    return [(r["text"], r["_lang"]) for r in sorted(rows, key=lambda r: (r["_turn"], r["_lang"]))]


def scorer(model: tuple[list[str], np.ndarray], path: str):
    """A function from texts to their languages and scores."""
    langs, table = model
    found = pieces(path)
    # The memo holds fewer tokens where languages are many, for the same memory.
    most = min(300_000, 12_000_000 // (len(langs) + 1))
    memo = TokenMemo(lambda words: np.concatenate([log_likelihoods(words, found, table), np.ones((len(words), 1))], axis=1), len(langs) + 1, most)

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for row in memo.totals([t or "" for t in texts]):
            if not langs or not row[-1]:
                names.append("und")
                scores.append(0.0)
                continue
            weights = np.exp(row[:-1] - row[:-1].max())
            best = int(weights.argmax())
            names.append(langs[best])
            scores.append(float(weights[best] / weights.sum()))
        return names, scores

    return judge


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs.

    A text that is null or has no letter is `und` with score 0; the score of others is the posterior
    of lang_pred with all languages alike beforehand. With no language learned, all is `und`. Ties go
    to the language first by name. A null id stays; repeated rows give repeated rows.
    """
    path = path or default_vocabulary()

    def make():
        judge = scorer(model, path)
        return lambda cols: (cols[0], *judge(cols[1]))

    return map_rows(docs, ["doc_id", "text"], "doc_id long, lang_pred string, score double", make)


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, that have letters and whose language is found with a score of `least` or more."""
    model, path = fit(draw_sample(docs), default_vocabulary()), default_vocabulary()

    def make():
        judge = scorer(model, path)

        def keeps(texts):
            names, scores = judge(texts)
            return [n != "und" and s >= least for n, s in zip(names, scores, strict=True)]

        return keeps

    return keep_rows(docs, "text", make)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from docs and predicts all of them: doc_id, held_out, lang_pred, score."""
    model = fit(draw_sample(docs), default_vocabulary())
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), FOLDS, OUT).alias("held_out"), "lang_pred", "score")
