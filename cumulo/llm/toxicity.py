"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of the character n-grams of its words, marks of the words' ends included: of runs of
letters, and of tokens with digits or signs inside, which stand for letters in some spellings. The mean of the n-grams' embeddings goes through a linear layer and a softmax of two classes; embeddings
and layer are learned together. A misspelt or inflected word shares most n-grams with those seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TokenMemo, held_out, words_and_runs, labelled_sample, map_rows

#: Documents of each class and characters in all that are learned from.
PER_CLASS, SAMPLE_CHARS = 1200, 10_000_000
GRAMS = (3, 4, 5, 6)
BITS, WIDTH = 17, 2
#: Places of n-grams that are worked out at once.
STEP = 500_000
FOLDS, OUT, THRESHOLD = 3, 1, 0.7
_BASE = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the words' n-grams and the word that each belongs to, for STEP places at a time: memory doesn't follow a word's length."""
    marked = [f"<{w}>" for w in words]
    ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    for start in range(0, len(codes), STEP):
        wide = codes[start : start + STEP + max(GRAMS) - 1].astype(np.uint64)
        at = np.arange(start, min(start + STEP, len(codes)))
        owners = np.searchsorted(ends, at, side="right")
        room = ends[owners] - at
        h = np.zeros_like(wide)
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(wide) - n + 1] * _BASE + wide[n - 1 :]
            if n in GRAMS:
                inside = np.flatnonzero(room >= n)
                mixed = h[inside]
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield (mixed >> np.uint64(64 - BITS)).astype(np.int64), owners[inside]


def gram_sums(words: list[str], table: np.ndarray) -> np.ndarray:
    """For each word the sum of its n-grams' weights, and their number."""
    out = np.zeros((len(words), 2))
    for buckets, owners in grams(words):
        if len(owners):
            first = owners[0]
            n = owners[-1] - first + 1
            out[first : first + n, 0] += np.bincount(owners - first, table[buckets], n)
            out[first : first + n, 1] += np.bincount(owners - first, minlength=n)
    return out


def _bags(texts: list[str]):
    """Rows, buckets and shares of the texts' bags."""
    rows, cols, shares = [], [], []
    for i, text in enumerate(texts):
        counts = Counter(w for token in text.lower().split() for w in words_and_runs(token))
        if not counts:
            continue
        weight, sums = np.array(list(counts.values()), float), np.zeros(1 << BITS)
        for buckets, owners in grams(list(counts)):
            sums += np.bincount(buckets, weight[owners], 1 << BITS)
        unique = np.flatnonzero(sums)
        rows.append(np.full(len(unique), i, np.int32))
        cols.append(unique.astype(np.int32))
        shares.append((sums[unique] / max(1.0, sums.sum())).astype(np.float32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(shares)


def fit(sample: list[tuple[str, int]], steps: int = 120, sparsity: float = 0.007, least_docs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """For each bucket the weight of class 1 against 0 that embedding and layer amount to, and the bias.

    Accelerated proximal gradient steps on the log loss, both classes weighing alike. `sparsity`
    shrinks whole embeddings, so those of n-grams that tell nothing are zero; n-grams of fewer
    than least_docs documents (or 1 in 20 of a small sample) stay zero. Without both classes in the sample all weights are 0.
    """
    y = np.array([c for _, c in sample], float)
    if len(set(y.tolist())) < 2:
        return np.zeros(1 << BITS), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    n = len(sample)
    rows, cols, shares = _bags([t for t, _ in sample])
    keep = np.bincount(cols, minlength=1 << BITS)[cols] >= min(least_docs, max(2, n // 20))
    rows, cols, shares = rows[keep], cols[keep], shares[keep]
    order = np.argsort(cols, kind="stable")
    rows, shares = rows[order], shares[order]
    del order
    times = np.bincount(cols, minlength=1 << BITS)
    used = np.flatnonzero(times)
    first = np.cumsum(times[used]) - times[used]
    where = np.repeat(np.arange(len(used), dtype=np.int32), times[used])
    del cols
    # Embeddings are learned in units of an n-gram's usual share, which for frequent ones is large.
    unit = 1 / np.sqrt(np.bincount(where, shares**2, len(used)) / n + 1e-12)
    value = shares * unit.astype(np.float32)[where]
    del shares
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    rng = np.random.default_rng(seed)
    layer = rng.normal(size=(WIDTH, 2))
    layer /= np.linalg.norm(layer[:, 1] - layer[:, 0])

    def spread(grad):
        return np.stack([np.add.reduceat(value * np.take(grad[:, k].astype(np.float32), rows), first, dtype=np.float64) if len(first) else np.zeros(0) for k in range(grad.shape[1])], axis=1)

    def means(embed):
        at = np.flatnonzero(np.take(embed.any(axis=1), where))  # most embeddings are zero
        return np.stack([np.bincount(rows[at], value[at] * np.take(embed[:, k].copy(), where[at]), n) for k in range(embed.shape[1])], axis=1)

    direction, steepest = rng.normal(size=(len(used), 1)), 1.0
    for _ in range(8):  # the loss's greatest curvature gives the length of a step
        direction = spread(means(direction) * weight[:, None] / 4)
        steepest = np.linalg.norm(direction) or 1.0
        direction /= steepest
    embed = ahead = np.zeros((len(used), WIDTH))
    bias, t = np.zeros(2), 1.0
    for _ in range(steps):
        mean = means(ahead)
        logits = mean @ layer + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        wrong = (p - np.stack([1 - y, y], axis=1)) * weight[:, None]
        moved = ahead - spread(wrong @ layer.T) / steepest
        norms = np.linalg.norm(moved, axis=1, keepdims=True)
        moved *= np.maximum(0, 1 - sparsity / steepest / np.maximum(norms, 1e-12))
        layer = layer - mean.T @ wrong / steepest
        layer /= np.linalg.norm(layer[:, 1] - layer[:, 0])
        bias = bias - wrong.sum(axis=0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, embed, t = moved + (t - 1) / later * (moved - embed), moved, later
    table = np.zeros(1 << BITS)
    table[used] = (embed @ (layer[:, 1] - layer[:, 0])) * unit
    return table, float(bias[1] - bias[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each row of docs.

    The mean over a text's n-grams of embedding times layer is the sum of their weights over their
    number. Null and empty texts, and those without letters and digits, have the score of the bias alone. A null id stays;
    repeated rows give repeated rows; columns besides doc_id and text are not read.
    """
    table, bias = model

    def make():
        memo = TokenMemo(lambda words: gram_sums(words, table), 2, words=words_and_runs)

        def step(cols):
            totals = memo.totals([t or "" for t in cols[1]])
            logits = np.clip(totals[:, 0] / np.maximum(totals[:, 1], 1) + bias, -500, 500)
            scores = 1 / (1 + np.exp(-logits))
            return cols[0], scores.tolist(), (scores >= threshold).astype(int).tolist()

        return step

    return map_rows(docs, ["doc_id", "text"], "doc_id long, score double, predicted int", make)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels' `toxic` and scores all of docs: doc_id, held_out, score, predicted."""
    model = fit(labelled_sample(docs, labels, "toxic", FOLDS, OUT, PER_CLASS, SAMPLE_CHARS))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), FOLDS, OUT).alias("held_out"), "score", "predicted")
