"""Quality by a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Learned filters run over
each chunk at a stride, the largest response of each filter in a chunk is its feature, a linear layer
turns them into the chunk's logit, and the mean of the logits goes into one probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, keep_rows, labelled_sample, map_rows

#: Documents of each class and characters in all that are learned from.
PER_CLASS, SAMPLE_CHARS = 700, 5_000_000
#: Bytes of a chunk and of its step; width, stride, number of filters and size of a byte's embedding.
CHUNK, STEP = 512, 448
SPAN, STRIDE, FILTERS, WIDTH = 8, 4, 16, 6
FOLDS, OUT, THRESHOLD = 5, 0, 0.3
#: Chunks whose responses are worked out at once.
SLICE = 256
#: Stands beyond a document's end.
PAD = 256


def chunked(raw: bytes) -> np.ndarray:
    """The document in rows of CHUNK symbols that overlap; at least one row."""
    n = max(1, -(-max(0, len(raw) - CHUNK) // STEP) + 1)
    flat = np.full((n - 1) * STEP + CHUNK, PAD, np.int16)
    flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STEP]


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (257, WIDTH)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (SPAN, WIDTH, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.layer = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def tables(self) -> np.ndarray:
        """What each byte adds to each filter at each place of its span."""
        return self.embed[None] @ self.filters

    def pooled(self, rows: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and where it stands."""
        places = (CHUNK - SPAN) // STRIDE + 1
        top, at = np.zeros((len(rows), FILTERS), np.float32), np.zeros((len(rows), FILTERS), np.int64)
        for start in range(0, len(rows), SLICE):
            some = rows[start : start + SLICE]
            total = np.zeros((len(some), places, FILTERS), np.float32)
            for j in range(SPAN):
                total += tables[j][some[:, j : j + STRIDE * (places - 1) + 1 : STRIDE]]
            best = total.argmax(axis=1)
            at[start : start + SLICE] = best
            top[start : start + SLICE] = np.take_along_axis(total, best[:, None], axis=1)[:, 0]
        return top, at

    def logits(self, rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return np.tanh(self.pooled(rows, tables)[0] + self.shift) @ self.layer + self.bias


def fit(sample: list[tuple[str, int]], epochs: int = 10, batch: int = 48, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on the log loss of documents, both classes weighing alike. Without both classes only the bias tells."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array([c for _, c in sample], np.float32)
    if len(set(y.tolist())) < 2:
        net.layer[:] = 0
        net.bias[:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return net
    # A short cut of each document joins it, so that few bytes are judged as well.
    raw = [t.encode() for t, _ in sample]
    cuts = [(int(rng.integers(0, max(1, len(r) - 40))), int(rng.integers(20, 400))) for r in raw]
    raw += [r[at : at + n] for r, (at, n) in zip(raw, cuts, strict=True)]
    y = np.concatenate([y, y])
    rows = [chunked(r) for r in raw]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    names = ["embed", "filters", "shift", "layer", "bias"]
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            docs = order[start : start + batch]
            x = np.concatenate([rows[i] for i in docs])
            sizes = np.array([len(rows[i]) for i in docs])
            owner = np.repeat(np.arange(len(docs)), sizes)
            top, at = net.pooled(x, net.tables())
            hidden = np.tanh(top + net.shift)
            logit = np.bincount(owner, hidden @ net.layer, len(docs)) / sizes + net.bias
            wrong = ((1 / (1 + np.exp(-logit)) - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
            each = (wrong / sizes)[owner].astype(np.float32)
            back = each[:, None] * net.layer * (1 - hidden**2)
            grads = {"bias": np.array([wrong.sum()]), "layer": hidden.T @ each, "shift": back.sum(axis=0), "filters": np.zeros_like(net.filters), "embed": np.zeros_like(net.embed)}
            for j in range(SPAN):  # only the places with the largest response learn
                symbols = x[np.arange(len(x))[:, None], at * STRIDE + j]
                for f in range(FILTERS):
                    grads["filters"][j, :, f] = back[:, f] @ net.embed[symbols[:, f]]
                table = np.zeros((257, FILTERS), np.float32)
                np.add.at(table, (symbols, np.arange(FILTERS)[None]), back)
                grads["embed"] += table @ net.filters[j].T
            step += 1
            for n in names:
                first[n] += 0.1 * (grads[n] - first[n])
                second[n] += 0.01 * (grads[n] ** 2 - second[n])
                getattr(net, n)[...] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
    return net


def probabilities(net: Network, tables: np.ndarray, texts: list[str | None]) -> np.ndarray:
    rows = [chunked((t or "").encode()) for t in texts]
    sizes = np.array([len(r) for r in rows])
    logits = np.add.reduceat(net.logits(np.concatenate(rows), tables), np.cumsum(sizes) - sizes) / sizes
    return 1 / (1 + np.exp(-np.clip(logits.astype(float), -500, 500)))


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each row of docs.

    Null and empty texts are one chunk of padding and get its score. A null id stays; repeated rows
    give repeated rows; columns besides doc_id and text are not read.
    """

    def make():
        tables = net.tables()

        def step(cols):
            scores = probabilities(net, tables, cols[1])
            return cols[0], scores.tolist(), (scores >= threshold).astype(int).tolist()

        return step

    return map_rows(docs, ["doc_id", "text"], "doc_id long, score double, predicted int", make)


def fit_on(docs: DataFrame, labels: DataFrame) -> Network:
    return fit(labelled_sample(docs, labels, "quality", FOLDS, OUT, PER_CLASS, SAMPLE_CHARS))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that a network fitted on them and their labels does not reject."""
    net = fit_on(docs, labels)

    def make():
        tables = net.tables()
        return lambda texts: (probabilities(net, tables, texts) >= threshold).tolist()

    return keep_rows(docs, "text", make)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels' `quality` and scores all of docs: doc_id, held_out, score, predicted."""
    return score(docs, fit_on(docs, labels)).select("doc_id", held_out(F.col("doc_id"), FOLDS, OUT).alias("held_out"), "score", "predicted")
