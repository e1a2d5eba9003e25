import numpy as np
import pytest
from datadir import DATA
from cumulo.llm import ann


def brute(rows, k=20, every=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        other = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in other[np.lexsort((ids[other], -s[other]))][:k]]
    return out


def test_hadamard():
    x = np.eye(8)
    h = ann.hadamard(x)
    assert np.allclose(h @ h.T, x) and np.allclose(np.abs(h), 1 / np.sqrt(8))


def test_recall_on_the_table(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = ann.search_table(table).collect()
    found = {(r.query_id, r.vec_id): r for r in got}
    hits = sum((q, v) in found for q, best in want.items() for v, _ in best)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q in want:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1)) and q not in {r.vec_id for r in own}
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)


@pytest.mark.parametrize("floats", [30, 100, 10**6])
def test_all_buckets_are_exact(spark, monkeypatch, floats):
    monkeypatch.setattr(ann, "PART_FLOATS", floats)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    base = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding"), "vec_id", "embedding")
    exact = brute([(r.id, r.vec) for r in base.collect()])
    got = {}
    for r in ann.nearest(base, base.where("id % 20 = 0"), probes=10**6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [v for v, _ in best] for q, best in got.items()} == {q: [v for v, _ in best] for q, best in exact.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in got for a, b in zip(got[q], exact[q], strict=True))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, []), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0, 0.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search_table(table).collect()] == [(0, 1, 1, 1.0)]
    assert ann.search_table(table.where("false")).count() == 0


@pytest.mark.parametrize("dim", [64, 128, 256])
def test_recall_of_random_vectors(spark, dim):
    """Random directions are the hardest: nothing is much nearer than the rest."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, dim)) * rng.uniform(0.8, 1.2, (3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows)
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    assert sum(len(got[q] & {v for v, _ in best}) for q, best in want.items()) >= 0.93 * 20 * len(want)


def test_clustered_vectors_need_few_probes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(100, 32))
    rows = [(i, (centres[rng.integers(100)] + rng.normal(size=32) * 0.3).tolist()) for i in range(5000)]
    base = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    assert ann.fitted_probes(base)[32] <= 16
    want = brute(rows)
    got = {(r.query_id, r.vec_id) for r in ann.nearest(base, base.where("id % 20 = 0")).collect()}
    assert sum((q, v) in got for q, best in want.items() for v, _ in best) >= 0.93 * 20 * len(want)


@pytest.mark.parametrize("n", [2, 15, 21, 60])
def test_few_vectors_are_all_found(spark, n):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(n)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search_table(table, 1).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [v for v, _ in best] for q, best in brute(rows, every=1).items()}
    assert {q: len(v) for q, v in got.items()} == {q: min(20, n - 1) for q in want}
    if n < 22:
        assert got == want
    else:
        assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * n


def test_many_equal_vectors(spark):
    """A third of all rows is one vector: ties go to the smallest ids."""
    rng = np.random.default_rng(7)
    rows = [(i, [1.0] * 16 if i % 3 == 0 else rng.normal(size=16).tolist()) for i in range(900)]
    got = {}
    for r in ann.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows)
    for q in (0, 60, 840):
        assert len(got[q]) == 20 and [v for v in got[q] if v % 3 == 0 and rows[v][1] == [1.0] * 16] == [v for v, _ in want[q] if v % 3 == 0 and rows[v][1] == [1.0] * 16]
