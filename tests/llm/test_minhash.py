import random
import re

import numpy as np
import pytest
from datadir import DATA
from cumulo.llm import minhash as M

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_sets(docs):
    out = {}
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    return out


def brute(docs):
    sets = brute_sets(docs)
    ids = sorted(sets)
    label = {i: i for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return sets, label


def check(spark, docs):
    rows = M.link(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    sets, label = brute(docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id), r
    return label


def texts(seed, n=25, copies=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    out, k = {}, 0
    for _ in range(n):
        words = [word() for _ in range(rng.choice([3, 20, 120, 400]))]
        for c in range(rng.randrange(1, copies)):
            changed = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5]) if c else 0):
                changed[rng.randrange(len(changed))] = word()
            out[k] = " ".join(changed).upper() if rng.random() < 0.2 else " ".join(changed)
            k += 1
    keys = list(out)
    rng.shuffle(keys)
    return dict(zip(keys, out.values(), strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    assert len(set(check(spark, texts(seed)).values())) > 10


def test_hub_whose_copies_do_not_link_directly(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_TILE", 7)
    monkeypatch.setattr(M, "TILE_SHINGLES", 900)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(150)]
    docs = {100: " ".join(words)}
    for i in range(40):
        changed = list(words)
        for at in rng.sample(range(150), 2):
            changed[at] = f"c{i}_{at}"
        docs[i] = " ".join(changed)
    assert set(check(spark, docs).values()) == {0}


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    check(spark, docs)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = M.link(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.component_id == r.doc_id and r.kept == (None if r.doc_id is None else True)
    assert {r.doc_id: r.n_shingles for r in rows} | {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 9: 1} == {r.doc_id: r.n_shingles for r in rows}
    assert M.link(no_docs).count() == 0
    kept = M.representatives(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2


def test_boundary_is_exact():
    assert len(M.shingles("a b c d e")) == 1 and len(M.shingles("a b")) == 1 and len(M.shingles(" \t\x0b")) == 0
    assert (M.shingles("A b\x85c") == M.shingles("a b\x85c")).all() and len(M.shingles("x " * 1000)) == 1
    assert len(M.shingles("É a b c d")) == 1 and (M.shingles("É a b c d") != M.shingles("é a b c d")).all()


def test_sequential_test_keeps_similar_pairs():
    rng = np.random.default_rng(3)
    bounds, lost, kept = M.least_agreement(), 0, 0
    for _ in range(2000):
        one = rng.integers(0, 256, M.HASHES, dtype=np.uint8)
        like = np.where(rng.random(M.HASHES) < 0.85, one, one + 1).astype(np.uint8)
        far = np.where(rng.random(M.HASHES) < 0.4, one, one + 1).astype(np.uint8)
        lost += not len(M.surviving(one, like[None], bounds))
        kept += len(M.surviving(one, far[None], bounds))
    assert lost == 0 and kept < 20


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.label for r in M.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_lower_threshold(spark):
    assert M.hashes(85) == M.HASHES and M.hashes(80) == 200 and (1 - 0.8**M.ROWS) ** (M.hashes(80) // M.ROWS) < M.BAND_MISS
    # Nine words changed at the end: 87 of 105 shingles are shared.
    docs = {}
    for i in range(40):
        words = [f"w{i}_{j}" for j in range(100)]
        docs[2 * i], docs[2 * i + 1] = " ".join(words), " ".join(words[:91] + [f"c{i}_{j}" for j in range(9)])
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.component_id for r in M.link(table, 80).collect()} == set(range(0, 80, 2))
    assert {r.component_id for r in M.link(table).collect()} == set(docs)
    assert {r.doc_id for r in M.representatives(table, 80).collect()} == set(range(0, 80, 2))


def test_repeated_ids_with_different_texts(spark):
    """Rows, not ids, are judged: the unique text of an id stays where another row of that id is a copy."""
    first, unique, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    near = first.replace("a59", "z")
    rows = [(3, first), (5, near), (5, unique), (5, other), (5, unique), (9, unique), (None, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in M.link(docs).collect())
    assert told == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (5, 5, True), (9, 5, False), (0, 0, None)])
    assert sorted((r.doc_id or 0, r.text) for r in M.representatives(docs).collect()) == sorted([(0, first), (3, first), (5, unique), (5, other)])


def test_representatives_keep_columns(spark, odd_docs):
    want = {r.doc_id: r for r in odd_docs.collect()}
    for r in M.representatives(odd_docs).collect():
        assert r == want[r.doc_id]


def test_hot_keys_do_not_move(spark, monkeypatch):
    from cumulo.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 10)
    rows = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(100)], "k long, v long")
    table = rows.groupBy("k").count().withColumn("double", common.F.col("k") * 2)
    for how in ("inner", "left"):
        got = common.join_hot(rows, table.where("k < 90"), "k", "count", 100, how)
        assert sorted((r.k, r.v, r.double) for r in got.collect() if r.double is not None) == sorted((r.k, r.v, r.k * 2) for r in rows.collect() if r.k < 90)
        assert got.count() == (100 if how == "left" else 95)
    check(spark, texts(3, n=8))


def test_chain_of_near_copies(spark, monkeypatch):
    """Each text is near the next alone, and ids are in no order: links have to be found across tiles."""
    monkeypatch.setattr(M, "TILE_SHINGLES", 700)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    order, docs = rng.sample(range(60), 60), {}
    for at in order:
        docs[at] = " ".join(words)
        for k in range(10):
            words[(at * 10 + k) % 200] = f"c{at}_{k}"
    check(spark, docs)


def test_last_plan_is_small(spark):
    """Joins are not planned again for each time their rows are read: the last query of all keeps the driver's memory small."""
    docs = spark.createDataFrame(list(texts(5, n=6).items()), "doc_id long, text string")
    for last in (M.link(docs), M.representatives(docs)):
        plan = last._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.count("Exchange ") <= 10, plan
