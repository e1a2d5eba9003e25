"""Held-out accuracy of the trained operators, and odd inputs."""

import math
import zlib
from itertools import product

import numpy as np
import pytest
from cumulo.llm import common, langid, quality, toxicity
from tests.llm.conftest import TEXTS

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def judged(rows, labels, column):
    """Held-out rows with their labels."""
    want = {r.doc_id: r[column] for r in labels.collect()}
    return [(r, want[r.doc_id]) for r in rows.collect() if r.held_out and r.doc_id in want]


def test_folds(spark):
    rows = spark.range(50).selectExpr("id as doc_id").select("doc_id", common.held_out(common.F.col("doc_id"), 3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_sample_is_bounded_and_off_the_held_out_fold(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    sample = common.labelled_sample(docs, labels, "toxic", 3, 1, 5, 100_000)
    assert 0 < len(sample) <= 10 and sum(len(t) for t, _ in sample) <= 100_000
    held = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    learned = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    assert not {t for t, _ in common.labelled_sample(docs, labels, "toxic", 3, 1, 50, 10**7)} & (held - learned)


def test_toxicity_held_out(spark):
    rows = judged(toxicity.classify(table(spark, "documents"), table(spark, "labels")), table(spark, "labels"), "toxic")
    clean, toxic = ([r.predicted for r, y in rows if y == c] for c in (0, 1))
    assert toxic and sum(toxic) >= 0.6 * len(toxic)
    assert rows and sum(clean) <= 0.1 * len(clean) and all((r.score >= 0.7) == bool(r.predicted) for r, _ in rows)


def test_toxicity_learns_misspellings():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    text = lambda bad: " ".join([word() for _ in range(60)] + (["zzqxwv" + str(rng.choice(["", "er", "ing"]))] * 2 if bad else []))
    table_, bias = toxicity.fit([(text(i % 2), i % 2) for i in range(300)])


    def logit(text):
        total, n = toxicity.gram_sums([w for t in text.split() for w in common.words_and_runs(t)], table_).sum(axis=0)
        return total / n + bias

    clean = [logit(" ".join(word() for _ in range(60))) for _ in range(20)]
    for seen in ("zzqxwvish zzqxwvot", "zzqxwv0 zzqxwv! z.zqxwv", "zzqx1wv zzqxw-v zzq3xwver"):
        assert np.median([logit(" ".join(word() for _ in range(60)) + " " + seen) for _ in range(20)]) > 0 > np.median(clean)


def test_grams_are_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "STEP", 7)
    table_ = np.random.default_rng(5).normal(size=1 << toxicity.BITS)
    words = ["a", "st0pid", "x" * 40, "é", "日本語のテキスト"]

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * int(toxicity._BASE) + ord(c)) & (1 << 64) - 1
        return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> 64 - toxicity.BITS

    for word, (total, n) in zip(words, toxicity.gram_sums(words, table_), strict=True):
        marked = f"<{word}>"
        every = [bucket(marked[i : i + k]) for k in toxicity.GRAMS for i in range(len(marked) - k + 1)]
        assert n == len(every) and total == pytest.approx(sum(table_[b] for b in every))


def test_memory_does_not_follow_the_longest_word():
    import tracemalloc

    memo = common.TokenMemo(lambda words: toxicity.gram_sums(words, np.ones(1 << toxicity.BITS)), 2, words=common.words_and_runs)
    text = " ".join(f"word{i}" for i in range(5000)) + " " + "ab" * 1_500_000
    tracemalloc.start()
    total, n = memo.totals([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == n > 12_000_000 - 100 and peak < 400_000_000
    assert len(memo.rows) == 5000 and (memo.totals([text])[0] == [total, n]).all()


def test_one_class_or_no_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        for known in (labels, labels.where("false")):
            rows = module.classify(odd_docs, known).collect()
            assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.classify(no_docs, labels).count() == 0


def test_quality_held_out(spark):
    rows = judged(quality.classify(table(spark, "documents"), table(spark, "labels")), table(spark, "labels"), "quality")
    good = [r.predicted for r, y in rows if y]
    assert sum(good) >= 0.9 * len(good) and np.mean([r.predicted == y for r, y in rows]) >= 0.85


def test_chunks_cover_all_bytes():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        raw = bytes(i % 251 for i in range(n))
        rows = quality.chunked(raw)
        covered = {}
        for i, row in enumerate(rows):
            covered |= {i * quality.STEP + j: int(v) for j, v in enumerate(row)}
        assert bytes(covered[i] for i in range(n)) == raw and all(v == quality.PAD for i, v in covered.items() if i >= n)


def test_pooling_is_brute_force():
    net = quality.Network()
    rows = quality.chunked(b"some bytes to look at " * 30)
    top, at = net.pooled(rows, net.tables())
    for c, f in product(range(len(rows)), range(3)):
        every = [sum(float(net.embed[rows[c, p + j]] @ net.filters[j, :, f]) for j in range(quality.SPAN)) for p in range(0, quality.CHUNK - quality.SPAN + 1, quality.STRIDE)]
        assert top[c, f] == pytest.approx(max(every), abs=1e-4) and every[at[c, f]] == pytest.approx(max(every), abs=1e-4)


def brute_likelihood(word, found, p):
    word, total = langid.START + word, 0.0
    hashes = {int(h): i for i, h in enumerate(found.hashes)}

    def walk(at, prob):
        nonlocal total
        if at == len(word):
            total += prob
            return
        for n in range(1, min(found.longest, len(word) - at) + 1):
            i = hashes.get(found._hash(word[at : at + n]), found.n if n == 1 else None)
            if i is not None:
                walk(at + n, prob * p[i])

    walk(0, 1.0)
    return math.log(total)


def test_forward_sums_all_segmentations():
    found = langid.pieces(langid.default_vocabulary())
    langs, p = langid.fit([("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de")], langid.default_vocabulary())
    words = ["the", "and", "katze", "zzé", "日本", "a"]
    got = langid.log_likelihoods(words, found, p)
    for i, word in enumerate(words):
        for k in range(len(langs)):
            assert got[i, k] == pytest.approx(brute_likelihood(word, found, p[:, k]))
    assert np.isfinite(langid.log_likelihoods(["ab" * 500], found, p)).all()


def test_blocks_of_long_words(monkeypatch):
    found = langid.pieces(langid.default_vocabulary())
    langs, p = langid.fit([("the cat and the international dog " * 5, "en"), ("der hund und die verantwortung " * 5, "de")], langid.default_vocabulary())
    assert found.longest > 8
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("etaoinshrdlu"), 700)), "international" * 40, "é中" * 300, "ab" * 129]
    whole = langid.log_likelihoods(words, found, p)
    monkeypatch.setattr(langid, "BLOCK", 20)
    monkeypatch.setattr(langid, "SEGMENT", 300)
    assert langid.log_likelihoods(words, found, p) == pytest.approx(whole, rel=1e-12)


def test_very_long_texts_are_scored_and_learned(spark):
    """Runs and texts far longer than any other, among ordinary ones, in each of the models."""
    rows = [(i, "some good words here " * 20, "en", i % 2) for i in range(40)] + [(100, "x" * 1_000_000, "en", 1), (101, "the word and " * 80_000, "en", 0), (102, "中" * 300_000, "zh", 1), (103, " " * 1_000_000, "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").withColumn("quality", common.F.col("toxic"))
    labels = docs.select("doc_id", "toxic", "quality")
    for out in (toxicity.classify(docs, labels), quality.classify(docs, labels), langid.identify(docs)):
        assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}
    sample = common.labelled_sample(docs, labels, "toxic", 3, 1, 1000, 10**7)
    assert {len(t) for t, _ in sample} & {1_000_000, 1_040_000, 300_000}


def test_sample_ends_with_its_characters(spark):
    rows = [(i, "y" * 1000, 1) for i in range(60)] + [(100 + i, "n" * 10, 0) for i in range(60)] + [(7, "another text of this id", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample = common.labelled_sample(docs, docs.select("doc_id", "toxic"), "toxic", 3, 1, 30, 20_500)
    assert sum(len(t) for t, c in sample if c) == 10_250 and sum(c == 0 for _, c in sample) == 30
    assert sample == common.labelled_sample(docs.repartition(7), docs.select("doc_id", "toxic"), "toxic", 3, 1, 30, 20_500)


def test_language_held_out(spark):
    docs = table(spark, "documents")
    rows = judged(langid.identify(docs), docs, "lang")
    assert np.mean([r.lang_pred == y for r, y in rows]) >= 0.95


def test_language_of_odd_texts(spark, odd_docs, no_docs):
    rows = {r.doc_id: r for r in langid.identify(odd_docs).collect()}
    assert [rows[i].lang_pred for i in range(4)] == ["und"] * 4 and rows[0].score == 0 and all(0 <= r.score <= 1 for r in rows.values())
    signs = [i for i, t in enumerate(TEXTS) if t and not any(c.isalpha() for c in t)]
    assert len(signs) >= 5 and all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in signs)
    assert langid.identify(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs.withColumn("lang", common.F.lit(None).cast("string"))).collect()} == {"und"}


def test_filters_keep_whole_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (9, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.accepted(odd_docs, labels).schema.names == odd_docs.columns and quality.accepted(no_docs, labels).count() == 0
    kept = langid.accepted(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2, 3})


def test_language_sample_is_shared_equally(spark):
    rows = [(100 * n + i, f"text {n} {i} " * 3, f"l{n:02}") for n in range(12) for i in range(100)]
    rows += [(5000 + i, "rare words here", "rare") for i in range(4)] + [(6000 + i, "long " * 500, "long") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    for text, lang in langid.draw_sample(docs, per_language=20, max_chars=14 * 800):
        seen.setdefault(lang, []).append(text)
    assert len(seen) == 14 and all(len(seen[f"l{n:02}"]) == 20 for n in range(12))
    assert all(sum(map(len, texts)) <= 800 for texts in seen.values()) and sum(map(len, seen["long"])) >= 112


def test_letters_are_letters_alone():
    assert common.letter_runs("a1b½cⅧd_e²f") == list("abcdef") and common.letter_runs("½²①Ⅷ١٢") == [] and common.letter_runs("naïve中文") == ["naïve中文"]


def test_an_id_repeated_very_often_is_one_row(spark):
    """Its texts, of two kinds, count once in the sample, and no task gets them all."""
    hot = spark.range(100_000).selectExpr("cast(7 as long) as doc_id", "concat('text ', id % 2) as text", "'en' as lang")
    docs = hot.unionByName(spark.range(20).selectExpr("100 + id as doc_id", "concat('other ', id) as text", "'en' as lang"))
    labels = docs.select("doc_id", (common.F.col("doc_id") % 2).cast("int").alias("toxic"))
    sample = common.labelled_sample(docs, labels, "toxic", 3, 1, 1000, 10**6)
    assert sum(t.startswith("text") for t, _ in sample) == 1 and len(sample) == len(set(sample)) > 10
    langs = langid.draw_sample(docs, 300, 10**6)
    assert sum(t.startswith("text") for t, _ in langs) == 1 and len(langs) == len(sample)


def test_many_languages_in_bounded_memory():
    import tracemalloc

    found = langid.pieces(langid.default_vocabulary())
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}".replace("word", "international") for i in range(6000)]
    few, many = np.full((found.n + 2, 4), 1e-4), np.full((found.n + 2, 200), 1e-4)
    for table in (few, many):
        table[found.n], table[found.n + 1] = langid.UNKNOWN, 0
    tracemalloc.start()
    out = langid.log_likelihoods(words, found, many)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most - out.nbytes < 200e6 and np.allclose(out[:, :4], langid.log_likelihoods(words, found, few))


def test_long_letter_runs_are_learned():
    langs, _ = langid.fit([("a" * 60, "one"), ("b" * 60, "two")], langid.default_vocabulary(), 1)
    assert langs == ["one", "two"]
