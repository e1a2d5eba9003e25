import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cumulo.llm import phrases
from cumulo.llm.common import read_table
from cumulo.llm.queries import op11_phrases
from tests.datadir import DATA


def brute(rows, least, top):
    """The collocations of (lang, text) rows, by listing every phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        plain = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + m])) for m in range(1, 5) for i in range(len(words) - m + 1))
    found = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and a >= least:
            score, k = min((2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            found[lang, words] = (score, a, f[lang, words[:k]], f[lang, words[k:]])
    covered = {(lang, words[i : i + m]): 0 for (lang, words) in found for m in range(2, len(words)) for i in range(len(words) - m + 1)}
    for (lang, words), (_, a, _, _) in found.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                covered[lang, words[i : i + m]] = max(covered[lang, words[i : i + m]], a)
    out = []
    for lang in n:
        held = sorted((-s, -a, " ".join(w).encode(), left, r) for (g, w), (s, a, left, r) in found.items() if g == lang and 100 * covered.get((g, w), 0) < 80 * a)
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(held[:top])]
    return sorted(out)


def mined(spark, rows, least, top=2000):
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string")
    return sorted(tuple(r) for r in phrases.mine(docs, least, top).collect())


ROWS = [
    ("en", "New York is big. New York is far, new york\tcity; San   Francisco too"), ("en", "new york city new york city new york"), ("fr", "a b a b a b a b a b"),
    (None, "a b c d e a b c d e a b c d e"), ("und", "a b c d e a b"), ("fr", None), ("fr", ""), ("fr", "...\n\r,,"), ("de", "eins"), ("en", "x\x00y \x01 x\x00y \x01 é É ß é É ß"),
    ("en", "a b c a b c a b c x a b c"), ("fr", "a b a b a b a b a b"),
]


def test_equals_counting_every_phrase(spark):
    assert mined(spark, ROWS, 2) == brute(ROWS, 2, 2000)
    assert mined(spark, ROWS, 3, 2) == brute(ROWS, 3, 2)


def test_shards_and_ranges_of_any_size_give_the_same(spark, monkeypatch):
    rows = [*ROWS * 3, ("en", "of the " * 400 + "of the sea " * 50), ("en", " ".join(f"w{i % 17} w{i % 5}" for i in range(900)))]
    whole = brute(rows, 3, 2000)
    monkeypatch.setattr(phrases, "RANGE_CHARS", 300)
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string").where("length(text) > 0")
    ends = phrases.placed_ranges(docs, 30, 8000)
    assert len(ends) > 10 and ends == sorted(ends, key=lambda e: (e[0].encode(), e[1]))
    assert mined(spark, rows, 3) == whole


@pytest.mark.parametrize("size", [1, 2, 3, 5, 50])
def test_shards_may_end_anywhere(size, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_TOKENS", size)
    words = phrases.tokens(b"a b c d. a b c d e, f a b c d e f a b ! a b c")
    counter, tries = phrases.Counter(), []
    for i in range(0, len(words), 2):
        tries.append(counter.add(words[i : i + 2]))
    tries.append(counter.shard(last=True))
    found = phrases.Trie.merged([phrases.Trie.unpacked(t.packed()) for t in tries if t is not None])
    alone = phrases.Counter()
    alone._add(words)
    whole = alone.shard(last=True)
    assert found.names == whole.names and (found.paths == whole.paths).all() and (found.counts == whole.counts).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc .", max_size=40), max_size=8), st.lists(st.lists(st.sampled_from([b"a", b"b", b"bb", b"c"]), min_size=1, max_size=4), max_size=4))
def test_cuts_lose_nothing(texts, ends):
    counter = phrases.Counter()
    for text in texts:
        counter._add([*phrases.tokens(text.encode()), b"."])
    trie = counter.shard(last=True)
    if trie is None:
        return
    ends = sorted({tuple([*e, *[b""] * (4 - len(e))]) for e in ends})
    parts = list(trie.cut(ends))
    as_words = lambda t: [tuple(t.names[w - 1] if w else b"" for w in p) for p in t.paths.tolist()]
    assert [p for _, part in parts for p in as_words(part)] == as_words(trie)
    for n, part in parts:
        assert all((n == 0 or ends[n - 1] <= p) and (n == len(ends) or p < ends[n]) for p in as_words(part))
    merged = phrases.Trie.merged([phrases.Trie.unpacked(part.packed()) for _, part in parts])
    assert merged.names == [n for i, n in enumerate(trie.names) if i + 1 in trie.paths] and (merged.counts == trie.counts).all()


def test_whole_table_and_odd_rows(spark, odd_docs, no_docs):
    docs = read_table(spark, DATA, "documents")
    assert sorted(tuple(r) for r in op11_phrases(spark, DATA).collect()) == brute([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()], 30, 2000)
    assert sorted(tuple(r) for r in phrases.mine(odd_docs, 2).collect()) == brute([(r["lang"], r["text"]) for r in odd_docs.select("lang", "text").collect()], 2, 2000)
    assert phrases.mine(no_docs).collect() == []


def test_long_texts_are_counted_whole(spark):
    text = "one two three " * 500_000
    ((lang, rank, phrase, a, left, r, n, _),) = mined(spark, [("en", text)], 30, 1)
    assert (lang, rank, n) == ("en", 1, 1_500_000) and a in (499_999, 500_000) and phrase in text and (left, r) == brute([("en", text)], 30, 1)[0][4:6]
