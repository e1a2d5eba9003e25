import re
import zlib

import __spark_entry__
import corpus_pipeline
import numpy as np
import pytest
from cumulo.llm import bpe, langid, packing, quality
from cumulo.llm import secret_scan as S
from datadir import DATA
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))


def near_copies_out(docs):
    """Of texts by id those left when each group linked from 80 percent on keeps its least id, by comparing all pairs."""
    sets = {}
    for i, text in docs.items():
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return {i: docs[i] for i in docs if label[i] == i}


def redacted(text):
    """The text with its findings replaced, by Python's regular expressions and a comparison of all parts."""
    parts = []
    for family, (pattern, group) in S.FAMILIES.items():
        for m in re.finditer(pattern.replace("(?i:", "(?ai:"), text):
            n = len(m.group(group))
            kind = {"assign": "assign" if n >= 8 else "short" if n >= 4 else None, "access": "access" if n >= 16 else None, "hex": "hex" if n >= 32 else "digest", "user": "user", "endpoint": "endpoint"}[family]
            if kind:
                parts.append((m.start(), S.KINDS.index(kind), m.end(), kind))
    beside = lambda p, kinds: any(o[3] in kinds and o[0] <= p[2] + 200 and o[2] >= p[0] - 200 for o in parts)
    secret, identifier = ("assign", "hex", "short", "digest"), ("access", "user")
    needs = {"short": [identifier], "digest": [identifier], "user": [secret], "endpoint": [secret, identifier]}
    out, at = "", 0
    for start, _, end, kind in sorted(p for p in parts if all(beside(p, kinds) for kinds in needs.get(p[3], []))):
        if start >= at:
            out, at = out + text[at:start] + f"[{kind}]", end
        at = max(at, end)
    return out + text[at:]


def test_pipeline_against_plain_python(spark):
    """The two classifiers' verdicts come from their queries; everything after is worked out without Spark."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r.predicted}
    docs = docs.where(docs.doc_id.isin(list(good)))
    told = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= langid.LEAST_SCORE}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in told}
    left = near_copies_out(texts)
    assert 20 < len(left) < len(texts)
    library, want = Tokenizer.from_file(bpe.default_vocabulary()), {}
    for i, text in left.items():
        ids = np.array([*library.encode(redacted(text), add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        while at < len(ids):
            n = min(2048, 1 << (len(ids) - at).bit_length() - 1)
            want[i, at] = (n, zlib.crc32(ids[at : at + n].tobytes()), len(ids))
            at += n
    got = {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want and any(redacted(t) != t for t in left.values())


def test_stages_keep_columns_and_odd_rows(spark, odd_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "MinHash near-dedup", "secret scans", "packing"]
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, DATA).columns == docs.columns, name
        assert "sequence_id" in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).columns


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, DATA).collect()
        docs = spark.createDataFrame(rows, docs.schema).repartition(2)
    own = {(r.doc_id, r.start): r.ids_crc32 for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()}
    whole = {(r.doc_id, r.start): r.ids_crc32 for r in corpus_pipeline.run(spark, DATA).collect()}
    assert own == whole and len({d for d, _ in own}) > 100


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_a_query(n):
    assert sum(name.startswith(f"op{n}_") for name in __spark_entry__.queries()) == 1


def test_near_duplicates_from_80_percent_go(spark):
    words = [f"w{j}" for j in range(100)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:91] + list("abcdefghi")))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, DATA).collect()] == [0]
