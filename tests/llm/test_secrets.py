import hashlib
import re

import duckdb
import pytest
from cumulo.llm import secret_scan as S

ASSIGN = re.compile(S.ASSIGN.replace("(?i:", "(?ai:"))
BASE = {"assign": (ASSIGN, 2, 8), "access": (re.compile(S.ACCESS), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32)}


def base_spans(text):
    out = []
    for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [s for _, _, s in sorted(out)]


TEXTS = [
    "🙂é password = 'abcdefgh' and Token:xyz", "secret=token: abcdefghijkl", "api_key=\"AAAABBBBCCCC\" API-KEY", "AKIA1234567890AB AKIAshort AKIA1",
    "0123456789abcdef0123456789abcdef0 and 0123456789abcdef", "token=token=abcdefgh12345678 passwd::=.._-", "user=bob password=pw12 https://h.example.org", "https://h.example.org alone, mail bob@example.com",
    "password=" + "a" * 5000, "token=abc " * 400, "x" * 50_000, "a@" * 2000, "a@b" + ".c" * 50_000, "user=" * 30_000, "AKIA1234567890AB" + " " * 500 + "password=pw12",
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_base_spans(spark, odd_docs):
    for docs in (docs_of(spark, TEXTS), odd_docs):
        texts = {r.doc_id: r.text for r in docs.collect()}
        rows = S.scan(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = base_spans(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for s in want) for k in BASE]
            assert set(want) <= set(filter(None, r.spans.split(",")))


def test_weak_parts_need_complements(spark):
    linked = {r.doc_id: r.linked for r in S.scan(docs_of(spark, TEXTS)).collect()}
    assert linked[6] == "user:0:8,short:9:22,endpoint:23:44"
    assert linked[7] == "" and linked[14] == ""
    assert linked[0] == ""


def test_sql_agrees(spark, odd_docs):
    docs = docs_of(spark, TEXTS).unionByName(odd_docs.select("doc_id", "text"))
    documents = docs.toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    key = lambda t: tuple((x is None, x) for x in t)
    want = con.sql(S.oracle_sql()).fetchall()
    got = [tuple(r) for r in S.scan(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_redaction(spark, odd_docs, no_docs):
    rows = {r.doc_id: r.text for r in S.redact(docs_of(spark, TEXTS)).collect()}
    assert rows[0] == "🙂é [assign]' and Token:xyz" and rows[7] == TEXTS[7] and rows[3] == "[access] AKIAshort AKIA1" and len(rows) == len(TEXTS)
    for text in rows.values():
        assert not base_spans(text)
    odd = S.redact(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count()
    whole, was = ({r.doc_id: r for r in d.collect()} for d in (odd, odd_docs))
    for i, r in whole.items():
        assert {c: v for c, v in r.asDict().items() if c not in ("text", "n_chars")} == {c: v for c, v in was[i].asDict().items() if c not in ("text", "n_chars")}
    assert whole[0].text is None and whole[11].n_chars == len(whole[11].text) and "AKIA" not in whole[11].text
    assert S.redact(no_docs).count() == 0 and S.scan(no_docs).count() == 0


@pytest.mark.parametrize("make", [S.scan, S.redact])
def test_no_python_in_the_plan(spark, make):
    plan = make(docs_of(spark, TEXTS[:3]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_copies_are_looked_at_once(spark, monkeypatch):
    from cumulo.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 4)
    text = "user=bob password=pw12"
    docs = spark.createDataFrame([(None if i % 2 else i, text) for i in range(20)] + [(100, "token=abcdefgh1"), (101, text + ".")], "doc_id long, text string")
    rows = S.scan(docs).collect()
    assert len(rows) == 22 and sum(r.spans == "user:0:8,short:9:22" for r in rows) == 20
    assert sorted(r.text for r in S.redact(docs).collect()) == sorted(["[user] [short]"] * 21 + ["[assign]"])


def test_redaction_links_by_gaps(spark):
    long, far = "token=" + "x" * 600, "\n" + " " * 201
    texts = [long + "\nclient_id=abc https://h.example.org/", "user=" + "u" * 300 + " secret=pw12", long + far + "client_id=abc", "client_id=abc" + far + long, "client_id=abc" + far[:200] + long]
    rows = {r.doc_id: r.text for r in S.redact(docs_of(spark, texts)).collect()}
    assert rows[0] == "[assign]\n[user] [endpoint]/" and rows[1] == "[user] [short]"
    spans = {r.doc_id: r.spans for r in S.scan(docs_of(spark, texts)).collect()}
    assert spans[0] == "assign:0:606,user:607:620,endpoint:621:642" and spans[1] == "user:0:305,short:306:317" and spans[2] == "assign:0:606"
    assert rows[2] == "[assign]" + far + "client_id=abc" and rows[3] == "client_id=abc" + far + "[assign]" and rows[4] == "[user]" + far[:200] + "[assign]"
