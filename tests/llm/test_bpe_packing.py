import hashlib
import random
import zlib

import numpy as np
import pytest
from datadir import DATA
from cumulo.llm import bpe, packing
from tokenizers import Tokenizer

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_alphabet_and_codec(library):
    assert sorted(bpe.byte_alphabet().values()) == list(range(256))
    coder = bpe.codec(PATH)
    assert ids_of(coder.encode("Hello world")) == library.encode("Hello world", add_special_tokens=False).ids


def test_random_texts_with_joins(library):
    rng = random.Random(5)
    parts = [*"ab c  d\n\t'srelvm.,!?1234éßœ 日🙂\x1c", "<|endoftext|>", " the", " don't", "   "]
    chunks = bpe.ChunkEncoder(PATH)
    for _ in range(250):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([3, 300, 1500])))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(chunks.encode(text)) == want
        assert chunks.codec.decode(np.array(want, np.int64)).decode() == library.decode(want, skip_special_tokens=False)
    assert chunks.repaired


def test_chunks_are_shared_and_cuts_follow_content():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(3000))
    chunks = bpe.ChunkEncoder(PATH)
    chunks.encode("first " + passage)
    before = chunks.encoded
    chunks.encode("another beginning of other length " + passage)
    assert chunks.encoded - before < 4 and chunks.reused > 5
    assert bpe.cut_points(passage)[-1] == len(passage) and max(np.diff([0, *bpe.cut_points("x" * 30000)])) <= bpe.MOST


def test_chunk_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 5000)
    chunks = bpe.ChunkEncoder(PATH)
    for i in range(50):
        chunks.encode(f"{i} text " * 100)
    assert chunks.held <= 5000


@pytest.mark.parametrize("gather", [True, False])
def test_digests(spark, odd_docs, no_docs, library, gather):
    rows = bpe.digest_documents(odd_docs, gather=gather).collect()
    texts = {(r.doc_id): r.text for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        raw = np.array(want, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest_documents(no_docs, gather=gather).count() == 0


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encode_documents(docs).collect():
        assert ids_of(bytes(r.ids)) == library.encode(texts[r.doc_id], add_special_tokens=False).ids and bytes(r.decoded).decode() == texts[r.doc_id]


def test_piece_lengths():
    for n in [*range(0, 70), 2047, 2048, 2049, 10_000]:
        lengths = packing.piece_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths) and lengths == sorted(lengths, reverse=True)


def test_packing(spark, odd_docs, no_docs, library):
    rows = packing.pack(odd_docs, with_ids=True).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and all(r.offset == 0 and r.sequence_id % 16 == r.bucket for r in rows)
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    copies = {4: 3}
    for doc_id, text in texts.items():
        want = [*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        assert sum(r.length for r in own) == len(want) * copies.get(doc_id, 1)
        for r in own:
            piece = np.array(want[r.start : r.start + r.length], "<u4").tobytes()
            assert bytes(r.ids) == piece and r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(want)
    assert packing.pack(no_docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_docs, context=1000)


def runs(rng):
    """A text of long runs of one class, words, contractions, special tokens and letters of other scripts."""
    out = []
    for _ in range(rng.randrange(1, 8)):
        n = rng.randrange(1, 400)
        some = lambda chars, n=n: "".join(rng.choice(chars) for _ in range(n))
        out.append(rng.choice([
            rng.choice(" \n\t　\xa0") * n, some(" \n\t\r"), some("abcdefghetaoinsr"), rng.choice(["ha", "abc", "the", "x", "aab", "中", "中文", "はは"]) * n,
            "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n)), some("0123456789"), some("=-.<>|!?*_"), "<|endoftext|>", "don't we'll it's 're",
            rng.choice(["'s", "'ll", "'", "<|endof", "text|>", " ", "é", "²", "́", "½"]), " ".join(some("abcdefgh", 5) for _ in range(n // 4)),
        ]))
    return "".join(out)


@pytest.mark.parametrize("sizes", [(50, 100, 40), (300, 160, 60)])
def test_runs_in_blocks(library, sizes):
    rng, coder, chunks = random.Random(sizes[0]), bpe.Codec(PATH, *sizes), bpe.ChunkEncoder(PATH)
    joined = 0
    for _ in range(200):
        text = runs(rng)
        want = library.encode(text, add_special_tokens=False).ids
        joined += bool(coder.long.search(text)) and coder._by_runs(text) is not None
        assert ids_of(coder.encode(text)) == want
        text *= rng.randrange(1, 12)
        assert ids_of(chunks.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert joined > 100


LONG = {"spaces": " ", "newlines": "\n", "tabs": "\t", "letters": "ha", "ideographs": "中文字", "sentences": "中文字。", "digits": "12345"}


@pytest.mark.parametrize("kind", LONG)
def test_long_runs_are_exact(library, kind):
    words = " ".join(f"word{i}" for i in range(5000))
    for text in (words + " " + LONG[kind] * 300_000 + "x " + words, LONG[kind] * 200_000):
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = bpe.ChunkEncoder(PATH)
        assert chunks.encode(text) == want and chunks.codec.encode(text) == want and chunks.codec.decode(np.frombuffer(want, "<u4")).decode() == text


def test_time_follows_length():
    import time

    took = {}
    for n in (10**6, 10**7):
        began = time.process_time()
        for run in (" ", "x", "中"):
            assert len(bpe.ChunkEncoder(PATH).encode(run * n)) and len(bpe.codec(PATH).encode(run * n))
        took[n] = time.process_time() - began
    assert took[10**7] < 30 * took[10**6] + 1


def test_long_runs_in_tables(spark, library):
    words = " ".join(f"word{i}" for i in range(5000))
    texts = [run * n for run in (" ", "\n", "a", "中") for n in (1_000_000,)] + [words]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.digest_documents(docs).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    packed = packing.pack(docs).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
