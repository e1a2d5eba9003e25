import hashlib
import random
import zlib

import pytest
from datadir import DATA
from cumulo.llm import ogg, warc


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 1 << 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for data in (b"", b"a", b"OggS" + bytes(range(256))):
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [192, 384, 1920, 1920 * 16, 1920 * 17 + 192, 192 * 1001])
def test_ogg_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = ogg.mux(payload)
    back, features = ogg.read(media)
    assert back == payload and features["streams"] == 2 and features["packets"] == -(-n // ogg.BLOCK)
    streams, _ = ogg.demux(media)
    for packets in streams.values():
        ends = [granule for _, granule in packets[1:]]
        assert ends == [sum(len(p) for p, _ in packets[1 : i + 2]) for i in range(len(ends))]


def test_packets_over_many_pages():
    writer = ogg.StreamWriter(7)
    packets = [b"x" * 255, b"", b"y" * 200_000, b"z" * 65_025]
    media = b"".join(p for i, x in enumerate(packets) for p in writer.pages(x, i, (ogg.FIRST if not i else 0) | (ogg.LAST if i == 3 else 0)))
    streams, pages = ogg.demux(media)
    assert [p for p, _ in streams[7]] == packets and pages > 6


def test_damage_is_found():
    media = bytearray(ogg.mux(bytes(range(192)) * 40))
    for at in (0, 5, 30, 60, 2000, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ogg.demux(bytes(bad))
    with pytest.raises(ValueError):
        ogg.demux(bytes(media[:-1]))


def test_media_column(spark, odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    rows = ogg.read_media(ogg.write_media(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64
    same = [tuple(r) for r in rows if r.doc_id in (0, 1)]
    assert same[0][1:] == same[1][1:]
    assert ogg.read_media(ogg.write_media(no_docs)).count() == 0


def test_features_from_the_texts_alone(spark, odd_docs):
    """What the feature says, worked out without any media file."""
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in ogg.read_media(ogg.write_media(odd_docs)).collect():
        raw = (texts[r.doc_id] or "").encode()
        samples = [b - 128 for b in raw + b" " * (-len(raw) % 192 if raw else 192)]
        blocks = [samples[i : i + 1920] for i in range(0, len(samples), 1920)]
        # Blocks go to two streams in turn; the longer one's samples give the time, a page holds packets of 255 lacing values.
        told = dict(kv.split("=") for kv in r.feature.split(";"))
        assert int(told["streams"]) == 2 and int(told["packets"]) == len(blocks) and int(told["longest_ms"]) == sum(map(len, blocks[::2])) * 1000 // 8000
        assert int(told["sum"]) == sum(samples) and int(told["energy"]) == sum(s * s for s in samples)
        assert int(told["turns"]) == sum(b < a for a, b in zip(samples, samples[1:], strict=False)) and int(told["pages"]) >= 2 + min(2, len(blocks))


def test_damaged_rows_can_be_kept(spark):
    media = ogg.write_media(spark.createDataFrame([(1, "fine"), (2, "bad")], "doc_id long, text string"))
    broken = media.selectExpr("doc_id", "n_bytes", "case when doc_id = 2 then substring(media, 1, 40) else media end as media")
    rows = {r.doc_id: r for r in ogg.read_media(broken, keep_damaged=True).collect()}
    assert rows[1].error is None and rows[1].payload_bytes == 192 and rows[2].error and rows[2].feature is None and rows[2].media_bytes == 40
    with pytest.raises(Exception):
        ogg.read_media(broken).collect()


def test_a_payload_that_very_many_pages_share(spark, monkeypatch):
    from cumulo.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 5)
    rows = [(i, "u", "" if i % 2 else f"<p>{i % 7}</p>", None) for i in range(60)]
    assert sorted(map(tuple, warc.round_trip(pages_of(spark, rows)).collect()), key=str) == brute(rows)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def brute(rows, least=0):
    last = {}
    for page, _, html, _ in rows:
        if page is not None and len((html or "").encode()) >= least:
            last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        owner = last.get(html or "")
        refers = owner if owner is not None and owner != page and len(raw) >= least else None
        out.append((page, len(raw), warc.base32_sha1(raw), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "<p>x</p>", "clash"), (2, None, "<p>x</p>", None), (3, "http://b/\r\nEvil: 1", "<p>y: é\r\n\r\nz</p>", ""), (4, "u", None, ""), (5, "u", "", ""), (None, "u", "<p>x</p>", ""), (None, "u", "only", ""), (7, "u", "w" * 300_000, ""), (7, "u", "w" * 300_000, ""), (6, "u", "w" * 300_000, "")]


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, least):
    rows = warc.round_trip(pages_of(spark, ROWS), least).collect()
    assert sorted(map(tuple, rows), key=str) == brute(ROWS, least)


def test_no_pages(spark):
    assert warc.round_trip(pages_of(spark, ROWS).where("false")).count() == 0


def test_archives_roll_over_and_share_a_dictionary(spark, tmp_path, monkeypatch):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").coalesce(1)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    listed = warc.write_archives(warc.plan_revisits(pages), f"file://{tmp_path}/w")
    files = listed.collect()
    assert len(files) > 1 and sum(r.records for r in files) == pages.count()
    stored = open(files[0].path.removeprefix("file://"), "rb").read()
    assert int.from_bytes(stored[:4], "little") == warc.SKIPPABLE and len(list(warc.frames(stored))) == files[0].records
    with pytest.raises(ValueError):
        list(warc.frames(stored[:-3]))
