"""WARC archives whose records are Zstandard frames under one dictionary an archive.

Each task writes archives of its own: a dictionary built from their first records stands in a leading
skippable frame, and every record is a frame by itself, so that a reader can start at any of them. A
payload that several pages share is stored once; the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import checkpointed, opened, shared_dir
from .common import join_hot

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 0
#: Bytes of payload of an archive, bytes of records that its dictionary is built from, and the dictionary's size.
ARCHIVE_BYTES, TRAIN_BYTES, DICT_BYTES = 64_000_000, 512_000, 16_384
LEVEL = 3
#: Tasks that read archives at most; beyond that many archives, a task reads several in turn.
MOST_TASKS = 100_000
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the format: the skippable frame that holds a dictionary.
SKIPPABLE = 0x184D2A5D


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, refers_to for each row of pages.

    Of pages with equal payloads of at least `least` bytes, that with the largest page_id is stored,
    and the others refer to it. Rows that repeat the largest page_id are all stored; a null page_id
    is smaller than any other, and where all are null each is stored. A null html is an empty payload.
    Only digests that repeat are joined back, and pages of a payload that very many share aren't moved for it.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("_sha1", F.sha1("payload"))
    shared = rows.where(F.length("payload") >= least).groupBy("_sha1").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    shared = shared.where((F.col("_n") > 1) & F.col("_last").isNotNull()).select("_sha1", "_last", "_n")
    refers = F.when(F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return join_hot(rows, shared, "_sha1", "_n", pages.count(), "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(fields).encode() + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]):
    """A dictionary trained on the records; their plain bytes where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICT_BYTES, records, k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICT_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """The pieces of an archive: the frame with the dictionary, then a frame for each record."""
    import zstandard

    first, held = [], 0
    for record in records:
        first.append(record)
        held += len(record)
        if held >= TRAIN_BYTES:
            break
    words = _dictionary(first)
    raw = words.as_bytes()
    yield struct.pack("<II", SKIPPABLE, len(raw)) + raw
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
    for record in first:
        yield press.compress(record)
    for record in records:
        yield press.compress(record)


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of plan_revisits() to archives in `folder`, a URI all executors see; path, records, bytes of each.

    A task that runs again writes files of its own, and only those of the attempt that counted are listed.
    """
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        task = TaskContext.get()
        fs, root = opened(folder)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, pending = [], next(rows, None)
        while pending is not None:
            name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(out):04d}.warc.zst"
            counts = [0, 0]

            def some(counts=counts):
                nonlocal pending
                size = 0
                while pending is not None and size < ARCHIVE_BYTES:
                    row, pending = pending, next(rows, None)
                    size += len(row[2])
                    counts[0] += 1
                    yield _record(*row)

            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None) as to:
                for piece in archive(some()):
                    to.write(piece)
                    counts[1] += len(piece)
            out.append((name, *counts))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return checkpointed(planned.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long, bytes long"))


def frames(stored: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed by itself under the archive's dictionary."""
    import zstandard

    magic, size = struct.unpack_from("<II", stored)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary in front")
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored[8 : 8 + size]))
    view, at = memoryview(stored), 8 + size
    while at < len(view):
        one, out = press.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("a record is cut off")
            piece = view[at : at + 4096]
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(out)


def parse(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload digest, type and page referred to. A stored payload must meet its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError("a payload does not meet its digest")
    page = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
    return page("WARC-Record-ID"), length, digest, kind, page("WARC-Refers-To")


def read_archives(listed: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the archives listed."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = opened(path)
                with fs.open_input_file(at) as file:
                    rows = [parse(record) for record in frames(file.read())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    # The list is tiny, so a number is given: else the adaptive plan would have one task read all archives.
    tasks = min(max(1, listed.count()), MOST_TASKS)
    return listed.repartition(tasks).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Archives the pages under the shared checkpoint folder and reads the archives back."""
    return read_archives(write_archives(plan_revisits(pages, least), shared_dir(pages.sparkSession, "warc")))


def oracle_sql() -> str:
    """round_trip()'s rows from `pages`, in DuckDB's SQL."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    base32 = f"array_to_string(list_transform(range(32), lambda i: '{letters}'[1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)]), '')"
    return f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
    m AS (SELECT *, max(CASE WHEN n >= {LEAST_REVISIT} THEN page_id END) OVER (PARTITION BY h) AS last FROM d),
    r AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM m)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {base32} AS payload_digest,
        CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""
