"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded.

A document's tokens are cut into pieces whose lengths are powers of two: as many of the full
context as fit, then the binary digits of the rest, from high to low. Each piece is a sequence of
its own, and sequences of one length form a bucket, so a batch drawn from a bucket is rectangular.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, default_vocabulary
from .common import map_rows

CONTEXT = 2048
#: Ends each document.
END_ID = 1


def piece_lengths(n: int, context: int = CONTEXT) -> list[int]:
    """Powers of two that sum to n, none over context, from large to small."""
    rest = n % context
    return [context] * (n // context) + [1 << b for b in range(context.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str | None = None, context: int = CONTEXT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    Each piece is its own sequence, so offset is 0 and `length` that of the sequence. bucket is the
    power, log2(length); sequence_id is unique and holds it in its last four bits. with_ids adds
    the ids (binary). A null text is an empty one, whose one token is end_id; a null id stays;
    repeated rows are packed each; columns besides doc_id and text are not read. No rows move
    between tasks: each document is cut where it is read.
    """
    if context < 1 or context & (context - 1) or context > 1 << 15:
        raise ValueError("context must be a power of two, 32768 at most")
    path = path or default_vocabulary()

    def make():
        tokens, end = codec(path), end_id.to_bytes(4, "little")

        def step(cols):
            out = [[] for _ in range(7)]
            for doc_id, text in zip(*cols, strict=True):
                ids = tokens.encode(text or "") + end
                view, at, n = memoryview(ids), 0, len(ids) // 4
                for length in piece_lengths(n, context):
                    piece = view[4 * at : 4 * (at + length)]
                    row = (doc_id, at, length, zlib.crc32(piece), n, length.bit_length() - 1, bytes(piece) if with_ids else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    at += length
            return out

        return step

    pieces = map_rows(docs, ["doc_id", "text"], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, ids binary", make)
    # Pieces keep the order of the files read, so a task that runs again gives them the same numbers.
    out = pieces.withColumn("sequence_id", F.monotonically_increasing_id() * 16 + F.col("bucket")).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
    return out.select(*columns, *(["ids"] if with_ids else []))
