"""Media columns as Ogg: texts as 8-bit samples in two multiplexed logical streams, and back.

Writing deals blocks of samples to the streams in turn, laces them into packets and packets into
pages with checksums and granule positions. Reading verifies every page's checksum and sequence
number, reassembles packets from the lacing values across pages, separates the streams by serial
number, and derives each packet's time from the granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

#: Bytes that a payload is padded to a multiple of, and samples of a packet.
UNIT, BLOCK = 192, 1920
RATE = 8000
#: Fixed values of the format: capture pattern and header flags.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
#: This codec's identification packet: magic, rate, block, stream's number, number of streams, samples of the stream.
_CODEC = struct.Struct("<8sIIHHq")
MAGIC = b"PCM8mux\0"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC-32, which shifts left and starts at 0: zlib's of mirrored bytes, mirrored."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def lacing(size: int) -> bytes:
    """A packet's lacing values: 255 for each whole 255 bytes, then the rest, which may be 0."""
    return b"\xff" * (size // 255) + bytes([size % 255])


class StreamWriter:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence, self.granule = serial, 0, 0
        self.laces, self.body, self.open = b"", b"", False

    def page(self, laces: bytes, body: bytes, granule: int, flags: int) -> bytes:
        head = _HEADER.pack(CAPTURE, 0, flags, granule, self.serial, self.sequence, 0, len(laces)) + laces
        self.sequence += 1
        whole = head + body
        return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]

    def pages(self, packet: bytes, granule: int, flags: int = 0) -> list[bytes]:
        """The packet in pages of its own: 255 lacing values a page; -1 stands for no packet that ends there."""
        laces, out, at = lacing(len(packet)), [], 0
        for start in range(0, len(laces), 255):
            part, ends = laces[start : start + 255], start + 255 >= len(laces)
            size = sum(part)
            keep = flags & FIRST if not start else CONTINUED
            out.append(self.page(part, packet[at : at + size], granule if ends else -1, keep | (flags & LAST if ends else 0)))
            at += size
        return out


def pad(raw: bytes) -> bytes:
    """raw with spaces up to a positive multiple of UNIT."""
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def mux(payload: bytes, streams: int = 2, block: int = BLOCK, packets_a_page: int = 8) -> bytes:
    """The payload as one Ogg file; a page holds up to packets_a_page blocks of its stream."""
    base = zlib.crc32(payload)
    writers = [StreamWriter((base + k) & 0xFFFFFFFF) for k in range(streams)]
    blocks = [[payload[at : at + block] for at in range(k * block, len(payload), streams * block)] for k in range(streams)]
    out = []
    for k, w in enumerate(writers):
        out += w.pages(_CODEC.pack(MAGIC, RATE, block, k, streams, sum(map(len, blocks[k]))), 0, FIRST | (0 if blocks[k] else LAST))
    for start in range(0, max(map(len, blocks)), packets_a_page):
        for w, own in zip(writers, blocks, strict=True):
            group = own[start : start + packets_a_page]
            if not group:
                continue
            laces = b"".join(map(lacing, map(len, group)))
            w.granule += sum(map(len, group))
            last = LAST if start + packets_a_page >= len(own) else 0
            if len(laces) <= 255:
                out.append(w.page(laces, b"".join(group), w.granule, last))
            else:
                raise ValueError("a page's packets need more than 255 lacing values")
    return b"".join(out)


def demux(media: bytes) -> tuple[dict[int, list[tuple[bytes, int]]], int]:
    """Packets of each logical stream as (bytes, granule position at the packet's end), and the number of pages.

    Raises ValueError on a wrong capture pattern, checksum, sequence number or continuation. A packet's
    own end is the page's granule position less the samples of the packets that end after it there.
    """
    streams: dict[int, list[tuple[bytes, int]]] = {}
    expected, partial, closed = {}, {}, set()
    at = pages = 0
    while at < len(media):
        if len(media) - at < _HEADER.size:
            raise ValueError("a page is cut off")
        capture, version, flags, granule, serial, sequence, crc, n = _HEADER.unpack_from(media, at)
        laces = media[at + 27 : at + 27 + n]
        body_at = at + 27 + n
        end = body_at + sum(laces)
        if capture != CAPTURE or version or len(laces) < n or end > len(media):
            raise ValueError("not a page")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError("a page's checksum is wrong")
        if bool(flags & FIRST) != (serial not in streams) or sequence != expected.get(serial, 0) or serial in closed:
            raise ValueError("a page is missing or out of turn")
        if bool(flags & CONTINUED) != (serial in partial):
            raise ValueError("a packet's continuation is missing")
        expected[serial] = sequence + 1
        whole = streams.setdefault(serial, [])
        held, ended = partial.pop(serial, b""), []
        for lace in laces:
            held += media[body_at : body_at + lace]
            body_at += lace
            if lace < 255:
                ended.append(held)
                held = b""
        if n and laces[-1] == 255:
            partial[serial] = held
        after = 0
        timed = []
        for packet in reversed(ended):
            timed.append((packet, granule - after))
            after += len(packet)
        whole += timed[::-1]
        if flags & LAST:
            closed.add(serial)
        at, pages = end, pages + 1
    if partial or closed != set(streams):
        raise ValueError("a stream has no end")
    return streams, pages


def read(media: bytes) -> tuple[bytes, dict[str, int]]:
    """The payload and features of a file that mux() wrote."""
    streams, pages = demux(media)
    parts, ends = {}, 0
    for packets in streams.values():
        magic, rate, _, number, of, samples = _CODEC.unpack(packets[0][0])
        if magic != MAGIC or of != len(streams) or (packets[-1][1] if len(packets) > 1 else 0) != samples:
            raise ValueError("not this codec, or samples are missing")
        parts[number] = [p for p, _ in packets[1:]]
        ends = max([ends, *(granule for _, granule in packets[1:])])
    turns = max(map(len, parts.values()), default=0)
    payload = b"".join(parts[k][i] for i in range(turns) for k in sorted(parts) if i < len(parts[k]))
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return payload, {
        "streams": len(streams), "pages": pages, "packets": sum(map(len, parts.values())), "longest_ms": ends * 1000 // rate,
        "sum": int(x.sum()), "energy": int((x * x).sum()), "turns": int(np.count_nonzero(np.diff(x) < 0)),
    }


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for each row of docs: the text in UTF-8, padded, as an Ogg file.

    A null text is an empty one, which is padding alone; a null id stays; repeated rows give repeated
    rows; columns besides doc_id and text are not read. Equal texts give equal files.
    """

    def make():
        def step(cols):
            raw = [(t or "").encode() for t in cols[1]]
            return cols[0], [len(r) for r in raw], [mux(pad(r)) for r in raw]

        return step

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_bytes long, media binary", make)


def read_media(media: DataFrame, keep_damaged: bool = False) -> DataFrame:
    """Digests and features of the payloads read back from rows of write_media().

    A damaged file raises an error; with keep_damaged, its row stays, with nulls and what is wrong in the column error.
    """

    def make():
        def step(cols):
            out = [cols[0], cols[1], *([] for _ in range(7 if keep_damaged else 6))]
            for stored in cols[2]:
                try:
                    payload, features = read(stored)
                except (ValueError, IndexError, struct.error) as wrong:
                    if not keep_damaged:
                        raise
                    for column, value in zip(out[2:], (None, None, None, len(stored), hashlib.sha256(stored).hexdigest(), None, str(wrong)), strict=True):
                        column.append(value)
                    continue
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), ";".join(f"{k}={v}" for k, v in features.items()), *([None] if keep_damaged else []))
                for column, value in zip(out[2:], row, strict=True):
                    column.append(value)
            return out

        return step

    return map_rows(media, ["doc_id", "n_bytes", "media"], "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", error string" if keep_damaged else ""), make)
