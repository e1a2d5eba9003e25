"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the last characters meets a condition, so equal passages of
different documents are cut alike, whatever stands before them. Each distinct chunk is encoded once
and kept; where two chunks meet, the text around the join is encoded again from a place in the left
chunk to a place in the right one whose ids agree with those of the chunks.

Why agreement at such a place is exact: the vocabulary's pre-tokenizer looks one character ahead, and
that only from white space. It always ends a token before white space that follows something else,
and between letters and punctuation. Ids up to such a place and from it on do not depend on each other. A token of very many characters - a run of spaces, or of
letters without breaks - has no such place. There, two sequences of ids join exactly if the two ids
that meet are what their joint bytes are encoded as; a join is encoded again, ever further out, until
both of its ends are.
"""

from __future__ import annotations

import array
import functools
import hashlib
import json
import re
from collections import OrderedDict

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Rolling hash: window in characters, and mean, least and largest length of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 1024, 256, 8192
#: Bytes of chunks and their ids that a worker keeps.
CHUNK_BYTES = 64_000_000

#: Characters that Codec.encode() hands to a library at once, about; least length of a run of one class that is
#: encoded in blocks, and a block's length.
PART, RUN, BLOCK = 65_536, 16_384, 4096
#: Characters beyond a run's end in which its token's end is looked for.
ENDS = 4096
#: Ids that are decoded at once.
DECODE = 1_000_000

# Characters that are white space, letters and signs in every edition of Unicode that matters here. They
# need not be all: fewer give fewer places.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
SIGNS = r"!-/:-@\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
#: A place between two characters where the pre-tokenizer ends a token, whatever stands farther off.
_PLACE = re.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[{LETTERS}])(?=[{SIGNS}])")


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the tokenizers library does with the vocabulary file at `path`."""

    def __init__(self, path: str, part: int = PART, run: int = RUN, block: int = BLOCK):
        import tiktoken

        self.part, self.run, self.block = part, run, block
        self.long = re.compile("|".join(f"[{c}]{{{run},}}" for c in (WHITE, LETTERS, "0-9", SIGNS)))
        self.apart: dict[tuple[int, int], bool] = {}
        spec = json.loads(open(path, encoding="utf-8").read())
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.path, self.special = path, special
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        by_id = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        self.tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, in time and memory that follow its length.

        Long texts go to a library in parts that end at independent places; where a run of one class of
        characters has none, in blocks of the run.
        """
        if len(text) < self.run:
            return self._whole(text)
        out, start = [], 0
        while start < len(text):
            end = self.place(text, start + self.part)
            part = text[start:end]
            ids = self._by_runs(part) if self.long.search(part) else self._whole(part)
            out.append(self._by_library(part) if ids is None else ids)
            start = end
        return b"".join(out)

    def place(self, text: str, at: int, end: int | None = None) -> int:
        """The first independent place of a text from `at` on and before `end`, else `end`. None is inside a special token."""
        end = len(text) if end is None else end
        while found := _PLACE.search(text, at, end):
            at = found.start()
            if all(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) < 0 for s in self.special):
                return at
            at += 1
        return end

    def last_place(self, text: str, least: int, end: int) -> int:
        """The last independent place of a text from `least` on and before `end`, else `least`."""
        reach = 64
        while True:
            begin, last = max(least, end - reach), least
            at = self.place(text, begin, end)
            while at < end:
                last, at = at, self.place(text, at + 1, end)
            if last > least or begin == least:
                return last
            reach *= 4

    def _whole(self, text: str) -> bytes:
        """Within Latin-1 by the faster of two libraries that give the same ids from the same vocabulary."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._by_library(text)
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def _by_library(self, text: str) -> bytes:
        return array.array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()

    def _by_runs(self, text: str) -> bytes | None:
        """_whole() of a text with long runs, each of which lies in one token but for a few characters at its ends.

        None if a join would change ids too far to the left, or a token's end isn't found near its run's.
        """
        ids, at = array.array("I"), 0
        for run in self.long.finditer(text):
            first, last = run.start() + self.block, run.end() - self.block
            if first < at:
                continue
            ids.frombytes(self._whole(text[at:first]))
            # The token's end is looked for up to the next special token, or in ENDS characters beyond the run.
            stop = min([run.end() + ENDS, len(text), *(i for s in self.special if (i := text.find(s, last, run.end() + ENDS)) >= 0)])
            size = self.slow.pre_tokenizer.pre_tokenize_str(text[last:stop])[0][1][1]
            if last + size > run.end() + ENDS - 64 and stop < len(text):
                return None
            at = last + size
            for begin in [*range(first, last, self.block), last]:
                block = text[begin : at if begin == last else min(begin + self.block, last)]
                if not self._join(ids, self._piece(block.encode())):
                    return None
        ids.frombytes(self._whole(text[at:]))
        return ids.tobytes()

    def _piece(self, raw: bytes) -> list[int]:
        """Ids of bytes that are one token of the pre-tokenizer, or a stretch of one."""
        return self.fast._core_bpe.encode_single_piece(raw)

    def _meet(self, left: int, right: int) -> bool:
        """Whether two ids are what their bytes are encoded as. Ids all of whose neighbours are so are those of their joint bytes."""
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            known = self.apart[left, right] = self._piece(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def _join(self, ids: array.array, right: list[int]) -> bool:
        """Adds `right`, the ids of what follows in the same token. False if more than half a block's bytes before would change."""
        back = on = 0
        while True:
            before, after = ids[len(ids) - back :] if back else (), right[:on]
            raw = b"".join([*(self.tokens[i] for i in before), *(self.tokens[i] for i in after)])
            seam = self._piece(raw) if raw else []
            left_meets = self._meet(ids[len(ids) - back - 1], (seam or right)[0])
            right_meets = on == len(right) or not seam or self._meet(seam[-1], right[on])
            if left_meets and right_meets:
                if back:
                    del ids[len(ids) - back :]
                ids.extend(seam)
                ids.extend(right[on:])
                return True
            back, on = back if seam and left_meets else max(1, 4 * back), on if seam and right_meets else min(len(right), max(1, 4 * on))
            if back >= len(ids) or sum(len(self.tokens[i]) for i in ids[len(ids) - back :]) > self.block // 2:
                return False

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no text become U+FFFD."""
        raw = bytearray()
        for start in range(0, len(ids), DECODE):
            these = ids[start : start + DECODE]
            lengths = self.lengths[these]
            ends = np.cumsum(lengths)
            raw += self.flat[np.repeat(self.starts[these] - ends + lengths, lengths) + np.arange(int(ends[-1]))].tobytes()
        return raw.decode("utf-8", errors="replace").encode()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def cut_points(text: str, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text, by a rolling hash of its last WINDOW characters."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(0x9E3779B1)
    base, span = 0x01000193, 1
    while span < WINDOW:
        older = np.zeros_like(h)
        older[span:] = h[:-span]
        h = h + older * np.uint32(base)
        base, span = (base * base) & 0xFFFFFFFF, span * 2
    marks = np.flatnonzero((h >> np.uint32(7)) % np.uint32(mean) == 0) + 1
    ends, last = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - last > most:
            last += most
            ends.append(last)
        if mark - last >= least and mark < n:
            ends.append(mark)
            last = mark
    return [*ends, n] if last < n else ends


class ChunkEncoder:
    """Encodes texts from ids of chunks that it keeps, up to CHUNK_BYTES."""

    def __init__(self, path: str):
        self.codec = codec(path)
        self.kept: OrderedDict[str, bytes] = OrderedDict()
        self.held = 0
        self.encoded = self.reused = self.repaired = 0

    def chunk(self, text: str) -> bytes:
        found = self.kept.get(text)
        if found is not None:
            self.reused += 1
            return found
        self.encoded += 1
        ids = self.codec.encode(text)
        self.kept[text] = ids
        self.held += len(ids) + len(text)
        while self.held > CHUNK_BYTES:
            old, its = self.kept.popitem(last=False)
            self.held -= len(its) + len(old)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text from those of its chunks.

        What lies between a chunk's first place and its last one is the chunk's own; the stretch from there
        to the next chunk's first place, which may span chunks without places, is encoded again.
        """
        ends = cut_points(text)
        if len(ends) < 2:
            return self.chunk(text) if text else b""
        out, at, place = [], 0, -1
        open_at, open_ids = 0, b""  # where the open stretch starts, and its ids while it lies in one chunk
        for end in ends:
            head, at_chunk, at = 0, at, end
            if at_chunk:
                if place <= at_chunk:
                    place = self.codec.place(text, at_chunk + 1)
                if place >= end:
                    open_ids = None
                    continue
                head = place
            ids = self.chunk(text[at_chunk:end])
            if at_chunk:
                opening = self.codec.encode(text[at_chunk:head])
                if not ids.startswith(opening):
                    open_ids = None
                    continue
                self.repaired += 1
                out.append(self.codec.encode(text[open_at:head]))
                ids = ids[len(opening) :]
            last = self.codec.last_place(text, max(head, 1), end)
            tail = self.codec.encode(text[last:end])
            if last > head and ids.endswith(tail):
                out.append(ids[: len(ids) - len(tail)])
                open_at, open_ids = last, tail
            else:
                open_at, open_ids = head, ids
        out.append(self.codec.encode(text[open_at:]) if open_ids is None else open_ids)
        return b"".join(out)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder, kept over tasks."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def colocate(docs: DataFrame) -> DataFrame:
    """Bring documents that share lines to the same tasks, so that their chunks are encoded once.

    The key is the least hash of a text's lines, which copies share and near copies mostly do. The
    rebalancing exchange splits a key that holds many rows, so a common line makes no large task.
    """
    key = F.array_min(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.xxhash64(line)))
    return docs.withColumn("_near", key).hint("rebalance", F.col("_near")).drop("_near")


def encode_documents(docs: DataFrame, path: str | None = None, gather: bool = True) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary UTF-8) for each row of docs.

    A null text is an empty one; a null id stays; repeated rows give repeated rows; other columns,
    whatever their names, are not read. gather: see colocate().
    """
    path = path or default_vocabulary()
    docs = docs.select("doc_id", "text")

    def make():
        chunks = encoder(path)

        def step(cols):
            ids = [chunks.encode(t or "") for t in cols[1]]
            return cols[0], ids, [chunks.codec.decode(np.frombuffer(i, "<u4")) for i in ids]

        return step

    return map_rows(colocate(docs) if gather else docs, ["doc_id", "text"], "doc_id long, ids binary, decoded binary", make)


def digest_documents(docs: DataFrame, path: str | None = None, gather: bool = True) -> DataFrame:
    """The digests of encode_documents(): doc_id, n_tokens, ids_sha256, decoded_sha256, of each row of docs.

    Encoded and decoded in the same task, so that neither ids nor decoded texts leave it.
    """
    path = path or default_vocabulary()
    docs = docs.select("doc_id", "text")

    def make():
        chunks = encoder(path)

        def step(cols):
            n, first, second = [], [], []
            for text in cols[1]:
                ids = chunks.encode(text or "")
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(chunks.codec.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            return cols[0], n, first, second

        return step

    return map_rows(colocate(docs) if gather else docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
