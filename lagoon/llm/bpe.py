"""Byte-level BPE of long and short texts by overlapping chunks; decoding by concatenation of raw bytes.

Pre-tokenisation is a left-to-right match, so a chunk that starts anywhere agrees with the whole text
from the first boundary that both have. Texts above CHUNK characters are cut into chunks that overlap by
OVERLAP characters; each is pre-tokenised and its pre-tokens are encoded on its own, in any task. To
stitch, the boundaries of a chunk that the chunk before it confirms are looked up in the overlap, and the
chunks are joined at the first common one. Matches that the end of a chunk may have cut are not used. If
an overlap holds no common boundary (a very long run of one kind), the text is matched again from the
last confirmed boundary, over twice as many chunks each time, until a boundary is common: however long the
run, it is matched again some two times its length, not once for each chunk.
Texts of one chunk need no stitching and no shuffle. Columns that are derived from ids and bytes (hashes, say) can be
made in the process that encoded them, so that these, several times the size of the text, need not go through the JVM
to a second Python worker.

Defined cases: null text is empty; an empty text has no tokens, and the hash of the empty string; the
rows of one doc_id are told apart, and repeated rows are encoded each; merges of equal rank go from the left,
as in the library; very long texts are encoded in chunks in any task, and one task holds a text's ids; only
the id and the text are read, so no other column can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import frugal, id_and_text, rows_out, slices

CHUNK = 1 << 15
OVERLAP = 1 << 10
KEPT_PIECES = 200_000
#: Ids that are written out as text at once.
HASHED = 1 << 16
IDS = "doc_id long, ids binary, raw binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec(dict):
    """Ids of pre-tokens as little-endian 32-bit bytes; bounded."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT_PIECES:
            self.clear()
        self[piece] = found = np.array(self.merge(piece), "<u4").tobytes()
        return found

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(start, text) of each chunk; the last one ends with the text."""
    return [(a, text[a : a + size + overlap]) for a in range(0, max(1, len(text)), size) if a == 0 or a < len(text)]


def cut(text: str, start: int, last: bool, c: Codec) -> tuple[np.ndarray, list[bytes]]:
    """A chunk's boundaries (starts of pre-tokens and one end, absolute) and the ids of each pre-token.

    A pre-token that touches the end of a chunk may go on, and so may the blanks before it: both are left out, unless the text ends there.
    """
    pieces = c.pieces(text)
    if not last:
        pieces = pieces[:-2]
    ends = np.cumsum([0, *map(len, pieces)]) + start
    return ends, list(map(c.__getitem__, pieces))


def stitch(parts: list[tuple[int, str, np.ndarray, list[bytes]]], c: Codec, overlap: int) -> bytes:
    """parts, in order: (start, text, boundaries, ids by pre-token) of each chunk. The ids of the whole text."""
    out: list[bytes] = []
    _, _, ends, ids = parts[0]
    at, k, last = 0, 1, len(parts) - 1  # confirmed up to ends[at] of the current chunk
    while k <= last:
        _, _, new_ends, new_ids = parts[k]
        common, i, j = np.intersect1d(ends[at:], new_ends, return_indices=True)
        if len(common):
            out += ids[at : at + i[0]]
            ends, ids, at, k = new_ends, new_ids, j[0], k + 1
            continue
        done = int(ends[at])
        first, reach = max(x for x in range(k) if parts[x][0] <= done), 1
        while True:
            to = min(last, k + reach - 1)
            whole = "".join(p[1][: parts[x + 1][0] - p[0]] if x < to else p[1] for x, p in enumerate(parts[: to + 1]) if x >= first)
            ends, ids = cut(whole[done - parts[first][0] :], done, to == last, c)
            at = 0
            if to == last or len(np.intersect1d(ends, parts[to][2])):
                break
            reach *= 2
        if to == last:
            break
        k = to  # which has a boundary in common now
    return b"".join(out + ids[at:])


def as_encoded(doc_id: pa.Array, ids: list[bytes], raw: list[bytes]) -> pa.RecordBatch:
    """Rows of IDS."""
    return rows_out(doc_id=(doc_id, pa.int64()), ids=(ids, pa.binary()), raw=(raw, pa.binary()))


def ids_sha256(ids: bytes) -> str:
    """Hash of the decimal ids joined by one space; HASHED ids are written out at once."""
    found, numbers = hashlib.sha256(), np.frombuffer(ids, "<u4")
    for at in range(0, len(numbers), HASHED):
        found.update(((" " if at else "") + " ".join(map(str, numbers[at : at + HASHED].tolist()))).encode())
    return found.hexdigest()


def as_digests(doc_id: pa.Array, ids: list[bytes], raw: list[bytes]) -> pa.RecordBatch:
    """Rows of DIGESTS."""
    return rows_out(
        doc_id=(doc_id, pa.int64()),
        n_tokens=([len(x) // 4 for x in ids], pa.int64()),
        ids_sha256=(list(map(ids_sha256, ids)), pa.string()),
        decoded_sha256=([hashlib.sha256(x).hexdigest() for x in raw], pa.string()),
    )


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP, derive: Callable = as_encoded, schema: str = IDS) -> DataFrame:
    """doc_id, ids (little-endian 32-bit), raw (the decoded bytes) for each row of docs; or what derive makes of them, with the schema given.

    derive gets the doc_ids, ids and raw of some rows and returns a batch; it runs where they were encoded.
    """

    @frugal
    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for part in slices(batches):
            ids = [c.encode(c.pieces(x)) for x in part.column(1).to_pylist()]
            yield derive(part.column(0), ids, list(map(c.decode, ids)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            doc, text, row = (part.column(x)[0].as_py() for x in range(3))
            found = chunks(text, size, overlap)
            for k, (start, x) in enumerate(found):
                yield rows_out(row=([row], pa.int64()), doc_id=([doc], pa.int64()), k=([k], pa.int32()), start=([start], pa.int64()), last=([k == len(found) - 1], pa.bool_()), text=([x], pa.string()))

    @frugal
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for part in slices(batches, 4):
            ends, ids, sizes = [], [], []
            for start, last, text in zip(part.column("start").to_pylist(), part.column("last").to_pylist(), part.column("text").to_pylist(), strict=True):
                e, found = cut(text, start, last, c)
                ends.append(e.astype("<i8").tobytes())
                sizes.append(np.array(list(map(len, found)), "<i4").tobytes())
                ids.append(b"".join(found))
            keep = [part.column(x) for x in ("row", "doc_id", "k", "start", "text")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x, pa.binary()) for x in (ends, sizes, ids))], names=["row", "doc_id", "k", "start", "text", "ends", "sizes", "ids"])

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k")
        c, parts = codec(path, pattern), []
        for start, text, ends, sizes, ids in zip(*(rows.column(x).to_pylist() for x in ("start", "text", "ends", "sizes", "ids")), strict=True):
            at = np.cumsum([0, *np.frombuffer(sizes, "<i4")]).tolist()
            parts.append((start, text, np.frombuffer(ends, "<i8"), [ids[a:b] for a, b in zip(at, at[1:], strict=False)]))
        ids = stitch(parts, c, overlap)
        return pa.Table.from_batches([derive(pa.array(rows.column("doc_id").slice(0, 1).to_pylist(), pa.int64()), [ids], [c.decode(ids)])])

    texts, limit = id_and_text(docs, id_col, text_col), size + overlap
    one = texts.where(F.length("text") <= limit).mapInArrow(short, schema)
    many = texts.where(F.length("text") > limit).withColumn("row", F.monotonically_increasing_id()).mapInArrow(split, "row long, doc_id long, k int, start long, last boolean, text string")
    pieces = many.repartition("row", "k").mapInArrow(encoded, "row long, doc_id long, k int, start long, text string, ends binary, sizes binary, ids binary")
    return one.union(pieces.groupBy("row").applyInArrow(whole, schema))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield as_digests(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist())

    return encoded.mapInArrow(run, DIGESTS)
