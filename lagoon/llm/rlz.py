"""Substring dedup: relative Lempel-Ziv factors of documents against the reference blocks of all smaller documents.

Reference blocks. Every WINDOW consecutive words are named by the smallest hash among their
ANCHOR_WORDS-word grams (their anchor). Consecutive windows with one anchor form a block; a whole text is
a block of its own. Equal windows have equal anchors, so a window of another document can only stand in
a block of the same anchor. The index holds every distinct block of all documents under its anchor and
its name, with the document that has it first (smallest doc_id) and the place there: one row for each
task and block, however many documents share it.

Factoring. A block that a smaller document has first is matched as a whole: (document, place) is its
reference. Of the others, a window may still stand in a different block of the same anchor: there a
factor begins, ends or passes from one reference to another. These blocks, one owner each, are opened,
and their windows are looked up by (anchor, window hash), 128 bits, in the same way. So each window of a
document knows its reference, and the parse goes through it from the left: a factor (reference document,
place there, length) goes on while the next window's reference is the next place of the same document.
Every window is checked up to both boundaries of a factor, so none that straddles two references is
missed or invented. Factors have WINDOW words or more; together they are the duplicate spans.

Blocks of anchors that only one document has, and of a document that has its anchors first, are not
looked up at all. No group is gathered: references come by joins, whose hot blocks are split.

Defined cases: null text has no words; texts under WINDOW words keep all words; a row with a null doc_id
is no reference and keeps all words; rows with one doc_id don't count as smaller than each other, and a
reference to such a doc_id may mean any of its texts; repeated rows are treated alike; long texts are
handled in segments, with memory in proportion to their own length; other columns go through in a struct,
so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.llm.common import as_bytes, cut_lineage, forget, frugal, mixed, rows_out, slices, window_hashes

WINDOW = 50
ANCHOR_WORDS = 16
#: Windows that one gram can be the anchor of; longer runs (of repeated words) are cut into blocks of so many.
BLOCK_WINDOWS = WINDOW - ANCHOR_WORDS + 1
SEGMENT = 1 << 17
#: Word hashes that a task keeps.
KEPT_WORDS = 150_000
#: Odd multipliers of the two rolling hashes; fixed, so that all tasks agree.
ANCHOR_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: In place of a window's number: the reference is the block's.
WHOLE = -1
FACTOR = "struct<start: bigint, length: bigint, doc: bigint, at: bigint>"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    out, have = x, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(x) - width + 1], out[width - have :]) if have < width else out


def windows(words: list[bytes], known: WordHashes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By segments: the first window's place, and each window's anchor and hash."""
    for at in range(0, len(words) - WINDOW + 1, SEGMENT):
        part = words[at : at + SEGMENT + WINDOW - 1]
        h = np.fromiter(map(known.__getitem__, part), np.uint64, len(part))
        yield at, smallest(window_hashes(h, ANCHOR_WORDS, ANCHOR_BASE), BLOCK_WINDOWS), window_hashes(h, WINDOW, WINDOW_BASE)


def blocks(anchor: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the blocks among consecutive windows, and the name of each block's words."""
    n = len(anchor)
    run = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    place = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))  # of a window in its run
    starts = np.flatnonzero(place % BLOCK_WINDOWS == 0)
    place = (place % BLOCK_WINDOWS).astype(np.uint64)
    sizes = np.diff(np.append(starts, n)).astype(np.uint64)
    return starts, mixed(np.add.reduceat(window * (2 * place + np.uint64(1)), starts) + sizes)


def whole(text: bytes) -> tuple[int, int]:
    """The name of a whole word sequence, as two signed 64-bit numbers."""
    digest = xxhash.xxh3_128_digest(b" ".join(text.split()))
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


@frugal
def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each document, once, and the name of its text (high not null; size is its number of anchors)."""
    known = WordHashes()
    for part in slices(batches):
        ids, found, high, sizes = [], [], [], []
        for doc, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
            words = text.split()
            if len(words) >= WINDOW:
                own = np.unique(np.concatenate([a for _, a, _ in windows(words, known)])).view(np.int64).tolist()
                a, b = whole(text)
                ids += [doc] * (len(own) + 1)
                found += [a, *own]
                high += [b, *[None] * len(own)]
                sizes += [len(own), *[0] * len(own)]
        if ids:
            yield rows_out(anchor=(found, pa.int64()), high=(high, pa.int64()), doc=(ids, pa.int64()), size=(sizes, pa.int64()))


def _lists(part: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """A list column's rows as arrays; empty for null."""
    for x in part.column(name):
        yield x.values.to_numpy() if x.is_valid else np.empty(0, np.int64)


def _shared(part: pa.RecordBatch):
    """For each row: its words, the name of its text, and "copy" (a smaller document has the text), "first" (a larger one has it too) or "only"; None where nothing of it is shared."""
    for doc, alone, text, only, first in zip(part.column("doc_id"), part.column("alone").to_pylist(), as_bytes(part.column("text")), _lists(part, "only"), _lists(part, "first"), strict=True):
        words = text.split()
        if not doc.is_valid or len(words) < WINDOW:
            yield words, None, None, only
            continue
        name = whole(text)
        kind = "first" if (first == name[0]).any() else "only" if (only == name[0]).any() else "copy"
        yield words, name, None if alone and kind == "only" else kind, only


@frugal
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks, once for each document, of anchors that other documents have too; a copy has one, its text, and the first of copies that one besides."""
    known = WordHashes()
    for part in slices(batches, 64):
        anchors, names, docs, places, counts, held = [], [], [], [], [], []
        for doc, (words, name, kind, only) in zip(part.column("doc_id").to_pylist(), _shared(part), strict=True):
            if kind in ("copy", "first"):
                for column, value in ((anchors, name[0]), (names, name[1]), (docs, doc), (places, 0), (counts, 0)):
                    column.append(np.array([value], np.int64))
            for at, anchor, window in windows(words, known) if kind in ("first", "only") else ():
                starts, found = blocks(anchor, window)
                own = anchor[starts].view(np.int64)
                shared = np.flatnonzero(~np.isin(own, only))
                shared = shared[np.unique(found[shared], return_index=True)[1]]  # names differ with their anchors
                ends = np.append(starts, len(anchor))[shared + 1]
                for column, value in ((anchors, own[shared]), (names, found[shared].view(np.int64)), (docs, np.full(len(shared), doc)), (places, at + starts[shared]), (counts, ends - starts[shared])):
                    column.append(value)
                held += [window[a:b] for a, b in zip(starts[shared].tolist(), ends.tolist(), strict=True)]
        if anchors:
            sizes = np.concatenate(counts)
            hashes = pa.array(np.concatenate([*held, np.empty(0, np.uint64)]).view(np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), hashes)
            columns = [pa.array(np.concatenate(x), pa.int64()) for x in (anchors, names, docs, places)]
            yield pa.RecordBatch.from_arrays([*columns, listed], names=["anchor", "name", "doc", "at", "windows"])


def factors(doc: np.ndarray, at: np.ndarray, matched: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy parse: (start, length, reference document, place there) in words; doc and at are each matched window's reference."""
    places = np.flatnonzero(matched)
    if not len(places):
        return []
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) > 1) | (np.diff(doc[places]) != 0) | (np.diff(at[places]) != 1)
    first, last = places[new], places[np.append(np.flatnonzero(new)[1:] - 1, len(places) - 1)]
    return list(zip(first.tolist(), (last - first + WINDOW).tolist(), doc[first].tolist(), at[first].tolist(), strict=True))


def spans(found: list[tuple[int, int, int, int]]) -> tuple[list[int], list[int]]:
    """Word spans (starts, ends) that factors in order of their starts cover, merged where they meet."""
    starts, ends = [], []
    for start, length, _, _ in found:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], start + length)
        else:
            starts.append(start)
            ends.append(start + length)
    return starts, ends


def references(words: list[bytes], known: WordHashes, refs: dict[int, list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a text: its reference document and place, and whether it has one; refs by block name: (window or WHOLE, document, place)."""
    n = len(words) - WINDOW + 1
    doc, place, matched = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    for at, anchor, window in windows(words, known):
        starts, names = blocks(anchor, window)
        ends = np.append(starts[1:], len(anchor))
        for a, b, name in zip((at + starts).tolist(), (at + ends).tolist(), names.view(np.int64).tolist(), strict=True):
            for i, d, p in refs.get(name, ()):
                if i == WHOLE:
                    doc[a:b], place[a:b], matched[a:b] = d, np.arange(p, p + b - a), True
                else:
                    doc[a + i], place[a + i], matched[a + i] = d, p, True
    return doc, place, matched


@frugal
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for part in slices(batches, 64):
        sizes, kept, starts, ends, found = [], [], [], [], []
        for text, refs in zip(as_bytes(part.column("text")), part.column("refs"), strict=True):
            words, parsed = text.split(), []
            sizes.append(len(words))
            if refs.is_valid:
                table: dict[int, list[tuple[int, int, int]]] = {}
                for name, *ref in zip(*(x.to_pylist() for x in refs.values.flatten()), strict=True):
                    table.setdefault(name, []).append(tuple(ref))
                own = table.get(whole(text)[1]) if len(words) >= WINDOW else None
                if own:
                    parsed = [(0, len(words), own[0][1], 0)]
                elif len(words) >= WINDOW:
                    parsed = factors(*references(words, known, table))
            a, b = spans(parsed)
            edges = [0, *(x for pair in zip(a, b, strict=True) for x in pair), len(words)]
            kept.append(b" ".join(w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]))
            starts.append(a)
            ends.append(b)
            found.append([dict(zip(("start", "length", "doc", "at"), x, strict=True)) for x in parsed])
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "doc", "at")]))
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("doc_id"), part.column("text"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(found, kind)],
            names=["row", "doc_id", "text", "n_words", "kept", "starts", "ends", "factors"],
        )


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: row (its other columns), doc_id, text, n_words, kept (its other words, joined by one space), starts and ends of the removed word spans, and the factors that they come from."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    docs = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    named = docs.where("doc_id is not null")
    anchors = named.select("doc_id", "text").mapInArrow(_anchors, "anchor long, high long, doc long, size long")
    index = anchors.groupBy("anchor", "high").agg(F.min("doc").alias("doc_id"), F.max("doc").alias("last"), F.max("size").alias("size"))
    lists = cut_lineage(
        index.groupBy("doc_id").agg(
            F.collect_list(F.expr("if(doc_id = last, anchor, null)")).alias("only"),
            F.collect_list(F.expr("if(doc_id < last, anchor, null)")).alias("first"),
            # whether nobody else has any anchor of its texts (those that it is the first with)
            (F.sum(F.expr("int(high is null and doc_id = last)")) >= F.sum("size")).alias("alone"),
        )
    )
    held = cut_lineage(named.select("doc_id", "text").join(lists, "doc_id", "left").mapInArrow(_blocks, "anchor long, name long, doc long, at long, windows array<long>"))
    # all that joins is cut first, so that every join has plain exchanges below it and AQE can split hot blocks
    index = cut_lineage(held.groupBy("anchor", "name").agg(F.min(F.struct("doc", "at", "windows")).alias("first")))
    left = held.drop("windows").join(index.select("anchor", "name", F.col("first.doc").alias("ref"), F.col("first.at").alias("ref_at")), ["anchor", "name"])
    matched = left.where("doc > ref").select("doc", "name", F.lit(WHOLE).cast("long").alias("window"), "ref", "ref_at")
    # blocks that stand beside others under their anchor are opened
    several = cut_lineage(index.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    opened = cut_lineage(index.join(several, "anchor").select("anchor", "name", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"), F.posexplode("first.windows").alias("window", "hash")))
    earliest = cut_lineage(opened.groupBy("anchor", "hash").agg(F.min(F.struct("doc", (F.col("at") + F.col("window")).alias("at"))).alias("first")))
    inner = opened.join(earliest, ["anchor", "hash"]).where("doc > first.doc")
    matched = matched.union(inner.select("doc", "name", F.col("window").cast("long"), "first.doc", "first.at"))
    refs = cut_lineage(matched.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("name", "window", "ref", "ref_at")).alias("refs")))
    forget(lists, held, index, several, opened, earliest)
    schema = T.StructType([*docs.select("row", "doc_id", "text").schema, *T._parse_datatype_string(f"n_words long, kept string, starts array<long>, ends array<long>, factors array<{FACTOR}>")])
    parsed = named.join(refs, "doc_id", "left").mapInArrow(_parse, schema)
    # rows without a doc_id need no partner, and must not meet in one task
    kind = "array<struct<name: bigint, window: bigint, ref: bigint, ref_at: bigint>>"
    return parsed.union(docs.where("doc_id is null").withColumn("refs", F.lit(None).cast(kind)).mapInArrow(_parse, schema))
