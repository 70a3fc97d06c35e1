"""SimHash near-duplicates: fingerprints, links by tiled exact comparison, classes.

Links are found without comparing all fingerprints with all: a fingerprint is cut into PARTS parts,
and two that differ in at most RADIUS bits agree in PARTS - RADIUS whole parts at least. Each choice
of that many parts is a block key; within a block, fingerprints are laid in tiles in order of their
population count, tile pairs whose counts differ beyond the radius (or that are one class already) are
skipped, and the others are compared by numpy exclusive-or and bit counts. A block returns a spanning
forest, never all pairs.

A block above SPLIT_ROWS isn't held. Its rows agree in the key's bits, so the same holds for the other
bits: they are cut into PARTS parts again, and the rows go on to the blocks of the next level. At the last
of LEVELS levels a key leaves at most 20 bits free, which bounds a block whatever the number of rows. Blocks
that a bounded sample shows to be large skip the first level, so no task reads them whole.

Defined cases: null text is the empty text; a text without words has fingerprint 0 and links like any
other; a row with a null doc_id has a fingerprint, takes no part in linking and has a null component;
repeated rows get equal answers; ties don't occur (a class is named by its smallest doc_id); long texts are
hashed CHUNK shingles at a time; other columns aren't read, so none can clash; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import as_bytes, components, cut_lineage, frugal, id_and_text, rows_out, share_of_rows, slices

RADIUS = 4
SHINGLE_WORDS = 4
PARTS = 6
TILE_ROWS = 1024
SPLIT_ROWS = 8192
LEVELS = 3
#: Nodes that large blocks are looked for among, and how many of them must share a key.
SAMPLE_ROWS, SAMPLE_LARGE = 100_000, 25
#: Shingles hashed before their bits are summed.
CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """64 majority bits over XXH64 of word shingles of the A-Z lower-cased text; 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, lengths = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words, len(parts))
    n, digest, ones = len(parts) - width + 1, xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    first, last = starts[:n].tolist(), ends[width - 1 :].tolist()
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@frugal
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = np.array([fingerprint(x) for x in as_bytes(part.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a signed long."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


@lru_cache(4096)
def block_masks(base: int = 0) -> list[int]:
    """Key masks that any two fingerprints within the radius, equal in the bits of base, agree in one of at least."""
    free = [bit for bit in range(64) if not base >> bit & 1]
    cuts = np.linspace(0, len(free), PARTS + 1).round().astype(int).tolist()
    parts = [sum(1 << bit for bit in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [base | sum(x) for x in combinations(parts, PARTS - RADIUS)]


def mask_of(part: int, level: int) -> int:
    """A block's mask; part has a digit for each level."""
    digits = [part // len(block_masks()) ** k % len(block_masks()) for k in reversed(range(level + 1))]
    base = 0
    for d in digits:
        base = block_masks(base)[d]
    return base


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i with j: each root hangs below the smaller one until all pairs agree."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def tile_pairs(fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Offsets of the pairs of tiles that may hold links; fp is in order of its population counts."""
    ones, starts = np.bitwise_count(fp).astype(int), range(0, len(fp), TILE_ROWS)
    for a in starts:
        most = ones[min(a + TILE_ROWS, len(fp)) - 1]
        yield from ((a, b) for b in starts if b >= a and ones[b] - most <= radius)


def compared(label: np.ndarray, fp: np.ndarray, a: int, b: int, radius: int = RADIUS) -> np.ndarray:
    """Labels after joining the links between the tiles at a and b."""
    i, j = np.nonzero(np.bitwise_count(fp[a : a + TILE_ROWS, None] ^ fp[None, b : b + TILE_ROWS]) <= radius)
    return _joined(label, i + a, j + b)


def block_edges(fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a block."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, rep = fp[order], rep[order]
    label = np.arange(len(fp))
    for a, b in tile_pairs(fp):
        one, two = label[a : a + TILE_ROWS], label[b : b + TILE_ROWS]
        if a == b or (one != one[0]).any() or (two != one[0]).any():
            label = compared(label, fp, a, b)
    below = label != np.arange(len(rep))
    return rep[below], rep[label[below]]


SPREAD = "a long, b long, part long, key long, fp long, rep long"


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [None] * len(a)
    return rows_out(a=(a, pa.int64()), b=(b, pa.int64()), **{x: (none, pa.int64()) for x in ("part", "key", "fp", "rep")})


def spread(part: np.ndarray, fp: np.ndarray, rep: np.ndarray, level: int) -> Iterator[pa.RecordBatch]:
    """Rows (of blocks of this level) once for each block of the next one that they belong to."""
    n = len(block_masks())
    for p in np.unique(part).tolist():
        at = part == p
        masks = np.array(block_masks(mask_of(p, level)), np.uint64).view(np.int64)
        keys, parts = fp[at, None] & masks, np.broadcast_to(p * n + np.arange(n), (int(at.sum()), n))
        none = [None] * keys.size
        yield rows_out(a=(none, pa.int64()), b=(none, pa.int64()), part=(parts.ravel(), pa.int64()), key=(keys.ravel(), pa.int64()), fp=(np.repeat(fp[at], n), pa.int64()), rep=(np.repeat(rep[at], n), pa.int64()))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, key, fp, rep) of large blocks of the first level, for the second."""
    for batch in batches:
        part, _, fp, rep = (c.to_numpy() for c in batch.columns)
        yield from spread(part, fp, rep, 0)


def _blocks(level: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block (part, key): the links within each block, or its rows for the next level if it is large."""
        held: list[np.ndarray] = []  # the rows of the open block
        large = None  # or its name, if its rows go on

        def told(part: np.ndarray, key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(fp) > SPLIT_ROWS and level + 1 < LEVELS:
                yield from spread(part, fp, rep, level)
            elif len(fp) > 1:
                yield _links(*block_edges(fp.view(np.uint64), rep))

        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if large:
                same = (now[0] == large[0]) & (now[1] == large[1])
                n = len(same) if same.all() else int(np.argmin(same))
                yield from spread(now[0][:n], now[2][:n], now[3][:n], level)
                now = [x[n:] for x in now]
            elif held:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            cuts = np.flatnonzero((now[1][1:] != now[1][:-1]) | (now[0][1:] != now[0][:-1])) + 1
            edges = np.concatenate([[0], cuts])
            for i in np.flatnonzero(np.diff(edges) > 1).tolist():
                yield from told(*(x[edges[i] : edges[i + 1]] for x in now))
            held, large = [x[edges[-1] :] for x in now], None
            if len(held[0]) > SPLIT_ROWS and level + 1 < LEVELS:
                yield from told(*held)
                held, large = [], (held[0][0], held[1][0])
        if held:
            yield from told(*held)

    return run


def links(nodes: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the links between nodes(fp, rep); fp distinct, rep its name."""

    def keyed(rows: DataFrame) -> DataFrame:
        signed = [int(np.uint64(m).view(np.int64)) for m in block_masks()]
        rows = rows.select(F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("part", "mask"), "fp", "rep")
        return rows.select(F.col("part").cast("long").alias("part"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "rep")

    rows, out, aside, count = keyed(nodes), [], None, nodes.count()
    if count > SPLIT_ROWS:
        least = max(SAMPLE_LARGE, SPLIT_ROWS * min(1, SAMPLE_ROWS / count))
        seen = keyed(nodes.where(share_of_rows(F.col("fp"), count, SAMPLE_ROWS))).groupBy("part", "key").agg(F.count("*").alias("n"))
        hot = cut_lineage(seen.where(F.col("n") > least).select("part", "key"))
        if not hot.isEmpty():  # at most a row for each SAMPLE_LARGE of the sample's rows
            aside = rows.join(F.broadcast(hot), ["part", "key"], "left_semi").select("part", "key", "fp", "rep").mapInArrow(_spread, SPREAD)
            rows = rows.join(F.broadcast(hot), ["part", "key"], "left_anti")
    for level in range(LEVELS):
        dealt = rows.select("part", "key", "fp", "rep").repartition("part", "key").sortWithinPartitions("part", "key")
        found = cut_lineage(dealt.mapInArrow(_blocks(level), SPREAD))
        out.append(found.where("a is not null").select("a", "b"))
        rows = found.where("a is null")
        if aside is not None:
            rows, aside = rows.union(aside), None
        if level + 1 == LEVELS or rows.isEmpty():
            break
    return reduce(DataFrame.union, out)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    nodes = cut_lineage(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(nodes)).withColumnRenamed("node", "rep")
    named = cut_lineage(nodes.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id")))
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.expr("if(doc_id is null, null, component_id)").alias("component_id"))
