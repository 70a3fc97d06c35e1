"""Near copies of the pipeline's stage: word 5-shingle sets with a Jaccard similarity of 0.8 or more, exactly.

SimHash comes first: fingerprints over the 5-word shingles, linked by the tiles of `simhash`, and each link
confirmed on the texts. That joins most classes at little cost, but 64 bits can't tell a similarity of 0.8
from one below (such pairs differ in some 10 bits, and so do many others), so the classes are completed by
prefix filtering, which loses no pair: with all shingles in one order, two sets of similarity NUM / DEN or
more share one of their first n - ceil(n * NUM / DEN) + 1 shingles. Those are the block keys; pairs whose
sizes or places rule out the similarity are skipped, and so are pairs whose bitmaps do: each text has a
parity bitmap of its shingles, and the exclusive-or of two bitmaps has at most as many ones as the sets have
shingles that only one of them holds. All other pairs are confirmed on their texts before they link, so
texts travel only for pairs that are likely similar. The order puts shingles that are common in a bounded sample last. It decides only how many pairs
are looked at, never the result.

Blocks of up to SMALL texts give all their pairs. Larger ones first give each text's next NEXT neighbours
by size. Once those links are known, only the pairs between different classes are left. Their bitmaps are
compared tile by tile; blocks above CELL_ROWS are dealt out as pairs of parts, so no task holds more than two parts.

Defined cases: words are A-Z lower-cased; null text is the empty text; texts without words are copies of
each other; a text of fewer than 5 words is one shingle; rows with a null doc_id take no part; rows of
one doc_id are one class; repeated rows and ties don't matter (a class is named by its smallest doc_id);
long texts need memory in proportion to their own length; other columns aren't read; an empty table gives
an empty result. Shingles are compared by XXH64, whole texts by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm import simhash
from lagoon.llm.common import as_bytes, components, cut_lineage, forget, frugal, id_and_text, rows_out, share_of_rows, slices

SHINGLE_WORDS = 5
NUM, DEN = 4, 5
SMALL, NEXT = 16, 4
#: Texts that the order is learned from, and shingles that it puts last at most.
SAMPLE_ROWS, COMMON = 8_000, 100_000
#: Rows of a block that meet in one task at most (twice as many, of two parts), bits of a bitmap, and rows of a tile.
CELL_ROWS, BITS, TILE_ROWS = 16_384, 2048, 256
BITMAPS = "rep long, bits binary, size long"


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; empty without words."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, lengths = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    width = min(words, len(parts))
    first, last = (ends - lengths)[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(first, last, strict=True)], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


@frugal
def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = as_bytes(part.column(1))
        copies = [xxhash.xxh3_128_digest(b" ".join(x.lower().split())) for x in texts]
        prints = np.array([simhash.fingerprint(x, SHINGLE_WORDS) for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(copies, pa.binary()), pa.array(prints)], names=["doc_id", "copy", "fp"])


@frugal
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [shingles(x).view(np.int64) for x in as_bytes(part.column(1))]
        yield rows_out(key=(np.concatenate(found), pa.int64()))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that several of the texts have, and how many have them."""
    counted = texts.mapInArrow(_sampled, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    found = counted.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    key, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set's first shingles in the common order, as many as any similar set shares one of."""
    seen = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        seen = np.where(common[at] == found, counts[at], 0)
    n = len(found)
    return found[np.argsort(seen, kind="stable")][: n - -(-n * NUM // DEN) + 1]


def _keys(common: np.ndarray, counts: np.ndarray):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingles(x) for x in as_bytes(part.column(1))]
            first = [prefix(x, common, counts) if len(x) else x for x in sets]
            each = [len(x) for x in first]
            yield rows_out(
                key=(np.concatenate(first).view(np.int64), pa.int64()),
                rep=(np.repeat(part.column(0).to_numpy(), each), pa.int64()),
                n=(np.repeat([len(x) for x in sets], each), pa.int32()),
                pos=(np.concatenate([np.arange(k) for k in each]), pa.int32()),
            )

    return run


def _fits(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sizes, and the places of a first common shingle, leave room for the similarity; n[i] <= n[j]."""
    most = np.minimum(n[i] - pos[i], n[j] - pos[j]).astype(np.int64)
    return (DEN * n[i] >= NUM * n[j]) & ((NUM + DEN) * most >= NUM * (n[i].astype(np.int64) + n[j]))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key, n: pairs (a, b) of each block; of a block above SMALL those of neighbours, and its rows (b null).

    Holds no more of an open block than SMALL rows and a batch: of a large one, the last NEXT rows are enough.
    """
    held, old = [], 0  # the rows of the open block that later ones may pair with; the first `old` of them are paired with each other and told

    def work(columns: list[np.ndarray], old: int, end: int) -> Iterator[pa.RecordBatch]:
        """Rows up to `end`, the end of a block or of what is there of a large one."""
        key, rep, n, pos = (c[:end] for c in columns)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        sizes = np.diff(np.concatenate([[0], cuts, [len(key)]]))
        size, last = np.repeat(sizes, sizes), np.repeat(np.cumsum(sizes), sizes)
        large, every = size > SMALL, np.arange(len(key))
        if old:
            large[: sizes[0]] = True
        many = large.copy()
        many[:old] = False
        for step in range(1, SMALL):
            i = every[(every + step < last) & (~large | (step <= NEXT)) & (every + step >= old)]
            i = i[_fits(n, pos, i, i + step) & (rep[i] != rep[i + step])]
            if len(i):
                a, b, none = rep[i], rep[i + step], np.zeros(len(i), np.int64)
                yield rows_out(a=(np.minimum(a, b), pa.int64()), b=(np.maximum(a, b), pa.int64()), key=(none, pa.int64()), n=(none, pa.int32()), pos=(none, pa.int32()))
        if many.any():
            yield rows_out(a=(rep[many], pa.int64()), b=([None] * int(many.sum()), pa.int64()), key=(key[many], pa.int64()), n=(n[many], pa.int32()), pos=(pos[many], pa.int32()))

    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        cuts = np.flatnonzero(now[0][1:] != now[0][:-1])
        cut = int(cuts[-1]) + 1 if len(cuts) else 0
        if cut:
            yield from work(now, old, cut)
            now, old = [c[cut:] for c in now], 0
        if old or len(now[0]) > SMALL:  # large already: all that is there can be told
            yield from work(now, old, len(now[0]))
            now = [c[-NEXT:] for c in now]
            old = len(now[0])
        held = now
    if held and len(held[0]) > old:
        yield from work(held, old, len(held[0]))


@frugal
def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parity of the shingles that fall on each of BITS bits, and the number of shingles."""
    for part in slices(batches):
        sets = [shingles(x) for x in as_bytes(part.column(1))]
        ones = [np.bincount((x % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1 for x in sets]
        packed = pa.array([np.packbits(x.astype(bool)).tobytes() for x in ones], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), packed, pa.array(list(map(len, sets)), pa.int64())], names=["rep", "bits", "size"])


def bit_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def _room(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether the bitmaps of two sets leave room for the similarity; both is the sum of their sizes."""
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (NUM + DEN) * apart <= (DEN - NUM) * both


@frugal
def _roomy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose bitmaps leave room."""
    for part in slices(batches, 4096):
        a, b, size_a, size_b = (part.column(x).to_numpy() for x in ("a", "b", "size_a", "size_b"))
        good = _room(bit_rows(part.column("bits_a")), bit_rows(part.column("bits_b")), size_a + size_b)
        yield rows_out(a=(a[good], pa.int64()), b=(b[good], pa.int64()))


def roomy(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps don't rule out; where rows share a doc_id, those of any of its texts."""
    pairs = cut_lineage(pairs)
    reps = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    bits = cut_lineage(docs.mapInArrow(_bitmaps, BITMAPS).join(reps, "rep", "left_semi"))  # bitmaps are dealt, not texts
    left, right = (bits.select(F.col("rep").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("size").alias(f"size_{x}")) for x in "ab")
    found = cut_lineage(pairs.join(left, "a").join(right, "b").mapInArrow(_roomy, "a long, b long"))
    forget(pairs, bits)
    return found.distinct()


def _cell(rows: pa.Table) -> pa.Table:
    """Pairs of one block, or of two parts of it, that sizes, places and bitmaps allow and whose classes differ."""
    rows = rows.sort_by("n")
    rep, n, pos, root, part = (rows[x].to_numpy() for x in ("rep", "n", "pos", "root", "part"))
    bits = bit_rows(rows["bits"])
    two, found = len(np.unique(part)) > 1, []
    for at in range(0, len(rep), TILE_ROWS):
        till = min(len(rep), at + TILE_ROWS)
        reach = int(np.searchsorted(n.astype(np.int64) * NUM, DEN * int(n[till - 1]), "right"))
        for other in range(at, reach, TILE_ROWS):
            to = min(reach, other + TILE_ROWS)
            open_ = (root[at:till, None] != root[None, other:to]) & (np.arange(at, till)[:, None] < np.arange(other, to)[None, :])
            if two:  # pairs within a part are another cell's
                open_ &= part[at:till, None] != part[None, other:to]
            i, j = np.nonzero(open_)
            i, j = i + at, j + other
            keep = _fits(n, pos, i, j)
            i, j = i[keep], j[keep]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                good = _room(bits[a], bits[b], n[a].astype(np.int64) + n[b])
                found.append((rep[a[good]], rep[b[good]]))
    a, b = (np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def across(docs: DataFrame, large: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of large blocks(key, rep, n, pos) that may be similar and whose classes, by roots(rep, root), differ."""
    named = cut_lineage(large.join(roots, "rep", "left").select("key", "rep", "n", "pos", F.coalesce("root", "rep").alias("root")))
    mixed = named.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    mixed = cut_lineage(mixed.select("key", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("parts")))
    rows = cut_lineage(named.join(mixed, "key"))
    texts = docs.join(rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    bits = cut_lineage(texts.mapInArrow(_bitmaps, BITMAPS))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, F.col("part")) * F.col("parts") + F.greatest(x, F.col("part")))
    dealt = rows.join(bits.drop("size"), "rep").withColumn("part", part).withColumn("cell", F.explode(cells))
    found = cut_lineage(dealt.groupBy("key", "cell").applyInArrow(_cell, "a long, b long"))
    forget(named, mixed, rows, bits)
    return found.distinct()


@frugal
def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
        kept: dict[bytes, np.ndarray] = {}
        sets = [[kept[x] if x in kept else kept.setdefault(x, shingles(x)) for x in as_bytes(part.column(k))] for k in (2, 3)]
        good = np.array([similar(x, y) for x, y in zip(*sets, strict=True)], bool)
        yield rows_out(a=(a[good], pa.int64()), b=(b[good], pa.int64()))


def confirmed(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    left, right = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) between nodes(rep) that join the classes known(rep, root) to those of all similar pairs; docs(doc_id, text)."""
    kept = docs.join(nodes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sample = nodes.where(share_of_rows(F.col("rep"), nodes.count(), SAMPLE_ROWS)).select(F.col("rep").alias("doc_id"))
    order = common_shingles(docs.join(sample, "doc_id", "left_semi"))
    keys = kept.mapInArrow(_keys(*order), "key long, rep long, n int, pos int")
    dealt = keys.repartition("key").sortWithinPartitions("key", "n", "rep")
    found = cut_lineage(dealt.mapInArrow(_near, "a long, b long, key long, n int, pos int"))
    pairs = found.where("b is not null").select("a", "b").distinct()
    for x in "ab":
        pairs = pairs.join(known.select(F.col("rep").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    near = cut_lineage(confirmed(docs, roomy(docs, pairs.where("not root_a <=> root_b or root_a is null").select("a", "b"))))
    large = found.where("b is null").select("key", F.col("a").alias("rep"), "n", "pos")
    if large.isEmpty():
        return near
    roots = cut_lineage(components(near.union(known.select(F.col("rep").alias("a"), F.col("root").alias("b")))).withColumnRenamed("node", "rep"))
    more = cut_lineage(confirmed(docs, across(docs, large, roots)))
    forget(found, roots)
    return near.union(more)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id for each row of docs; the component is null for a null doc_id."""
    texts = id_and_text(docs, id_col, text_col)
    prints = cut_lineage(texts.mapInArrow(_prints, "doc_id long, copy binary, fp long"))
    nodes = cut_lineage(prints.where("doc_id is not null").groupBy("copy").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp")))
    same = prints.where("doc_id is not null").join(nodes.drop("fp"), "copy").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # texts of rows that share a doc_id are one class, whichever of them the pairs are confirmed on
    reps = cut_lineage(nodes.groupBy("rep").agg(F.min("fp").alias("fp")))
    named = cut_lineage(reps.groupBy("fp").agg(F.min("rep").alias("first")))
    twins = reps.join(named, "fp").where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    hashed = simhash.links(named.select("fp", F.col("first").alias("rep"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = cut_lineage(confirmed(texts, twins.union(hashed).distinct()))
    known = cut_lineage(components(first).withColumnRenamed("node", "rep"))
    roots = components(same.union(first).union(links(texts, reps, known)))
    return prints.select("doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
