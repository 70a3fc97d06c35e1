"""The near-copy stage against brute force over word 5-shingles."""

import random

import numpy as np
import pyarrow as pa

from lagoon.llm import nearcopies, stages
from tests.llm.cases import frame, prose
from tests.llm.test_dedup import roots_of


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def test_every_pair_of_similarity_0_8_is_found(spark):
    rng = random.Random(11)
    texts = [None, " \n", "one", "ONE", "two words", "two words more", "a b c d e", "a b c d e f"]
    for n in (30, 120, 300):
        for edits in (1, 2, 3, 4, 6, 8):
            for _ in range(6):
                base = prose(rng, n)
                texts += [base, edited(rng, base, max(1, edits * n // 300))]
    base = prose(rng, 200)
    texts += [edited(rng, base, rng.choice([2, 3, 4, 30])) for _ in range(60)]  # one large block
    texts += [base + " " + prose(rng, k) for k in range(0, 200, 8)]
    passage = prose(rng, 90)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, rng.randint(1, 30)) for _ in range(40)]
    sets = [plain_shingles(x) for x in texts]
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(alike) > 200
    want = sorted(set(roots_of(len(texts), alike)))
    docs = [(i, x, "en", "a", len(x or "")) for i, x in enumerate(texts)]
    kept = stages.drop_near_copies(spark, frame(spark, docs), "")
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == want


def test_large_blocks_without_all_pairs(spark, monkeypatch):
    """Bitmaps and cells lose no pair, and leave few that aren't similar."""
    rng = random.Random(12)
    base = prose(rng, 250)
    texts = [edited(rng, base, rng.choice([3, 8, 14])) for _ in range(150)]
    sets = [np.sort(nearcopies.shingles(x.encode())) for x in texts]
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if nearcopies.similar(sets[i], sets[j])}
    assert 100 < len(alike) < 9000
    docs = frame(spark, [(i, x, "en", "a", 0) for i, x in enumerate(texts)]).select("doc_id", "text")
    large = spark.createDataFrame([(7, i, len(s), 0) for i, s in enumerate(sets)], "key long, rep long, n int, pos int")
    none = spark.createDataFrame([], "rep long, root long")
    for rows in (nearcopies.CELL_ROWS, 40):
        monkeypatch.setattr(nearcopies, "CELL_ROWS", rows)
        found = nearcopies.across(docs, large, none)
        got = [(r["a"], r["b"]) for r in found.collect()]
        assert alike <= set(got) and len(got) == len(set(got)) and len(got) < 1.3 * len(alike) + 50


def test_neighbours_of_a_block_in_many_batches():
    rows = [(1, i, 100, 0) for i in range(3)] + [(2, i, 100 + i // 9, 0) for i in range(90)] + [(3, i, 50, 0) for i in range(16)] + [(4, 5, 50, 0)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    want = {(a, b) for a in range(3) for b in range(a)} | {(i + k, i) for i in range(90) for k in range(1, 5)} | {(a, b) for a in range(16) for b in range(a)}
    want = {(min(x), max(x)) for x in want if max(x) < 90}
    for size in (1, 4, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names=["key", "rep", "n", "pos"]) for i in range(0, len(rows), size)]
        found = [r for b in nearcopies._near(iter(batches)) for r in b.to_pylist()]
        assert sorted(r["a"] for r in found if r["b"] is None) == list(range(90))
        assert {(r["a"], r["b"]) for r in found if r["b"] is not None} == want
