"""SimHash classes and substring dedup against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lagoon.llm import rlz, simhash
from lagoon.llm.common import components, window_hashes
from tests.llm.cases import documents, frame, prose, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_classes_match_brute_force(spark):
    docs = documents()
    prints = [plain_fingerprint(r[1]) for r in docs]
    known = [i for i, r in enumerate(docs) if r[0] is not None]
    root = roots_of(len(docs), [(a, b) for a in known for b in known if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {}
    for i in known:
        least[root[i]] = min(least.get(root[i], 1 << 60), docs[i][0])
    expected = sorted(((r[0], int(np.uint64(p).view(np.int64)), least[root[i]] if r[0] is not None else None) for i, (r, p) in enumerate(zip(docs, prints, strict=True))), key=repr)
    assert rows_of(simhash.classes(frame(spark))) == expected


def test_links_find_every_pair_in_radius(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(6):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            fps.add(int(s) ^ int(sum(1 << int(b) for b in flips)))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    found = {r["node"]: r["root"] for r in components(simhash.links(nodes)).collect()}
    root = roots_of(len(fps), [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert [found.get(i, i) for i in range(len(fps))] == root


@pytest.mark.parametrize("sample", [100_000, 60])
def test_large_blocks_go_on_to_finer_keys(spark, monkeypatch, sample):
    for name, value in {"SPLIT_ROWS": 8, "TILE_ROWS": 4, "SAMPLE_ROWS": sample, "SAMPLE_LARGE": 2}.items():
        monkeypatch.setattr(simhash, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rng = np.random.default_rng(2)
        base = int(rng.integers(0, 1 << 62))
        fps = sorted({base ^ int(sum(1 << int(b) for b in rng.choice(30, rng.integers(0, 9), replace=False))) for _ in range(90)})
        want = roots_of(len(fps), [(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 4])
        nodes = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
        # kernels run in other processes: the level's kernel is made here, with these limits in it
        out, rows = [], []
        for fp, rep in nodes:
            rows += [(p, int(np.uint64(int(np.uint64(m)) & fps[rep]).view(np.int64)), fp, rep) for p, m in enumerate(simhash.block_masks())]
        levels = 0
        for level in range(simhash.LEVELS):
            rows.sort()
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 5], strict=True)], names=["part", "key", "fp", "rep"]) for i in range(0, len(rows), 5)]
            found = [r for b in simhash._blocks(level)(iter(batches)) for r in b.to_pylist()]
            out += [(r["a"], r["b"]) for r in found if r["a"] is not None]
            rows = [(r["part"], r["key"], r["fp"], r["rep"]) for r in found if r["a"] is None]
            assert all(k == f & int(np.uint64(simhash.mask_of(p, level + 1)).view(np.int64)) for p, k, f, _ in rows[::97])
            levels += bool(rows)
        assert levels == 2 and not rows
        assert roots_of(len(fps), out) == want
        found = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame(nodes, "fp long, rep long"))).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def plain_dedup(docs):
    words = [WORD.findall(r[1] or "") for r in docs]
    least = {}
    for r, w in zip(docs, words, strict=True):
        for p in range(len(w) - 49 if r[0] is not None else 0):
            key = tuple(w[p : p + 50])
            least[key] = min(least.get(key, 1 << 60), r[0])
    out = []
    for r, w in zip(docs, words, strict=True):
        gone = set()
        for p in range(len(w) - 49 if r[0] is not None else 0):
            if least[tuple(w[p : p + 50])] < r[0]:
                gone.update(range(p, p + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def removed(df):
    n = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, b: a + b)
    return df.select("doc_id", "n_words", n, F.sha2(F.col("kept").cast("binary"), 256))


def test_duplicate_spans_match_brute_force(spark):
    assert rows_of(removed(rlz.duplicate_spans(frame(spark)))) == plain_dedup(documents())


def check_factors(docs, rows):
    """Every factor's words stand at its reference in a smaller document, and the factors cover what is removed."""
    texts = {}
    for r in docs:
        texts.setdefault(r[0], []).append(WORD.findall(r[1] or ""))
    n = 0
    for r in rows:
        words, covered = WORD.findall(r["text"]), set()
        for start, length, doc, at in r["factors"]:
            assert length >= 50 and doc < r["doc_id"]
            assert any(w[at : at + length] == words[start : start + length] for w in texts[doc])
            covered.update(range(start, start + length))
            n += 1
        assert covered == {i for a, b in zip(r["starts"], r["ends"], strict=True) for i in range(a, b)}
    return n


def test_factors_match_their_references(spark):
    assert check_factors(documents(), rlz.duplicate_spans(frame(spark)).collect()) > 15


def test_factors_of_edited_and_woven_texts(spark):
    rng = __import__("random").Random(17)
    base = [prose(rng, 400) for _ in range(6)]
    docs = [(10 * i, x, None, None, 0) for i, x in enumerate(base)]
    for i in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):  # pieces of several references, one after the other
            source = rng.choice(base).split()
            a = rng.randrange(300)
            words += source[a : a + rng.randint(40, 130)]
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "edited"
        docs.append((100 + rng.randrange(10_000), " ".join(words), None, None, 0))
    docs += [(50_000, "round and " * 200, None, None, 0), (50_001, "x " + "round and " * 300, None, None, 0)]
    rows = rlz.duplicate_spans(frame(spark, docs)).collect()
    assert check_factors(docs, rows) > 60
    assert sorted(((r["doc_id"], r["n_words"], sum(b - a for a, b in zip(r["starts"], r["ends"], strict=True))) for r in rows), key=repr) == [x[:3] for x in plain_dedup(docs)]


def test_greedy_parse():
    none = rlz.factors(np.zeros(3, np.int64), np.zeros(3, np.int64), np.zeros(3, bool))
    assert none == [] and rlz.spans(none) == ([], [])
    doc, at = np.array([0, 4, 4, 4, 7, 7, 0, 7]), np.array([0, 9, 10, 30, 31, 32, 0, 34])
    found = rlz.factors(doc, at, np.array([0, 1, 1, 1, 1, 1, 0, 1], bool))
    assert found == [(1, 51, 4, 9), (3, 50, 4, 30), (4, 51, 7, 31), (7, 50, 7, 34)]
    assert rlz.spans(found) == ([1], [57])


def test_one_doc_id_with_several_texts(spark):
    rng = __import__("random").Random(9)
    a, b, c = (prose(rng, n) for n in (70, 120, 90))
    docs = [(1, a, None, None, 0), (5, a, None, None, 0), (5, b, None, None, 0), (5, c, None, None, 0), (5, c, None, None, 0), (7, c + " x " + b, None, None, 0), (3, b[:500], None, None, 0)]
    assert rows_of(removed(rlz.duplicate_spans(frame(spark, docs)))) == plain_dedup(docs)


def test_segments_do_not_change_the_result(spark, monkeypatch):
    known = rlz.WordHashes()
    words = (documents()[20][1] * 3).encode().split()
    whole = list(rlz.windows(words, known))
    monkeypatch.setattr(rlz, "SEGMENT", 17)
    parts = list(rlz.windows(words, known))
    assert len(whole) == 1 and len(parts) > 5
    for k in (1, 2):
        assert (np.concatenate([p[k] for p in parts]) == whole[0][k]).all()


def test_window_hash_depends_on_words_only():
    x = np.random.default_rng(0).integers(0, 1 << 63, 30).astype(np.uint64)
    both = window_hashes(np.concatenate([x, x]), 10, rlz.WINDOW_BASE)
    assert (both[:21] == both[30:]).all() and len(set(both.tolist())) == 30


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert simhash.classes(empty).collect() == [] and rlz.duplicate_spans(empty).collect() == []
