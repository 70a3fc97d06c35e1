"""Tokens, packing, licences, quality, languages and toxicity against brute force."""

import base64
import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lagoon.llm import bpe, langid, licences, packing, quality, queries, toxicity
from tests.llm.cases import documents, frame, prose, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("size,overlap", [(1 << 15, 1 << 10), (64, 16), (40, 3)])
def test_chunked_encoding_equals_whole(spark, encoding, size, overlap):
    docs = documents() + [(900, "ab  " * 50 + " " * 300 + "\n" * 90 + "a" * 200 + "1" * 150 + "'ll'll!!" * 40, None, None, 0)]
    docs = [d for d in docs if size > 1000 or len(d[1] or "") < 4000]
    got = rows_of(bpe.digests(bpe.encode(frame(spark, docs), PATH, public_tokenizers.PATTERN, size=size, overlap=overlap)))
    want = []
    for d in docs:
        ids = encoding.encode_ordinary(d[1] or "")
        want.append((d[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_op3_makes_its_digests_where_it_encodes(spark, tmp_path):
    docs = [*documents(), (901, "ab " * 30_000, None, None, 0)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_byte_bpe(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "raw#" not in plan and "ids_sha256#" in plan  # ids and bytes don't go through the JVM to a second worker
    by_rows = bpe.digests(bpe.encode(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH, public_tokenizers.PATTERN))
    assert found.dtypes == by_rows.dtypes and rows_of(found) == rows_of(by_rows)


def test_ids_are_hashed_in_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "HASHED", 4)
    for n in range(14):
        ids = np.arange(7, 7 + n * 5000, 5000)
        assert bpe.ids_sha256(ids.astype("<u4").tobytes()) == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stitching_a_long_run_matches_it_a_few_times(encoding):
    c = bpe.Codec(PATH, public_tokenizers.PATTERN)
    matched = [0]
    pieces = c.pieces
    c.pieces = lambda text: matched.__setitem__(0, matched[0] + len(text)) or pieces(text)
    for text in (" " * 40_000 + "end", "x" * 40_000, "a b " * 200 + "\n" * 30_000 + "c d " * 400, "word " * 3000):
        matched[0] = 0
        parts = [(start, x, *bpe.cut(x, start, start + len(x) == len(text), c)) for start, x in bpe.chunks(text, 100, 10)]
        assert bpe.stitch(parts, c, 10) == np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        assert matched[0] < 8 * len(text)


def test_packing_covers_every_token_once(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    docs = [*documents(), (950, "a <|endoftext|> b", "en", "a", 0), (951, "x<|EndOfText|>y <|startoftext|>", "en", "c", 0)]
    want = Counter((d[0], tuple([*model.encode(d[1] or "", add_special_tokens=False).ids, 2])) for d in docs)
    rows = packing.pack(frame(spark, docs), WORDS, sequence=64, window=4).collect()
    assert [r["ids"] for r in rows if r["doc_id"] == 950] == [np.array([320, 49407, 321, 2], "<u4").tobytes()] or sum(r["doc_id"] == 950 for r in rows) > 1
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    at = (0, 0)
    for seq, offset, n in places:  # gapless, and only the last sequence may be short
        assert (seq, offset) == at and n > 0
        at = (seq, offset + n) if offset + n < 64 else (seq + 1, 0)
    parts = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(np.frombuffer(r["ids"], "<u4"))))
    for (doc, n), pieces in parts.items():
        copies = sum(c for (d, ids), c in want.items() if d == doc and len(ids) == n)
        assert sum(len(x) for _, x in pieces) == copies * n
        if copies == 1:
            assert (doc, tuple(y for _, x in sorted(pieces) for y in x)) in want


def test_served_is_the_exact_order_of_due_tokens():
    totals = [5, 0, 13, 2, 100]
    order = sorted((Fraction(t + 1, n), q) for q, n in enumerate(totals) for t in range(n))
    for due in range(sum(totals) + 3):
        count = Counter(q for _, q in order[:due])
        assert packing.served(totals, due) == [count[q] for q in range(len(totals))]


def test_served_by_weights_is_the_exact_order_of_due_tokens():
    rng = np.random.default_rng(3)
    for _ in range(12):
        totals, weights = rng.integers(0, 40, 6).tolist(), (rng.integers(0, 5, 6) * rng.integers(1, 7, 6)).tolist()
        order = sorted((w == 0, Fraction(t + 1, w or n), q) for q, (n, w) in enumerate(zip(totals, weights, strict=True)) for t in range(n))
        for due in range(sum(totals) + 3):
            count = Counter(q for _, _, q in order[:due])
            assert packing.served(totals, due, weights) == [count[q] for q in range(6)]


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 3}, {"a": 0.5, "b": 0.25, None: 0.25}])
def test_windows_hold_target_shares(spark, weights):
    rng = __import__("random").Random(3)
    docs = [(i, prose(rng, rng.randint(1, 90)), "en", ["a", "b", "c", None, "a"][i % 5], 0) for i in range(500)]
    rows = packing.pack(frame(spark, docs), WORDS, sequence=128, window=4, weights=weights).collect()
    total, window = Counter(), {}
    for r in rows:
        total[r["source"]] += r["length"]
        window.setdefault(r["sequence_id"] // 4, Counter())[r["source"]] += r["length"]
    left, held = Counter(total), 0
    for w in sorted(window):
        if sum(window[w].values()) == 512:
            open_ = {s: (weights or total)[s] for s in (weights or total) if left[s] > window[w][s]}
            if set(open_) == set(weights or total):  # no queue runs dry in it
                held += 1
                assert all(abs(window[w][s] - 512 * open_[s] / sum(open_.values())) <= 2 for s in open_)
        left -= window[w]
    assert held > 5
    places = sorted((r["sequence_id"] * 128 + r["offset"], r["length"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    with pytest.raises(ValueError):
        packing.whole_weights({"a": 0}, ["=a"])


def test_sources_below_a_token_of_each_window_share_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "TAILS", 2)
    rng = __import__("random").Random(4)
    docs = [(i, prose(rng, 60), "en", "large", 0) for i in range(100)] + [(1000 + i, prose(rng, 3), "en", f"small{i % 150}", 0) for i in range(300)]
    rows = packing.pack(frame(spark, docs), WORDS, sequence=16, window=2).collect()
    places = sorted((r["sequence_id"] * 16 + r["offset"], r["length"]) for r in rows)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == {r["doc_id"]: r["doc_tokens"] for r in rows}
    share = sum(r["length"] for r in rows if r["source"] == "large") / sum(got.values())
    window = Counter()
    for r in rows:
        if r["source"] == "large":
            window[r["sequence_id"] // 2] += r["length"]
    assert all(abs(window[w] - 32 * share) <= 3 for w in range(max(window) - 1))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_licences_base_part(spark):
    want = []
    for d in documents():
        w = plain_words(d[1])
        found = [(i, label) for phrase, label in licences.BASE_PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in found]
        want.append((d[0], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    got = licences.scan(frame(spark))
    assert rows_of(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(want, key=repr)
    for r in got.collect():
        assert set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1


def plain_notices(index, words):
    """Labels and score from every start of every template."""
    labels, score = set(), 0.0
    for t, (label, notice, key, base) in enumerate(index.templates):
        rare = sorted(key if base else range(len(notice)), key=lambda p: (-index.idf[notice[p]], p))[: None if base else 4]
        for start in range(-len(notice), len(words)):
            same = {p for p, w in enumerate(notice) if 0 <= start + p < len(words) and words[start + p] == w}
            if set(key) <= same and (base or len(same.intersection(rare)) >= min(2, len(rare))):
                share = 1.0 if base else sum(index.idf[notice[p]] for p in sorted(same)) / sum(index.idf[w] for w in notice)
                if base or share >= licences.MIN_SHARE - 1e-12:
                    labels.add(label)
                    score = max(score, share)
    return ",".join(sorted(labels)), min(score, 1.0)


def test_licence_labels_and_scores_from_every_start(spark):
    rng = __import__("random").Random(5)
    notices = [x[1].split() for x in licences.TEMPLATES] + [p.split() for p in licences.BASE_PHRASES]
    texts = []
    for i in range(120):
        words = rng.choice(notices).copy()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["x", "license", "the", "software", "public"])
        texts.append(" ".join([*["some"] * rng.randint(0, 3), *words[rng.randint(0, 3) * (i % 3 == 0) :], *rng.choice(notices)[: rng.randint(0, 9)]]))
    docs = [(i, x, None, None, 0) for i, x in enumerate(texts)] + documents()
    df = frame(spark, docs)
    index = licences.build_index(df)
    got = {(r["doc_id"], r["n_words"]): (r["labels"], r["score"]) for r in licences.scan(df).collect()}
    found = 0
    for d in docs:
        words = licences.words_of((d[1] or "").encode())
        labels, score = plain_notices(index, words) if len(words) < 5000 else ("", 0.0)
        assert got[d[0], len(words)] == (labels, pytest.approx(score)), d[1]
        found += bool(labels)
    assert found > 60


def test_licence_notices_are_found_with_gaps_in_place():
    index = licences.Index(1000, {})
    notice = "Redistribution and use in source and binary forms, with or without MODIFICATION, are permitted provided that these conditions are met"
    assert index.scan(licences.words_of(notice.encode()))["labels"] == "bsd"
    assert index.scan(licences.words_of(b"redistribution of binary source forms is fine"))["labels"] == ""
    assert index.scan(licences.words_of(b"Licensed under CC BY-NC 4.0"))["labels"] == "cc-by,cc-by-nc"


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def plain_share(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, inside = set(), set()
    for i in range(len(words) - n + 1):
        key = tuple(words[i : i + n])
        if key in seen:
            inside.update(range(i, i + n))
        seen.add(key)
    return sum(len(words[i]) for i in inside) / max(1, sum(map(len, words)))


def test_quality_counts_and_coverage(spark):
    got = quality.measures(frame(spark))
    base = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(base) == sorted(((d[0], *plain_quality(d[1])) for d in documents()), key=repr)
    for d in documents():
        found = quality.measure((d[1] or "").encode())
        assert found["coverage"] == pytest.approx(max(plain_share(d[1], n) for n in quality.NGRAM_LIMITS))
        assert not (found["base_failed"] and found["kept"])
    kept = quality.keep_good(frame(spark)).columns
    assert kept == frame(spark).columns


def test_many_kinds_of_words_stay_exact():
    ids = np.arange(1000) % 7
    assert (quality.repeats(quality.exact_trigrams(ids, 3_000_000))[0] == quality.repeats(quality.exact_trigrams(ids, 7))[0]).all()


def plain_segmentations(number, word):
    """All segmentations of a word into pieces and single characters, as lists of (piece or None)."""
    if not word:
        return [[]]
    out = []
    for n in range(1, len(word) + 1):
        p = number.get(word[:n])
        if p is not None or n == 1:
            out += [[p, *rest] for rest in plain_segmentations(number, word[n:])]
    return out


LANGUAGE_WORDS = ["the", "stra\u00dfe", "a", "\u6f22\u5b57", "question", "population", "xqzj"]


@pytest.mark.parametrize("long", [24, 3])  # 3: nearly all words go the way of long ones
def test_language_forward_sums_all_segmentations(monkeypatch, long):
    monkeypatch.setattr(langid, "LONG", long)
    pieces = langid.pieces_at(PIECES)
    assert pieces.longest == 16
    rng = np.random.default_rng(0)
    probability = rng.random((len(pieces.pieces), 2))
    number = {p: i for i, p in enumerate(pieces.pieces)}

    def plain(word):
        return sum(np.prod([probability[p] if p is not None else np.full(2, langid.UNKNOWN) for p in way], axis=0) for way in plain_segmentations(number, "\u2581" + word))

    scorer = langid.Scorer(pieces, probability)
    scorer.add(set(LANGUAGE_WORDS))
    for w in LANGUAGE_WORDS:
        assert scorer.rows[scorer[w]] == pytest.approx(np.log(plain(w)))
    scorer.add({"The-question,", "12"})
    assert scorer["12"] == 0 and scorer.rows[scorer["The-question,"]] == pytest.approx(scorer.rows[scorer["the"]] + scorer.rows[scorer["question"]])
    named = pieces.find(pieces.names[:-1])
    assert (named == np.arange(len(named))).all()
    assert np.isfinite(langid.long_log(pieces, "donau" * 2000, scorer.weights)).all()


@pytest.mark.parametrize("long", [24, 3])
def test_expected_counts_weigh_all_segmentations(monkeypatch, long):
    monkeypatch.setattr(langid, "LONG", long)
    pieces = langid.pieces_at(PIECES)
    number, n = {p: i for i, p in enumerate(pieces.pieces)}, len(pieces.pieces)
    counts = np.random.default_rng(1).integers(0, 5, (len(LANGUAGE_WORDS), 2)).astype(float)
    want = np.zeros((n, 2))
    for w, c in zip(LANGUAGE_WORDS, counts, strict=True):
        ways = plain_segmentations(number, "\u2581" + w)
        share = np.array([np.prod([1 / n if p is not None else langid.UNKNOWN for p in way]) for way in ways])
        for way, x in zip(ways, share / share.sum(), strict=True):
            for p in way:
                if p is not None:
                    want[p] += x * c
    got = langid.expected(pieces, LANGUAGE_WORDS, counts)
    assert got == pytest.approx(want, abs=1e-9)


def test_language_prediction(spark):
    rng = __import__("random").Random(1)
    letters = {"en": "etaoinshr", "xx": "zqxjkvbpy"}
    docs = [(i, prose(rng, 40, letters[g]), g if i % 5 else None, "s", 0) for i, g in enumerate(["en", "xx"] * 40)]
    docs += [(500, None, "en", "s", 0), (501, "123 !", "en", "s", 0), (None, prose(rng, 30, letters["xx"]), "xx", "s", 0)]
    df = frame(spark, docs)
    langs, probability = langid.learn(df, F.col("doc_id") < 60, PIECES)
    assert langs == ["en", "xx"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, langs, probability, PIECES).collect()}
    assert got[500] == ("und", 0.0) and got[501] == ("und", 0.0) and got[None][0] == "xx"
    assert all(got[i][0] == ["en", "xx"][i % 2] for i in range(80))
    # repeated rows, ties, a long word and more chunks than are kept at once
    twice = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(df.union(df), langs, probability, PIECES).collect()}
    assert twice == {(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, langs, probability, PIECES).collect()}
    same = langid.predict(df, ["b", "a"][::-1], np.full((len(probability), 2), 1e-4), PIECES).where("doc_id < 80")
    assert {(r["lang_pred"], r["score"]) for r in same.collect()} == {("a", 0.5)}
    long = frame(spark, [(1, "etaoin" * 3000, "en", "s", 0), (2, prose(rng, 400, letters["xx"]), "xx", "s", 0)])
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(long, langs, probability, PIECES).collect()} == {1: "en", 2: "xx"}
    scorer = langid.Scorer(langid.pieces_at(PIECES), probability)
    text = prose(rng, 300, letters["xx"])
    whole = scorer.scores([text])[0]
    kept, langid.KEPT_CHUNKS = langid.KEPT_CHUNKS, 40
    try:
        assert langid.Scorer(langid.pieces_at(PIECES), probability).scores([text])[0] == pytest.approx(whole)
    finally:
        langid.KEPT_CHUNKS = kept
    nothing = langid.learn(df, F.lit(False), PIECES)
    assert {r["lang_pred"] for r in langid.predict(df, *nothing, PIECES).collect()} == {"und"}


def test_restoration_of_disguised_words(spark):
    model = toxicity.char_model(frame(spark, [(i, "stupid idiot moron the clown and a loser went home to sleep " * 20, None, None, 0) for i in range(4)]))
    features = toxicity.Features(model)
    plain = features.of(b"idiot")
    for x in (b"1d10t", b"i.d.i.o.t", b"i d i o t", b"idiooooot", b"ID10T!!", b"i-d-i-o-t", b"!diot", b"i, d, i, o, t", b"a i d i o t", b"went i d i o t m o r o n home"):
        assert plain <= features.of(x), x
    assert features.of(b"moron") <= features.of(b"i d i o t m o r o n")
    accents = toxicity.Features(toxicity.char_model(frame(spark, [(1, "\u00e9t\u00e9 \u00e0 la " * 30, None, None, 0)])))
    assert accents.of("\u00e9t\u00e9".encode()) <= accents.of("\u00e9 t \u00e9".encode())
    assert features.of(b"") == set()


def plain_restore(token, cost, blanks):
    """The cheapest of all ways through the lattice, one by one."""
    ways = [(0.0, "", 0, 0)]
    before = ""
    for x in token:
        step, drop = toxicity.steps(x, before, blanks)
        new = []
        for s, out, a, b in ways:
            if drop is not None:
                new.append((s + drop, out, a, b))
            for y, extra in step:
                again = out[-1:] == y and before == x
                if again:
                    new.append((s + toxicity.COST_REPEAT, out, a, b))
                c = toxicity.kind(y)
                new.append((s + extra + cost[a][b][c] + toxicity.COST_KEEP_REPEAT * again, out + y, b, c))
        ways, before = new or ways, x
    return min(s + cost[a][b][0] for s, _, a, b in ways), {out for s, out, a, b in ways if s + cost[a][b][0] < min(t + cost[c][d][0] for t, _, c, d in ways) + 1e-9}


def test_viterbi_finds_the_cheapest_way():
    rng = np.random.default_rng(8)
    cost = rng.random((32, 32, 32)) * 4
    cost = cost.tolist()
    letters = "ab1!.-e3 i|\u00e9"
    for n in range(1, 8):
        for _ in range(25):
            token = "".join(rng.choice(list(letters), n))
            token += token[-1] * int(rng.integers(0, 3))
            for blanks in (False, True):
                assert toxicity.restore(token, cost, blanks) in plain_restore(token, cost, blanks)[1], token


def test_character_model_counts_every_trigram(spark):
    docs = documents()
    cost = toxicity.char_model(frame(spark))
    counts = Counter()
    for d in docs:
        c = [0, 0, *(int(toxicity.CLASSES[b]) for b in (d[1] or "").encode()), 0] if d[1] else []
        counts.update(zip(c, c[1:], c[2:], strict=False))
    cube = np.full((32, 32, 32), 0.5)
    for k, v in counts.items():
        cube[k] += v
    assert cost == pytest.approx(-np.log(cube / cube.sum(axis=2, keepdims=True)))


def test_likelihood_ratio_of_a_table(spark):
    rng = np.random.default_rng(5)
    c1, c0 = rng.integers(0, 30, 60), rng.integers(0, 50, 60)

    def plain(a, b):
        out = 0.0
        for o, row, column in ((a, 30, a + b), (b, 50, a + b), (30 - a, 30, 80 - a - b), (50 - b, 50, 80 - a - b)):
            out += o * np.log(o * 80 / (row * column)) if o else 0.0
        return 2 * out if a * 50 > b * 30 else 0.0

    want = [plain(int(a), int(b)) for a, b in zip(c1, c0, strict=True)]
    assert toxicity.likelihood_ratio(c1, c0, 30, 50) == pytest.approx(want)
    df = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in zip(c1, c0, want, strict=True) if w], "c1 long, c0 long, want double")
    assert all(r[0] == pytest.approx(r[1]) for r in df.select(toxicity.ratio_column(30, 50), "want").collect())


def test_cover_takes_the_best_feature_each_time():
    rng = np.random.default_rng(6)
    rows = [np.unique(rng.integers(0, 25, rng.integers(0, 8))) for _ in range(200)]
    label = np.array([int(rng.random() < 0.15 + 0.7 * (0 in r or 3 in r)) for r in rows])
    need, chosen = {i: toxicity.COVERED for i, y in enumerate(label) if y}, []
    while True:
        best = (0.0, 0)
        for f in range(25):
            a, b = sum(need.get(i, 0) > 0 and f in r and f not in chosen for i, r in enumerate(rows)), sum(f in r for r, y in zip(rows, label, strict=True) if not y)
            ratio = toxicity.likelihood_ratio([a], [b], sum(v > 0 for v in need.values()), int((label == 0).sum()))[0] if a >= toxicity.MIN_ROWS else 0.0
            best = max(best, (ratio, -f))
        if best[0] < 3.0:
            break
        chosen.append(-best[1])
        for i, r in enumerate(rows):
            if i in need and -best[1] in r:
                need[i] -= 1
    assert chosen and toxicity.cover(rows, label, 25, 3.0) == chosen


def test_logistic_weights_have_no_slope():
    rng = np.random.default_rng(7)
    x, y = rng.random((80, 3)), (rng.random(80) < 0.4).astype(float)
    w = toxicity.logistic(x, y)
    a = np.concatenate([x, np.ones((80, 1))], axis=1)
    assert a.T @ (y - 1 / (1 + np.exp(-a @ w))) - 0.1 * w == pytest.approx(np.zeros(4), abs=1e-6)


def test_cover_prefers_causes_to_odd_words_of_copies():
    rng = np.random.default_rng(0)
    rows, label = [], []
    for i in range(600):
        bad = i % 3 == 0
        causes = rng.choice(6, 3, replace=False) if bad else []
        odd = [100 + k for k in range(20)] if bad and i < 90 else []  # near copies of one toxic text
        rows.append(np.array([*causes, *odd, *(200 + rng.choice(50, 5, replace=False))], np.int64))
        label.append(int(bad))
    assert sorted(toxicity.cover(rows, np.array(label), 250, 20.0)) == list(range(6))
    assert toxicity.cover([], np.array([], int), 0, 20.0) == []


def test_toxicity_learns_and_holds_out(spark):
    rng = __import__("random").Random(2)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(rng, 50).split()
        if bad:
            for w in rng.sample(["grumpf", "blorgh", "zwickel"], 2):
                words.insert(rng.randrange(50), w)
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(bad)))
    df, known = frame(spark, docs + [(None, None, None, None, None)]), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(df, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels) and 0 <= got[None] < 0.5
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == 301
    assert toxicity.fit(df, known.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.scores(df, None).collect()} == {0.0}
    # several texts with one labelled id, and repeated rows, are learned from once; a very long text is scored whole
    more = df.union(df).union(frame(spark, [(3, "other words " * 40, None, None, 0)]))
    again = toxicity.fit(more, known)
    got = {(r["doc_id"], r["score"] >= 0.5) for r in toxicity.scores(more, again).collect()}
    assert {x for x in got if x[0] != 3} == {(i, bool(y)) for i, y in labels if i != 3} | {(None, False)}
    long = frame(spark, [(1, prose(rng, 200_000) + " g r u m p f bl0rgh zw!ckel", None, None, 0)])
    assert toxicity.scores(long, again).first()["score"] >= 0.5


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert licences.scan(empty).collect() == [] and quality.measures(empty).collect() == []
    assert packing.pack(empty, WORDS).collect() == [] and bpe.encode(empty, PATH, public_tokenizers.PATTERN).collect() == []
    langs, probability = langid.learn(empty, F.lit(True), PIECES)
    assert langs == [] and langid.predict(empty, langs, probability, PIECES).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scores(empty, toxicity.fit(empty, labels)).collect() == []


def test_bare_merges_equal_the_tokenizer():
    rng = __import__("random").Random(6)
    known = packing.Tokens(WORDS)
    assert known.pattern is not None
    words = [prose(rng, 1, "abcdefghijklmnopqrstuvwxyz") for _ in range(3000)]
    words += [prose(rng, 1, "aAeéÉüßñçŒĲǅſ'’.,1-_Ⅷ́") for _ in range(3000)]
    words += ["", "aaaaaaaaa", "İ", "ΑΣ", "don't", "<|endoftext|>", "x y", "\u0085", "a\x1cb", "ſ", "ŉ", "ª", "1²½", "''s", "漢字", "é"]
    assert [known.encode([w])[0] for w in words] == [np.array([*known.model.encode(w, add_special_tokens=False).ids, 2], known.kind).tobytes() for w in words]
