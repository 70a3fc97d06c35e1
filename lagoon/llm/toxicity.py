"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

1. A character model: trigram counts over all documents, summed by task and then by trigram.
2. Tokens that look disguised (leetspeak, separators between letters, runs of a letter) and runs of single
   letters become lattices: each character may stand for itself, for a letter it imitates, or for nothing (a
   separator, a repeat), and a blank in a run of single letters for nothing or for the end of a word. Viterbi
   finds the likeliest letters under the character model and the channel's costs.
3. A classifier over restored words and their beginnings, learned from a bounded sample of labelled rows
   (about SAMPLE_ROWS, by hash of doc_id, one text for each). Features must pass a likelihood-ratio test and
   explain toxic rows that better ones leave unexplained; a logistic regression weighs them.

Defined cases: null text is empty and has the score of a text without features; without labels of both
kinds every score is 0; a row with a null doc_id is scored and not learned from; of several texts with one
labelled doc_id the one of the smallest hash is learned from; repeated rows get equal scores; features of
equal likelihood ratio go by their hash; long texts need memory in proportion to their own length; only the
columns named are read, so no other can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import as_bytes, crc_bucket, cut_lineage, frugal, id_and_text, rows_out, share_of_rows, slices

SAMPLE_ROWS = 16000
#: Chance that any of the features without meaning passes the likelihood-ratio test, and the rows that a feature needs.
ALPHA = 0.1
MIN_ROWS = 4
#: Features that must explain a toxic row.
COVERED = 3
PREFIXES = (4, 5)
KEPT_TOKENS = 150_000
#: Characters and the letters that they imitate.
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = set(".-_*'~,:;/\\\"^` ")
THRICE = re.compile(r"(.)\1\1").search
COST_IMITATE, COST_DROP, COST_REPEAT, COST_KEEP_REPEAT = 1.0, 0.5, 0.2, 0.8

#: Character classes of the model: 0 other, 1..26 letters, 27 letters beyond a-z.
CLASSES = np.array([c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 if c >= 128 else 0 for c in range(256)], np.int64)


@frugal
def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 15, np.int64)
    for part in slices(batches):
        for text in as_bytes(part.column(0)):
            for at in range(0, len(text), 1 << 20):  # windows overlap by two, so each trigram counts once
                c = CLASSES[np.frombuffer(b" " * 2 * (at == 0) + text[max(0, at - 2) : at + (1 << 20)] + b" " * (at + (1 << 20) >= len(text)), np.uint8)]
                total += np.bincount((c[:-2] << 10) | (c[1:-1] << 5) | c[2:], minlength=1 << 15)
    seen = np.flatnonzero(total)
    yield rows_out(trigram=(seen, pa.int64()), n=(total[seen], pa.int64()))


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """-log p(third | first two) over 28 classes, smoothed; counted over all documents (32768 sums at most)."""
    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = np.full(1 << 15, 0.5)
    for r in text.mapInArrow(_trigrams, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        counts[r["trigram"]] += r["n"]
    cube = counts.reshape(32, 32, 32)
    return -np.log(cube / cube.sum(axis=2, keepdims=True))


def disguised(token: str) -> bool:
    """Whether letters are mixed with characters that imitate or separate them, or a character is repeated thrice."""
    if len(token) < 3:
        return False
    if token.isalpha():
        return THRICE(token) is not None
    return any(map(str.isalpha, token)) and any(x in IMITATES or x in SEPARATORS for x in token)


def steps(x: str, before: str, blanks: bool) -> tuple[list[tuple[str, float]], float | None]:
    """What a character may stand for: (letter, cost), a blank for the end of a word; and the cost of nothing, or None."""
    if blanks and x == " ":
        return [(" ", 0.0)], COST_DROP
    step = [(x, 0.0)] if x.isalpha() else [(y, COST_IMITATE) for y in IMITATES.get(x, "")]
    return step, COST_DROP if x in SEPARATORS or not step else None


def kind(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 0 if letter == " " else 27


def restore(token: str, cost: list, blanks: bool = False) -> str:
    """The likeliest letters behind a token: Viterbi over (two last classes, last letter), cost[a][b][c] the character model. With blanks, those left end words."""
    states: dict = {(0, 0, ""): (0.0, "")}
    before = ""
    for x in token:
        step, drop = steps(x, before, blanks)
        new: dict = {}
        for (a, b, last), (s, out) in states.items():
            if drop is not None and new.get((a, b, last), (math.inf,))[0] > s + drop:
                new[a, b, last] = (s + drop, out)
            for y, extra in step:
                again = last == y and before == x
                if again and new.get((a, b, last), (math.inf,))[0] > s + COST_REPEAT:
                    new[a, b, last] = (s + COST_REPEAT, out)
                c = kind(y)
                value = s + extra + cost[a][b][c] + COST_KEEP_REPEAT * again
                if new.get((b, c, y), (math.inf,))[0] > value:
                    new[b, c, y] = (value, out + y)
        states, before = new or states, x
    return min(((s + cost[a][b][0], out) for (a, b, _), (s, out) in states.items()))[1]


def feature(kind: str, word: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{word}") >> 1


class Features(dict):
    """Token to the features of the restored word, or to those of them that are wanted; bounded."""

    def __init__(self, cost: np.ndarray, wanted=None):
        self.cost, self.wanted, self.letters = cost.tolist(), wanted, {}

    def __missing__(self, token: bytes) -> tuple[int, ...]:
        if len(self) >= KEPT_TOKENS:
            self.clear()
        word = token.decode("utf-8", "replace").lower().rstrip(".,;:!?\"'()[]{}<>#*%&|=").lstrip(".,;:?\"'([{<#*%&=")
        last = word[-1:]
        if not last.isalpha() and word.endswith(last * 3):
            word = word.rstrip(last)
        found = self.named(restore(word, self.cost) if disguised(word) else word)
        self[token] = found
        return found

    def named(self, word: str) -> tuple[int, ...]:
        found = (feature("w", word), *(feature("p", word[:n]) for n in PREFIXES if len(word) >= n)) if word else ()
        return found if self.wanted is None else tuple(f for f in found if f in self.wanted)

    def letter(self, token: bytes) -> str:
        """The one character of a token, or nothing if it has several; signs around it don't count."""
        if token not in self.letters:
            if len(self.letters) >= KEPT_TOKENS:
                self.letters.clear()
            word = token.decode("utf-8", "replace").lower()
            word = word.strip(".,:;?\"'()[]{}<>#*%&=_~^`") if len(word) > 1 else word
            self.letters[token] = word if len(word) == 1 and (word.isalpha() or word in IMITATES) else ""
        return self.letters[token]

    def of(self, text: bytes) -> set[int]:
        tokens = text.split()
        out = {f for t in set(tokens) for f in self[t]}
        short = np.flatnonzero(np.fromiter(map(len, tokens), np.int64, len(tokens)) <= 6)  # bytes of a character and a sign on either side
        if len(short) >= 3:  # letters set apart
            found = {i: x for i in short.tolist() if (x := self.letter(tokens[i]))}
            at = np.array(list(found), np.int64)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                if len(run) >= 3:
                    for word in restore(" ".join(found[i] for i in run.tolist()), self.cost, True).split():
                        out.update(self.named(word))
        return out


def sample_labels(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """About `rows` labelled ids outside the held-out fifth, by hash of the id; rows per id agree by their largest label."""
    picked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    picked = cut_lineage(picked.where(crc_bucket("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("label").alias("label")))
    return picked.where(share_of_rows(F.col("doc_id"), picked.count(), rows))


class Model:
    """Weights of features, and the shift of the logistic function."""

    def __init__(self, cost: np.ndarray, weights: dict[int, float], shift: float):
        self.cost, self.weights, self.shift = cost, weights, shift

    def score(self, found) -> float:
        raw = math.fsum(self.weights[f] for f in found if f in self.weights) + self.shift
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))


def likelihood_ratio(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log likelihood ratio of a feature in c1 of n1 toxic and c0 of n0 other rows; 0 unless it is commoner in toxic ones."""
    c1, c0 = np.asarray(c1, float), np.asarray(c0, float)
    share = (c1 + c0) / max(n1 + n0, 1)
    total = np.zeros(len(c1))
    for o, e in ((c1, n1 * share), (c0, n0 * share), (n1 - c1, n1 * (1 - share)), (n0 - c0, n0 * (1 - share))):
        total += np.where(o > 0, o * np.log(np.maximum(o, 1) / np.maximum(e, 1e-12)), 0.0)
    return np.where(c1 * n0 > c0 * n1, 2 * total, 0.0)


def ratio_column(n1: int, n0: int) -> Column:
    """likelihood_ratio of columns c1 and c0, of features that are commoner in toxic rows."""
    share = (F.col("c1") + F.col("c0")) / (n1 + n0)
    cells = [(F.col("c1"), n1 * share), (F.col("c0"), n0 * share), (n1 - F.col("c1"), n1 * (1 - share)), (n0 - F.col("c0"), n0 * (1 - share))]
    return 2 * reduce(lambda a, b: a + b, [F.when(o > 0, o * F.ln(o / e)).otherwise(0.0) for o, e in cells])


def cover(rows: list[np.ndarray], label: np.ndarray, features: int, least: float) -> list[int]:
    """Features that explain the toxic rows: the best by likelihood ratio over the rows not yet covered, again and again.

    A row is covered by COVERED of them, so the many odd words that copies of one toxic text share are not taken for its cause.
    """
    at = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    toxic = label[at] == 1
    c0, n0 = np.bincount(flat[~toxic], minlength=features), int((label == 0).sum())
    at, flat, need = at[toxic], flat[toxic], np.where(label == 1, COVERED, 0)
    chosen: list[int] = []
    while True:
        c1 = np.bincount(flat, minlength=features)
        ratio = likelihood_ratio(c1, c0, int((need > 0).sum()), n0)
        ratio[c1 < MIN_ROWS] = 0
        best = int(np.argmax(ratio)) if features else 0
        if not features or ratio[best] < least:
            return chosen
        chosen.append(best)
        need[at[flat == best]] -= 1
        left = (need[at] > 0) & (flat != best)
        at, flat = at[left], flat[left]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 100) -> np.ndarray:
    """Weights and, last, the shift, by Newton's method with a ridge."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, keep = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(keep), a.T @ (y - p) - keep * w)
        w += np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> Model | None:
    """None without labelled rows of both kinds."""
    chosen = cut_lineage(sample_labels(labels, id_col, label_col, rows))  # about `rows`
    if chosen.select("label").distinct().count() < 2:
        return None
    cost = char_model(docs, text_col)

    @frugal
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(cost)
        for part in slices(batches):
            found = [sorted(features.of(x)) for x in as_bytes(part.column(1))]
            yield rows_out(label=(part.column(2), pa.int32()), found=(found, pa.list_(pa.int64())))

    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.max("label").alias("label"))
    # one text counts once, however many copies the sample has of it
    seen = cut_lineage(texts.select("doc_id", "text", "label").mapInArrow(featured, "label int, found array<long>").dropDuplicates(["label", "found"]))
    n0, n1 = (seen.where(F.col("label") == x).count() for x in (0, 1))
    if not n0 or not n1:
        return None
    each = seen.select("label", F.explode("found").alias("feature")).groupBy("feature")
    count = each.agg(F.sum(F.expr("int(label = 1)")).alias("c1"), F.sum(F.expr("int(label = 0)")).alias("c0"))
    tested = cut_lineage(count.where(f"c1 >= {MIN_ROWS} and c1 * {n0} > c0 * {n1}").withColumn("ratio", ratio_column(n1, n0)))
    least = 2 * math.log(max(tested.count(), 1) / ALPHA)  # for as many tests as there are features
    names = [r["feature"] for r in tested.where(F.col("ratio") >= least).orderBy(F.desc(F.round("ratio", 6)), "feature").select("feature").collect()]
    number = {f: i for i, f in enumerate(names)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [[number[f] for f in x if f in number] for x in part.column(1).to_pylist()]
            yield rows_out(label=(part.column(0), pa.int32()), found=(rows, pa.list_(pa.int64())))

    pairs = sorted((r["label"], r["found"]) for r in seen.mapInArrow(numbered, "label int, found array<long>").collect())  # about `rows`
    label, sets = np.array([y for y, _ in pairs]), [np.array(x, np.int64) for _, x in pairs]
    chosen = cover(sets, label, len(names), least)
    x = np.stack([np.isin(chosen, s) for s in sets]).astype(float) if chosen else np.zeros((len(sets), 0))
    w = logistic(x, label.astype(float))
    return Model(cost, {names[c]: float(v) for c, v in zip(chosen, w[:-1], strict=True)}, float(w[-1]))


def _scores(model: Model | None):
    def run(texts: list[bytes], _kept: list = []) -> list[float]:  # noqa: B006
        if model is None:
            return [0.0] * len(texts)
        if not _kept or _kept[0] is not model:
            _kept[:] = [model, Features(model.cost, model.weights)]
        return [model.score(_kept[1].of(x)) for x in texts]

    return run


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row of docs."""
    score = _scores(model)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield rows_out(doc_id=(part.column(0), pa.int64()), score=(score(as_bytes(part.column(1))), pa.float64()))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a score below limit."""
    score, at = _scores(model), docs.columns.index(text_col)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array([x < limit for x in score(as_bytes(part.column(at)))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
