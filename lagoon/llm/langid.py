"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary (a sentencepiece model's), of any length. A word's probability
in a language is the sum over all its segmentations into pieces of the product of the pieces' probabilities,
by the forward algorithm; a text's is the product over its words. Piece probabilities are expected
counts: a forward-backward pass under equal piece weights over every word of every learned document,
summed by language and piece. Both passes are numpy over many words of one length at once; words above
LONG letters go one by one, scaled at every letter, so that a product of any length stays a number.

Learned from: non-null languages of documents that `train` selects; the model, a row for each language and piece, is
held by the driver and every task. Defined cases: null text or a text without a letter is `und` with score 0; so is
every text if nothing was learned (from an empty table, too); unknown characters cost the same in every language;
ties go to the smaller language name; repeated rows are learned from each and get equal answers; long texts are
scored KEPT_CHUNKS blank-separated chunks at a time; a row with a null doc_id is scored and not learned from; only
the columns named are read, so no other can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import frugal, id_and_text, rows_out, slices

LONG = 24
MARK = "▁"
SMOOTH = 0.1
UNKNOWN = 1e-7
#: Chunks that a worker keeps scores of, and counts before it turns them into piece counts.
KEPT_CHUNKS = 300_000
FLUSH_CHUNKS = 150_000
SLOT_BITS = 22
BASE = np.uint64(0x9E3779B97F4A7C15)
EVERY = slice(None)


class Pieces:
    """Numbers of the vocabulary's pieces, found by a hash of their characters; beginnings of pieces are known too."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.pieces = sorted(p for p in found if p and all(c.isalpha() or c == MARK for c in p))
        self.longest = max(map(len, self.pieces), default=1)
        hashes: dict[str, int] = {"": 0}
        for p in self.pieces:
            for n in range(1, len(p) + 1):
                if p[:n] not in hashes:
                    hashes[p[:n]] = int(self.step(np.array([hashes[p[: n - 1]]], np.uint64), np.array([ord(p[n - 1])], np.uint64))[0])
        del hashes[""]
        number = {p: i for i, p in enumerate(self.pieces)}
        names = np.fromiter(hashes.values(), np.uint64, len(hashes))
        self.names = np.append(names, np.uint64(0))  # of all beginnings; the last one stands for none
        self.piece = np.array([number.get(x, -1) for x in hashes] + [-1], np.int64)
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)
        at = names >> np.uint64(64 - SLOT_BITS)
        self.slot[at] = np.arange(len(names))
        self.spilled = np.flatnonzero(self.slot[at] != np.arange(len(names)))  # names whose slot another one took
        self.spilled = self.spilled[np.argsort(names[self.spilled])]

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The hash of a string and one more character."""
        h = (h + c) * BASE
        return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The beginning that has a hash; -1 for none."""
        i = self.slot[h >> np.uint64(64 - SLOT_BITS)]
        other = self.names[i] != h
        taken = np.flatnonzero(other & (i >= 0))
        i[other] = -1
        if len(taken) and len(self.spilled):
            own = self.names[self.spilled]
            at = np.minimum(np.searchsorted(own, h[taken]), len(own) - 1)
            i[taken] = np.where(own[at] == h[taken], self.spilled[at], -1)
        return i

    def lattice(self, codes: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(start, length): the words that have a piece there, and the piece; len(pieces) for a character without one."""
        n, width = codes.shape
        out, all_ = {}, np.arange(n)
        for at in range(width):
            rows, h = all_, np.zeros(n, np.uint64)
            for size in range(1, min(self.longest, width - at) + 1):
                h = self.step(h, codes[:, at + size - 1] if rows is all_ else codes[rows, at + size - 1])
                i = self.find(h)
                piece = self.piece[i]
                if size == 1:
                    out[at, 1] = EVERY, np.where(piece < 0, len(self.pieces), piece)
                else:
                    good = np.flatnonzero(piece >= 0)
                    if len(good):
                        out[at, size] = rows[good], piece[good]
                alive = np.flatnonzero(i >= 0)
                if not len(alive):
                    break
                if len(alive) < len(rows):
                    rows, h = rows[alive], h[alive]
        return out

    def along(self, codes: np.ndarray) -> np.ndarray:
        """For one long word: [start, length - 1] the piece, len(pieces) for a character without one, -1 for none."""
        out = np.full((len(codes), self.longest), -1, np.int64)
        rows, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for size in range(1, self.longest + 1):
            inside = rows + size <= len(codes)
            rows, h = rows[inside], h[inside]
            h = self.step(h, codes[rows + size - 1])
            i = self.find(h)
            out[rows, size - 1] = self.piece[i]
            rows, h = rows[i >= 0], h[i >= 0]
        out[:, 0] = np.where(out[:, 0] < 0, len(self.pieces), out[:, 0])
        return out


def coded(word: str) -> np.ndarray:
    """The characters of a word with the mark in front."""
    return np.array([ord(MARK), *map(ord, word)], np.uint64)


def long_sums(piece: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over the segmentations of each prefix of a long word, by language."""
    n, longest = piece.shape
    logs = np.zeros((n + 1, weights.shape[1]))
    for end in range(1, n + 1):
        sizes = np.arange(1, min(longest, end) + 1)
        found = piece[end - sizes, sizes - 1]
        sizes, found = sizes[found >= 0], found[found >= 0]
        # relative to the prefix before, whose logarithm is kept apart
        logs[end] = logs[end - 1] + np.log((weights[found] * np.exp(logs[end - sizes] - logs[end - 1])).sum(axis=0))
    return logs


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their character codes with the mark in front."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for part in np.array_split(at, len(at) // 20_000 + 1):
            codes = np.array([words[i] for i in part], f"U{n}").view(np.uint32).reshape(len(part), n)
            yield part, np.concatenate([np.full((len(part), 1), ord(MARK), np.uint64), codes.astype(np.uint64)], axis=1)


def forward(lattice: dict, weights: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    """Sums over the segmentations of each prefix of n words; weights[piece] a row for each language."""
    out = [np.ones((n, weights.shape[1])), *(np.zeros((n, weights.shape[1])) for _ in range(width))]
    for (start, size), (rows, piece) in lattice.items():  # in order of the starts
        out[start + size][rows] += out[start][rows] * weights[piece]
    return out


def backward(lattice: dict, weights: np.ndarray, n: int, width: int) -> list[np.ndarray]:
    """Sums over the segmentations of what follows each prefix."""
    out = [*(np.zeros((n, weights.shape[1])) for _ in range(width)), np.ones((n, weights.shape[1]))]
    for (start, size), (rows, piece) in reversed(lattice.items()):
        out[start][rows] += weights[piece] * out[start + size][rows]
    return out


def long_log(pieces: Pieces, word: str, weights: np.ndarray) -> np.ndarray:
    """The logarithm of a long word's probability in each language."""
    return long_sums(pieces.along(coded(word)), weights)[-1]


def expected(pieces: Pieces, words: list[str], counts: np.ndarray) -> np.ndarray:
    """counts[word, language] to expected piece counts[piece, language] under equal weights."""
    n = len(pieces.pieces)
    weights = np.concatenate([np.full(n, 1.0 / max(n, 1)), [UNKNOWN]])[:, None]
    total = np.zeros((n + 1, counts.shape[1]))

    def add(piece: np.ndarray, share: np.ndarray, own: np.ndarray) -> None:
        for g in range(counts.shape[1]):
            total[:, g] += np.bincount(piece, share * own[:, g], n + 1)

    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for at, codes in by_length([words[i] for i in short]):
        at, (m, width) = np.array(short)[at], codes.shape
        lattice = pieces.lattice(codes)
        ahead, behind = forward(lattice, weights, m, width), backward(lattice, weights, m, width)
        shares = [(ahead[start][rows] * weights[piece] * behind[start + size][rows] / ahead[width][rows])[:, 0] for (start, size), (rows, piece) in lattice.items()]
        add(np.concatenate([p for _, p in lattice.values()]), np.concatenate(shares), counts[np.concatenate([at[rows] for rows, _ in lattice.values()])])
    for i in set(range(len(words))).difference(short):
        piece = pieces.along(coded(words[i]))
        # what follows a prefix is what precedes in the word read backwards
        turned = np.full(piece.shape, -1, np.int64)
        start, size = np.nonzero(piece >= 0)
        turned[len(piece) - start - size - 1, size] = piece[start, size]
        ahead, behind = long_sums(piece, weights)[:, 0], long_sums(turned, weights)[::-1, 0]
        share = np.exp(ahead[start] + np.log(weights[piece[start, size], 0]) + behind[start + size + 1] - ahead[-1])
        add(piece[start, size], share, np.broadcast_to(counts[i], (len(start), counts.shape[1])))
    return total[:n]


def words_of(chunk: str) -> list[str]:
    """Lower-cased runs of letters."""
    low = chunk.lower()
    if low.isalpha():
        return [low]
    if low[:-1].isalpha():
        return [low[:-1]]
    return "".join([c if c.isalpha() else " " for c in low]).split()


_pieces: dict[str, Pieces] = {}


def pieces_at(path: str) -> Pieces:
    """Read once in a process."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def learn(docs: DataFrame, train: Column, path: str, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages, and log-free piece probabilities [piece, language]; one pass over all learned documents.

    What comes back is a row for each language and piece of the vocabulary at most.
    """
    kept = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_at(path)
        seen: dict[str, Counter] = {}  # by language, blank-separated chunks

        def flush() -> Iterator[pa.RecordBatch]:
            number: dict[str, int] = {}
            found = [[(number.setdefault(w, len(number)), n) for chunk, n in c.items() for w in words_of(chunk)] for c in seen.values()]
            counts = np.zeros((len(number), len(seen)))
            for g, pairs in enumerate(found):
                if pairs:
                    at, n = np.array(pairs).T
                    counts[:, g] = np.bincount(at, n, len(number))
            total = expected(pieces, list(number), counts)
            for g, name in enumerate(seen):
                at = np.flatnonzero(total[:, g])
                yield rows_out(lang=([name] * (len(at) + 1), pa.string()), piece=([-1, *at], pa.int64()), n=([0.0, *total[at, g]], pa.float64()))

        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, seen.values())) > FLUSH_CHUNKS:
                yield from flush()
                seen.clear()
        yield from flush()

    rows = kept.mapInArrow(run, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.full((len(pieces_at(path).pieces), len(langs)), SMOOTH)
    at = {x: i for i, x in enumerate(langs)}
    for lang, piece, n in rows:
        if piece >= 0:
            counts[piece, at[lang]] += round(n, 3)  # sums of floats depend on their order
    return langs, counts / counts.sum(axis=0, keepdims=True) if langs else counts


class Scorer(dict):
    """Blank-separated chunk to the row of its words' summed log probabilities; row 0 is for no letter. New words are scored together. Bounded."""

    def __init__(self, pieces: Pieces, probability: np.ndarray):
        self.pieces, k = pieces, probability.shape[1]
        self.weights = np.concatenate([probability, np.full((1, k), UNKNOWN)])
        self.words: dict[str, int] = {}
        self.rows = np.zeros((1, k))

    def add(self, chunks: set[str]) -> None:
        """Makes sure that all of chunks have a row."""
        if len(self) + len(chunks) > KEPT_CHUNKS:
            self.clear()
            self.words.clear()
            self.rows = self.rows[:1]
        new = chunks.difference(self)
        plain, several = [], []  # chunks of one word, which are most, and others
        for c in new:
            low = c.lower()
            if low.isalpha():
                plain.append((c, low))
            elif low[:-1].isalpha():
                plain.append((c, low[:-1]))
            else:
                several.append((c, words_of(c)))
        known = self.words
        words = {w for _, w in plain}
        words.update(*(x for _, x in several))
        words = list(words.difference(known))
        found = np.empty((len(words), self.weights.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for at, codes in by_length([words[i] for i in short]):
            found[np.array(short)[at]] = np.log(forward(self.pieces.lattice(codes), self.weights, *codes.shape)[-1])
        for i in set(range(len(words))).difference(short):
            found[i] = long_log(self.pieces, words[i], self.weights)
        known.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.update([(c, known[w]) for c, w in plain])
        rows, more = np.concatenate([self.rows, found]), []
        for c, x in several:
            if len(x) > 1:
                self[c] = len(rows) + len(more)
                more.append(rows[[known[w] for w in x]].sum(axis=0))
            else:
                self[c] = known[x[0]] if x else 0
        self.rows = np.concatenate([rows, more]) if more else rows

    def score(self, chunks: list[str]) -> np.ndarray | None:
        at = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        return self.rows[at].sum(axis=0) if at.any() else None

    def scores(self, texts: list[str]) -> list[np.ndarray | None]:
        found = [x.split() for x in texts]
        needed = set().union(*found)
        if len(needed) <= KEPT_CHUNKS:
            self.add(needed)
            return [self.score(x) for x in found]
        out = []
        for x in found:  # very many chunks: by parts of a text
            total = None
            for i in range(0, len(x), KEPT_CHUNKS):
                part = x[i : i + KEPT_CHUNKS]
                self.add(set(part))
                value = self.score(part)
                total = value if total is None else total if value is None else total + value
            out.append(total)
        return out


def predict(docs: DataFrame, langs: list[str], probability: np.ndarray, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the posterior under equal priors) for each row of docs."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pieces_at(path), probability)
        for part in slices(batches, 1024):
            names, values = [], []
            for x in scorer.scores(part.column(1).to_pylist()) if langs else [None] * part.num_rows:
                if x is None:
                    names.append("und")
                    values.append(0.0)
                else:
                    best = int(np.argmax(x))
                    names.append(langs[best])
                    values.append(float(1 / np.exp(np.maximum(x - x[best], -700)).sum()))
            yield rows_out(doc_id=(part.column(0), pa.int64()), lang_pred=(names, pa.string()), score=(values, pa.float64()))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
