"""Mixture-controlled packing: deficit round-robin over source queues into windows of target token proportions.

Each source is a queue of documents. Its target share is its weight among the queues that still have tokens, if
`weights` are given, or else its share of all tokens, so that the queues run dry together; sources that `weights`
lacks follow when the others are dry. Windows of WINDOW_SEQUENCES sequences are filled one after the other. In a
window each queue is owed its share of the tokens so far (its deficit); whole tokens are served in the order in
which they fall due (ties to the smaller queue name), and what is owed or overdrawn is carried to the next window.
Since a queue's total by the end of window w is fixed by w, the weights and the token totals alone (served()), the
carry needs no scan over windows: each task works out, for its own documents, the windows that they reach, whatever
partition the windows before were packed in. Within a window, sources follow each other and sequences are cut at
every SEQUENCE tokens, so only the last sequence of all can have padding.

A source that is due less than one token of a window has no proportion there to hold; such sources share TAILS
queues by hash, one after the other. All others, at most as many as a window has tokens, have a queue each.

Documents are tokenised once; ids are kept in the shared folder. A document's place in its queue is its
partition's start plus its place in the partition.

Ids are those of the tokenizer's plain call on a whole text, so the name of a special token in a text is that
token. Defined cases: null text is empty and packs its end token alone; a null source is a source of its own;
repeated rows are packed each; long texts need memory in proportion to their own length; only the columns named are
read, so no other can clash; equal input files give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.llm.common import cut_lineage, frugal, give_back, slices

SEQUENCE = 4096
WINDOW_SEQUENCES = 16
TAILS = 64
END = 2
#: Blank-separated chunks, and words of them, that a worker keeps the ids of.
KEPT_CHUNKS, KEPT_WORDS = 150_000, 150_000
#: Whole chunks of printable Latin letters, digits and signs: normal forms and case are plain there.
LATIN = re.compile("[!-~\u00a1-\u024f]+").fullmatch
#: Rows of (partition, queue) starts that may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string"


class Tokens(dict):
    """Ids of blank-separated chunks as little-endian 16- or 32-bit bytes; bounded.

    The tokenizer drops white space and matches no pre-token across it, so chunks encode on their own.
    Latin chunks go to a bare merge engine: lower-cased, cut by the tokenizer's own pattern, and merged by
    ranks that are its merge list, with a last byte 0xFF (in no UTF-8 text) for the end of a word. All other
    chunks go through the tokenizer, and so do whole texts that may hold the name of a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind, self.code = ("<u2", "H") if self.model.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.end = array(self.code, [END]).tobytes()
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            table = json.load(f)
        self.marks = [x["content"].lower() for x in table.get("added_tokens", [])]
        self.hints = {m[:2] if not any(map(str.isalpha, m[:2])) else "" for m in self.marks}
        self.pattern = self.ids = None
        self._bare_engine(table)
        give_back()  # what reading the table took

    def marked(self, text: str) -> bool:
        """Whether a text may hold the name of a special token, in any case."""
        if not any(h in text for h in self.hints):
            return False
        low = text.lower()
        return any(m in low for m in self.marks)

    def _bare_engine(self, table: dict) -> None:
        """Only for the layout that it is right for: NFC, blanks, lower case; one Split; byte level; a word-end suffix."""
        steps = [x["type"] for x in (table.get("normalizer") or {}).get("normalizers", [])]
        cuts = (table.get("pre_tokenizer") or {}).get("pretokenizers", [])
        suffix, vocab = table["model"].get("end_of_word_suffix"), table["model"].get("vocab", {})
        if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or not suffix or cuts[1].get("add_prefix_space"):
            return
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte level's printable names
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        raw = lambda t: bytes(byte[c] for c in t.removesuffix(suffix)) + b"\xff" * t.endswith(suffix)
        merges = [m.split(" ") if isinstance(m, str) else m for m in table["model"]["merges"]]
        order = [bytes([b]) for b in range(256)] + [bytes([b, 255]) for b in range(256) if b != 255]
        order += [raw("".join(m)) for m in merges]
        if len(set(order)) != len(order):
            return
        import tiktoken

        names = {raw(t): i for t, i in vocab.items() if all(c in byte for c in t.removesuffix(suffix))}
        self.ids = [names.get(t, -1) for t in order]
        self.merge = tiktoken.Encoding("merges", pat_str=r".+", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})._core_bpe.encode_single_piece
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            ids = self.ids
            self.words[word] = found = array(self.code, [ids[i] for i in self.merge(word.encode() + b"\xff")]).tobytes()
        return found

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= KEPT_CHUNKS:
            self.clear()
        if self.pattern is not None and LATIN(chunk):
            low = chunk.lower()
            if low.isalpha():
                found = self._word(low)
            elif low[-1] in ".," and low[:-1].isalpha():
                found = self._word(low[:-1]) + self._word(low[-1])
            else:
                found = b"".join(map(self._word, self.pattern.findall(low)))
        else:
            found = self.plain(chunk)
        self[chunk] = found
        return found

    def plain(self, text: str) -> bytes:
        return array(self.code, self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [(self.plain(x) if self.marked(x) else b"".join(map(self.__getitem__, x.replace("\n", " ").replace("\t", " ").split(" ")))) + self.end for x in texts]


@lru_cache(1)
def tokens(path: str) -> Tokens:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(path)


def served(totals: list[int], due: int, weights: list[int] | None = None) -> list[int]:
    """Tokens that each queue has given when `due` tokens were given in all.

    Token t of a queue of weight w (its total, unless given) falls due at (t + 1) / w; the earliest go first, ties to
    the smaller queue. Queues of weight 0 follow when the others are dry, by their totals. Exact in integers, and never
    less than for a smaller `due`.
    """
    natural = weights is None
    weights = totals if natural else weights
    timed = sum(n for n, w in zip(totals, weights, strict=True) if w)
    if due >= timed:
        rest = [0 if w else n for n, w in zip(totals, weights, strict=True)]
        late = served(rest, due - timed) if not natural and any(rest) else [0] * len(rest)
        return [n if w else x for n, w, x in zip(totals, weights, late, strict=True)]
    dry: set[int] = set()
    if not natural:
        ends = sorted({Fraction(n, w) for n, w in zip(totals, weights, strict=True) if w})
        low, high = 0, len(ends)  # so many of the times at which a queue runs dry have passed
        while low < high:
            middle = (low + high) // 2
            at = ends[middle]
            if sum(min(n, w * at.numerator // at.denominator) for n, w in zip(totals, weights, strict=True) if w) <= due:
                low = middle + 1
            else:
                high = middle
        dry = {q for q, (n, w) in enumerate(zip(totals, weights, strict=True)) if w and low and Fraction(n, w) <= ends[low - 1]}
    left = due - sum(totals[q] for q in dry)
    whole = sum(w for q, w in enumerate(weights) if q not in dry)
    out = [totals[q] if q in dry else min(totals[q], left * w // whole) for q, w in enumerate(weights)]
    left = due - sum(out)
    if left:
        heap = [(_Due(out[q] + 1, w), q) for q, w in enumerate(weights) if w and out[q] < totals[q]]
        heapq.heapify(heap)
        for _ in range(left):
            _, q = heap[0]
            out[q] += 1
            if out[q] < totals[q]:
                heapq.heapreplace(heap, (_Due(out[q] + 1, weights[q]), q))
            else:
                heapq.heappop(heap)
    return out


class _Due:
    """A fraction that compares exactly."""

    __slots__ = ("a", "b")

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b

    def __lt__(self, other) -> bool:
        return self.a * other.b < other.a * self.b

    def __eq__(self, other) -> bool:
        return self.a * other.b == other.a * self.b


class Plan:
    """Where a queue's tokens lie, window by window."""

    def __init__(self, totals: list[int], sequence: int, window: int, weights: list[int] | None = None):
        self.totals, self.weights, self.sequence, self.size = totals, weights, sequence, sequence * window
        self.whole = sum(totals)
        self.kept: dict[int, tuple[list[int], list[int]]] = {}
        self.last: dict[int, int] = {}

    def at(self, w: int) -> list[int]:
        """Tokens given before window w."""
        return self.window(w)[0]

    def window(self, w: int) -> tuple[list[int], list[int]]:
        """Tokens given before window w, and where each queue begins in it."""
        if w not in self.kept:
            if len(self.kept) > 64:
                self.kept.clear()
            before, after = (served(self.totals, x * self.size, self.weights) for x in (w, w + 1))
            self.kept[w] = before, [0, *np.cumsum(np.subtract(after, before)).tolist()]
        return self.kept[w]

    def first(self, queue: int, start: int) -> int:
        """A window up to the one that holds the queue's token at start: the last one asked for, or else by halving."""
        w = self.last.get(queue)
        if w is None or self.at(w)[queue] > start:
            w, high = 0, self.whole // self.size + 1
            while high - w > 1:
                middle = (w + high) // 2
                w, high = (middle, high) if served(self.totals, middle * self.size, self.weights)[queue] <= start else (w, middle)
        return w

    def pieces(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(offset in the span, length, sequence_id, offset in the sequence) of the queue's tokens from start."""
        w, done = self.first(queue, start), 0
        while done < length:
            while self.at(w + 1)[queue] <= start + done:
                w += 1
            before, inner = self.window(w)
            until = min(length, before[queue] + inner[queue + 1] - inner[queue] - start)
            place = w * self.size + inner[queue] + start + done - before[queue]
            while done < until:
                n = min(until - done, self.sequence - place % self.sequence)
                yield done, n, place // self.sequence, place % self.sequence
                done, place = done + n, place + n
        self.last[queue] = w


def queue_of(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def whole_weights(weights: dict, queues: list[str]) -> list[int]:
    """Weights of queues in whole numbers of the same proportions; 0 for queues without one."""
    named = {("null" if k is None else f"={k}"): Fraction(v).limit_denominator(1_000_000) for k, v in weights.items()}
    if any(v <= 0 for v in named.values()):
        raise ValueError("weights must be above 0")
    scale = math.lcm(*(v.denominator for v in named.values()))
    return [int(named.get(q, 0) * scale) for q in queues]


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, queue (one for each source), part, start (in its queue within its partition), n, ids: kept in the shared folder."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part_id, given = tokens(path), TaskContext.get().partitionId(), {}
        size = np.dtype(known.kind).itemsize
        for part in slices(batches):
            ids = known.encode(part.column("text").to_pylist())
            counts, starts = [len(x) // size for x in ids], []
            for q, n in zip(part.column("queue").to_pylist(), counts, strict=True):
                starts.append(given.get(q, 0))
                given[q] = starts[-1] + n
            yield pa.RecordBatch.from_arrays(
                [*(part.column(x) for x in ("doc_id", "source", "queue")), pa.array([part_id] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "queue", "part", "start", "n", "ids"],
            )

    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), queue_of(source).alias("queue"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return cut_lineage(rows.mapInArrow(run, "doc_id long, source string, queue string, part int, start long, n long, ids binary"))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", sequence: int = SEQUENCE, window: int = WINDOW_SEQUENCES, weights: dict | None = None) -> DataFrame:
    """The pieces (PIECES) of all documents; ids little-endian 32-bit. weights: target shares by source (None for null), in any unit."""
    known = tokenised(docs, path, id_col, text_col, source_col)
    sums = cut_lineage(known.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    whole = sums.agg(F.sum("n")).first()[0] or 0
    # a source that is due a token of each window has its own queue: no more than a window has tokens (and those that weights name)
    own = F.col("total") >= -(-whole // (sequence * window))
    named = [("null" if k is None else f"={k}") for k in weights or ()]
    if named:
        own = own | F.col("queue").isin(named)
    shared = F.concat(F.lit("~"), F.pmod(F.xxhash64("queue"), F.lit(TAILS)))
    queues = sums.groupBy("queue").agg(F.sum("n").alias("total")).select("queue", F.when(own, F.col("queue")).otherwise(shared).alias("line"))
    sums = cut_lineage(sums.join(queues, "queue"))
    totals = sorted((r["line"], r["n"]) for r in sums.groupBy("line").agg(F.sum("n").alias("n")).collect())
    names, counts = {q: i for i, (q, _) in enumerate(totals)}, [n for _, n in totals]
    shares = whole_weights(weights, list(names)) if weights else None
    before = Window.partitionBy("line").orderBy("part", "queue").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("queue", "part", "line", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each task and source
    starts = F.broadcast(starts) if sums.count() <= BROADCAST_ROWS else starts

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, kind = Plan(counts, sequence, window, shares), tokens(path).kind
        for part in slices(batches):
            out = []
            for doc, src, q, start, n, ids in zip(*(x.to_pylist() for x in part.columns), strict=True):
                wide = np.frombuffer(ids, kind).astype("<u4")
                for a, length, seq, offset in plan.pieces(names[q], start, n):
                    out.append((doc, a, length, wide[a : a + length].tobytes(), n, seq, offset, src))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            names_out = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names_out)

    placed = known.join(starts, ["queue", "part"]).select("doc_id", "source", "line", (F.col("base") + F.col("start")).alias("start"), "n", "ids")
    return placed.mapInArrow(run, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            crc = pa.array([zlib.crc32(x) for x in part.column("ids").to_pylist()], pa.int64())
            at = part.schema.get_field_index("ids")
            yield pa.RecordBatch.from_arrays([crc if i == at else x for i, x in enumerate(part.columns)], names=[x if x != "ids" else "ids_crc32" for x in part.schema.names])

    return pieces.mapInArrow(run, PIECES.replace("ids binary", "ids_crc32 long"))
