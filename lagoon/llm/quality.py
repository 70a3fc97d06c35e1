"""Quality rules: counts of a text, and how much of it repeats, by rolling hashes of several n-gram lengths.

A text fails the base rule below MIN_WORDS words, or if over half its words stand in a 3-word window
found twice or more. It fails the method's rule if the characters inside repeated n-grams (the first
occurrence not counted) or inside repeated lines exceed a share of all characters in words, or if its
symbols do. The limits are lenient: a page that quotes one of its own lines stays.

Defined cases: null text has no words and fails; repeated rows get equal answers; of equal n-grams or lines the
first is no repetition; a share that equals its limit passes; long texts need memory in proportion to their own
length; only the id and the text are read (keep_good gives back whole rows), so no other column can clash; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lagoon.llm.common import as_bytes, frugal, id_and_text, mixed, rows_out, slices, window_hashes

MIN_WORDS = 50
#: n-gram length in words: largest share of characters inside repeated ones.
NGRAM_LIMITS = {5: 0.30, 7: 0.28, 10: 0.25}
LINE_LIMIT = 0.30
#: Symbols for each word.
SYMBOL_LIMIT = 0.2
SPACES, SYMBOLS, CONTINUED = b" \t\n\r\x0b\x0c", b"#*$%&|<>", bytes(range(0x80, 0xC0))
BASE = 0x9E3779B97F4A7C15

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, coverage double, line_coverage double, base_failed boolean, kept boolean"


def covered(flags: np.ndarray, width: int) -> np.ndarray:
    """Words inside the flagged windows of `width` words."""
    step = np.zeros(len(flags) + width, np.int64)
    step[: len(flags)] += flags
    step[width:] -= flags
    return np.cumsum(step)[:-1] > 0


def repeats(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose value occurs again: all of them, and all but each value's first."""
    order = np.argsort(names, kind="stable")
    equal = np.flatnonzero(names[order[1:]] == names[order[:-1]])
    later, every = np.zeros(len(names), bool), np.zeros(len(names), bool)
    later[order[equal + 1]] = True
    every[order[equal + 1]] = every[order[equal]] = True
    return every, later


def exact_trigrams(ids: np.ndarray, kinds: int) -> np.ndarray:
    """A number for each 3 consecutive words, equal only for equal words."""
    pair = ids[:-2] * kinds + ids[1:-1]
    if kinds**3 >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    return pair * kinds + ids[2:]


def code_points(data: bytes) -> int:
    return len(data.translate(None, CONTINUED))


def measure(text: bytes) -> dict:
    words, n_chars = text.split(), code_points(text.translate(None, SPACES))
    n, number = len(words), {}
    fresh = count()
    ids = np.fromiter((number[w] if w in number else number.setdefault(w, next(fresh)) for w in words), np.int64, n)
    repeat_words = 0
    if n >= 3:
        every, _ = repeats(exact_trigrams(ids, len(number)))
        repeat_words = int(covered(every, 3).sum())
    lines, seen, dup_lines, dup_chars = text.split(b"\n"), set(), 0, 0
    if len(lines) > 1:
        for line in lines:
            if line.strip():
                if line in seen:
                    dup_lines += 1
                    dup_chars += code_points(line.translate(None, SPACES))
                seen.add(line)
    worst = coverage = 0.0
    if n > min(NGRAM_LIMITS):
        sizes = np.fromiter((code_points(w) for w in number), np.int64, len(number))[ids]
        named = mixed(ids.astype(np.uint64) + np.uint64(1))
        for width, limit in NGRAM_LIMITS.items():
            _, later = repeats(window_hashes(named, width, BASE))
            share = float(sizes[covered(later, width)].sum()) / n_chars if later.any() else 0.0
            worst, coverage = max(worst, share / limit), max(coverage, share)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    line_share = dup_chars / n_chars if n_chars else 0.0
    failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    good = not failed and worst <= 1 and line_share <= LINE_LIMIT and symbols <= SYMBOL_LIMIT * n
    return {
        "n_words": n, "word_chars": n_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
        "coverage": coverage, "line_coverage": line_share, "base_failed": failed, "kept": good,
    }


@frugal
def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"coverage": pa.float64(), "line_coverage": pa.float64(), "base_failed": pa.bool_(), "kept": pa.bool_()}
    for part in slices(batches):
        found = [measure(x) for x in as_bytes(part.column(1))]
        yield rows_out(doc_id=(part.column(0), pa.int64()), **{k: ([x[k] for x in found], kinds.get(k, pa.int64())) for k in found[0]})


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of SCHEMA for each row of docs."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_measures, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that pass both rules."""
    at = docs.columns.index(text_col)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array([measure(x)["kept"] for x in as_bytes(part.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
