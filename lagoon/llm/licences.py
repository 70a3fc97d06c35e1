"""Licence scan by a positional rare-token index.

Templates are short word sequences of well-known licence notices. First the document frequency of every
template word is counted over all documents. Each template is then indexed under its rarest words
(highest IDF; ties to the earlier place), with their places in it. A file's words are looked up in that
index, and the postings of a template's words are intersected by relative position (place in the file minus
place in the template): only starts that AGREE of its indexed words point to at once (all of them, if it has
fewer) are candidates. A candidate counts if its mandatory key phrase is complete and enough of the template's
IDF weight is in place; its score is that share. A base phrase is a template that is all key phrase, and all
its words must point to one start, so every place where it stands is found.

Defined cases: null text is empty; no words give 0, no labels and score 0; repeated rows get equal answers and
each counts as a document; equal scores of several notices are one score; long texts need memory in proportion
to their own length; only the id and the text are read, so no other column can clash; an empty table gives an
empty result (the IDF of no documents is the same for all words).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import as_bytes, frugal, id_and_text, rows_out, slices

#: Phrases and their labels, as the contract of the query gives them.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Fixed values: (label, notice, mandatory key phrase in it); words of public licence notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software"),
    ("gpl-2", "gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", "waived all copyright"),
]
#: Rarest words of a notice that are indexed, how many of them must agree on its place, and the share of its IDF weight that must be in place.
INDEXED_WORDS, AGREE = 4, 2
MIN_SHARE = 0.6

#: Bytes that end a word become spaces; A-Z become a-z.
SEPARATED = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(SEPARATED).split()


def templates() -> list[tuple[str, list[bytes], list[int], bool]]:
    """(label, words, places of the key phrase, whether it is a base phrase)."""
    out = []
    for label, notice, key, base in [*((b, p, p, True) for p, b in BASE_PHRASES.items()), *((*x, False) for x in TEMPLATES)]:
        words, must = notice.encode().split(), key.encode().split()
        at = next(i for i in range(len(words)) if words[i : i + len(must)] == must)
        out.append((label, words, list(range(at, at + len(must))), base))
    return out


class Index:
    """Postings by rare word: (template, place)."""

    def __init__(self, documents: int, frequency: dict[bytes, int]):
        self.templates = templates()
        self.idf = {w: math.log(1 + (documents + 1) / (frequency.get(w, 0) + 0.5)) for _, words, _, _ in self.templates for w in words}
        self.weight = [sum(self.idf[w] for w in words) for _, words, _, _ in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.agree: list[int] = []
        for t, (_, words, key, base) in enumerate(self.templates):
            rare = sorted(key if base else range(len(words)), key=lambda p: (-self.idf[words[p]], p))
            rare = rare if base else rare[:INDEXED_WORDS]
            self.agree.append(len(rare) if base else min(AGREE, len(rare)))
            for p in rare:
                self.postings[words[p]].append((t, p))
        self.postings = dict(self.postings)

    def candidates(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) of all starts that enough indexed words of the template point to."""
        pointed: dict[tuple[int, int], int] = defaultdict(int)
        if not self.postings.keys().isdisjoint(words):
            for at, word in enumerate(words):
                for t, p in self.postings.get(word, ()):
                    pointed[t, at - p] += 1
        return [(t, start) for (t, start), n in pointed.items() if n >= self.agree[t]]

    def scan(self, words: list[bytes]) -> dict:
        base_at, base_labels, labels, score = set(), set(), set(), 0.0
        for t, start in self.candidates(words):
            label, notice, key, base = self.templates[t]
            if not all(0 <= start + p < len(words) and words[start + p] == notice[p] for p in key):
                continue
            if base:
                base_at.add((t, start))
                base_labels.add(label)
                score = 1.0
                continue
            found = sum(self.idf[w] for p, w in enumerate(notice) if 0 <= start + p < len(words) and words[start + p] == w)
            if found >= MIN_SHARE * self.weight[t]:
                labels.add(label)
                score = max(score, min(1.0, found / self.weight[t]))
        places = [x for _, x in base_at]
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels | base_labels)), "score": score,
        }


@frugal
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = {w for _, words, _, _ in templates() for w in words}
    total, found = 0, defaultdict(int)
    for part in slices(batches):
        for text in as_bytes(part.column(0)):
            total += 1
            for w in known.intersection(words_of(text)):
                found[w] += 1
    yield rows_out(word=([None, *(w.decode() for w in found)], pa.string()), n=([total, *found.values()], pa.int64()))


def build_index(docs: DataFrame, text_col: str = "text") -> Index:
    """The index of the fixed templates under word counts of all documents (a row for each template word at most)."""
    rows = id_and_text(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))).select("text").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return Index(counts.pop(None, 0), {w.encode(): n for w, n in counts.items()})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of SCHEMA for each row of docs."""
    index = build_index(docs, text_col)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        for part in slices(batches):
            found = [index.scan(words_of(x)) for x in as_bytes(part.column(1))]
            yield rows_out(doc_id=(part.column(0), pa.int64()), **{k: ([x[k] for x in found], kinds.get(k, pa.int64())) for k in found[0]})

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
