"""A small table of documents that holds the awkward cases."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns that an operator might use inside.
CLASHES = {"fp": T.LongType(), "row": T.StringType(), "ids": T.StringType(), "label": T.LongType(), "score": T.DoubleType(), "kept": T.StringType(), "queue": T.StringType()}


def prose(rng: random.Random, words: int, letters: str = "etaoinshrdlu") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(words))


def documents() -> list[tuple]:
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(30)]
    passage = prose(rng, 80)
    texts = [
        None, "", " \n\t ", "one", "two words", "ÄÖ ü ß 漢字 ", "x" * 3000, "\u00a0\u2003no break", "tab\tand\x0bvt\x0c ff \x1c fs",
        *base,
        *base[:5],  # exact copies
        *(x.replace(" e", " E", 2) for x in base[5:10]),
        *(x + " tail" for x in base[10:15]),
        *(prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(6)),  # a shared passage
        passage + " " + passage,
        "\n".join([prose(rng, 12)] * 9),  # repeated lines
        "spam " * 200,
        prose(rng, 30_000),  # very long
        "Licensed under CC BY-NC 4.0. MIT License, mit license; Apache License, Version 2.0",
        "gnu GNU General Public License, version 3.",
        "don't they'll 'tis   \n\n  12345 ###!!! it's",
        "### $$$ *** " * 30,
    ]
    rows = [(i * 7 % 101 + (i > 40) * 200, x, ["en", "de", None][i % 3], ["a", "b", None, "a"][i % 4], len(x or "")) for i, x in enumerate(texts)]
    rows.append((None, base[0], "en", "a", 1))
    rows.append((None, None, None, None, None))
    rows += [rows[12], rows[12]]  # repeated rows
    return rows


def frame(spark, rows=None, clashes=True):
    rows = documents() if rows is None else rows
    schema = T.StructType([*SCHEMA.fields, *([T.StructField(k, v) for k, v in CLASHES.items()] if clashes else [])])
    return spark.createDataFrame([(*r, *([None] * len(CLASHES) if clashes else [])) for r in rows], schema).repartition(3)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
