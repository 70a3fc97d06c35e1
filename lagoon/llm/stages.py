"""Pipeline stages over a documents table: the operators' decisions applied to its rows.

All but the last give back rows of the table they get, with the same columns, whatever other columns there are.

Defined cases. Null texts are empty: they are not toxic, fail the quality rules, and are near copies of each other.
Rows with a null doc_id are scored and judged like any other, but they are copies of nothing and keep all words. Of
rows that share a doc_id one stays after the near-copy stage, the one whose text has the smallest hash; before it,
repeated rows are judged alike. Ties go to the smaller doc_id. Very long texts are worked on whole, as the operators
say. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.llm import nearcopies, packing, quality, rlz, toxicity
from lagoon.llm.common import cut_lineage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; learned from the documents at hand and the labels table."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each class; of rows that repeat it, one. Rows with a null doc_id stay."""
    found = cut_lineage(nearcopies.classes(docs))
    extra = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies"), F.max(F.expr("int(doc_id = component_id)")).alias("chosen"))
    told = cut_lineage(extra.where("chosen = 0 or copies > 1"))
    name = "_" + "_".join(docs.columns)  # clashes with no column
    gone = told.select(F.col("doc_id").alias(name))
    once = docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
    repeated = told.where("chosen = 1 and copies > 1").select(F.col("doc_id").alias(name))
    if repeated.isEmpty():  # else the texts need not be read and dealt a second time
        return once
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    several = docs.join(repeated, docs["doc_id"].cast("long") == repeated[name])
    one = several.withColumn(f"{name}_n", F.row_number().over(first)).where(F.col(f"{name}_n") == 1)
    return once.union(one.select(*(F.col(f"`{c}`") for c in docs.columns)))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that rlz removes; untouched texts stay as they are, and texts left without words go."""
    found = rlz.duplicate_spans(docs)
    touched = F.size("starts") > 0
    kept = found.where(~touched | (F.length("kept") > 0))
    text = F.when(touched, F.col("kept")).otherwise(F.col("text"))
    value = {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(touched, F.length("kept")).otherwise(F.col("row.n_chars"))
    return kept.select(*(value.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
