"""The corpus pipeline: documents to packed training sequences, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lagoon.llm import stages
from lagoon.llm.common import remove, shared_folder, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("quality", stages.drop_poor),
    ("near_dedup", stages.drop_near_copies),
    ("substring_dedup", stages.drop_repeats),
    ("packing", stages.pack),
]

#: The toxicity scores have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder as Parquet and read again; only the last one stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
