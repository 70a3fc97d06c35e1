"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow kernel turns into Python objects at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where none is set, a temporary one, but only if there are no executors on other machines."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lagoon-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder (a checkpoint) and go on from there.

    A checkpoint inherits the size that was estimated for df, a product over all joins since the tables. Over rounds of
    joins such a number gets so many digits that planning takes minutes, so the result starts without one.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().analyzed().rdd(), done.schema(), False), spark)


def forget(*frames: DataFrame) -> None:
    """Delete the files that cut_lineage wrote for frames that nothing will read again."""
    for df in frames:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            remove(df.sparkSession, file.get())


def share_of_rows(column: Column, count: int, rows: int) -> Column:
    """Whether a value is among the about `rows` of `count` values whose hashes are smallest: a sample that needs no sort."""
    parts = 1 << 30
    return F.pmod(F.xxhash64(column), F.lit(parts)) < max(1, min(parts, rows * parts // max(count, 1)))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, so no other column can clash. A null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Small pieces of each batch: bounds what is held as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string, without decoding; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def rows_out(**columns) -> pa.RecordBatch:
    """A batch from name=(values, type)."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def crc_bucket(column: str, buckets: int):
    """crc32 of a number's decimal text, modulo buckets; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b), both long and not null: rows (node, root), root the smallest node reachable.

    Hook and contract over hashed names (a bijection of 64 bits, so that runs of ascending ids make no
    long chains): each round points every name to its smallest neighbour, follows the pointers once more and
    relabels the edges. All state stays in DataFrames that are cut each round, and a cut plan carries no
    partitioning, so every later join has plain exchanges below it, whose hot roots AQE can split.
    """

    def ordered(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    given = cut_lineage(edges.where("a <> b").select("a", "b").distinct())
    label = given.select(F.col("a").alias("node")).union(given.select("b")).distinct().select("node", F.xxhash64("node").alias("root"))
    edges = given.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    rounds = 0
    while not edges.isEmpty():
        both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up")).union(edges.select(F.least("a", "b"), F.least("a", "b")))
        near = cut_lineage(both.groupBy("node").agg(F.min("up").alias("up")))
        far = near.select(F.col("node").alias("up"), F.col("up").alias("far"))
        up = cut_lineage(near.join(far, "up", "left").select("node", F.coalesce("far", "up").alias("up")))
        left = up.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges, last = cut_lineage(ordered(edges.join(left, "a").join(right, "b").where("ra <> rb"), "ra", "rb")), edges
        step = up.select(F.col("node").alias("root"), F.col("up").alias("new"))
        label, rounds = label.join(step, "root", "left").select("node", F.coalesce("new", "root").alias("root")), rounds + 1
        if rounds % 3 == 0:
            label = cut_lineage(label)
        forget(near, *([last] if rounds > 1 else []))
    label = cut_lineage(label)
    least = cut_lineage(label.groupBy("root").agg(F.min("node").alias("least")))
    return label.join(least, "root").select("node", F.col("least").alias("root"))


#: Powers that a process keeps; longer tables are made anew for each text.
KEPT_POWERS = 1 << 18


def powers(base: int, n: int, _kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i < n; base is odd. Kept in the process up to KEPT_POWERS, grown by doubling."""
    found = _kept.get(base)
    if found is None or len(found[0]) < n:
        size = max(1 << 12, 1 << int(n).bit_length())
        inverse = pow(base, -1, 1 << 64)
        found = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, inverse))
        if size <= KEPT_POWERS:
            _kept[base] = found
    return found[0][:n], found[1][:n]


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rolling polynomial hash modulo 2**64 of every `width` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(base, len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    return mixed((total[width:] - total[:n]) * down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that high and low bits are equally random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def frugal(kernel: Callable) -> Callable:
    """An Arrow kernel whose process gives freed memory back to the system at the end of each task: Spark keeps idle workers, and allocators keep what they have freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)
