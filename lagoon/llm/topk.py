"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Rows are packed into blocks, dealt over all tasks once. The queries come in blocks of about QUERY_BLOCK, a size that
is fixed, and each block of them goes to the data in one pass; data are never copied. A block of data keeps a list
for each dimension, sorted by value. Lists are only read in order, from the top for positive weights and from the
bottom for negative ones, a step at a time for all queries that are open: what is read replaces the list's frontier
in a table of upper bounds and the list's last value in one of lower bounds, so a query's bounds for all rows are
products with these tables. A query is done when no row outside its k best can reach its k-th lower bound (nor what
earlier blocks of the task gave); the scores of the rows that are left are then resolved exactly in integers. At the
lists' ends all bounds meet, so what is left there are the k best and their ties.

Each component x becomes floor(SCALE * x), x as double. Defined cases: a null vector, or one with null or
non-finite components, or a row with a null id takes no part; shorter vectors count as 0 beyond their
end; rows that agree in id and vector count once; a query's own row is any row with its id; ties go to the smaller
id; fewer than k candidates give all of them; only the id and the vector are read, so no other column can clash; an
empty table gives an empty result. Scores are exact within 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagoon.llm.common import cut_lineage, frugal, rows_out, slices

SCALE = 256
K = 5
QUERY_EVERY = 50
#: Rows of a packed block, queries of a pass, and queries whose bounds are held at once.
BLOCK_ROWS, QUERY_BLOCK, CHUNK = 2048, 16_384, 512
#: Steps in which the lists are read.
STEPS = 8


def packed(vectors: DataFrame) -> DataFrame:
    """(block, rows, dims, ids, values): vectors(id, v) packed in blocks of BLOCK_ROWS; little-endian 64-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                dims = int(sizes.max(initial=0))
                table = np.zeros((len(sizes), dims), np.int64)
                table[np.arange(dims) < sizes[:, None]] = np.floor(SCALE * lists.flatten().to_numpy()).astype(np.int64)
                block += 1
                yield rows_out(
                    block=([block], pa.int64()), rows=([len(sizes)], pa.int64()), dims=([dims], pa.int64()),
                    ids=([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), values=([table.astype("<i8").tobytes()], pa.binary()),
                )

    return cut_lineage(vectors.mapInArrow(run, "block long, rows long, dims long, ids binary, values binary"))


def unpacked(rows: int, dims: int, ids: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(values, "<i8").reshape(rows, dims)


def widened(x: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, dims - x.shape[1]))))


class Lists:
    """Sorted lists of a block, and the bounds that follow from what was read of them."""

    def __init__(self, values: np.ndarray):
        self.order = np.argsort(-values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=0).astype(np.float64)
        first, last = self.sorted[0], self.sorted[-1]
        # by row and dimension, read from the top: most and least it can be; and from the bottom
        self.top = [np.broadcast_to(x, values.shape).copy() for x in (first, last)]
        self.bottom = [np.broadcast_to(x, values.shape).copy() for x in (first, last)]
        self.unseen_top = np.ones(values.shape, bool)
        self.unseen_bottom = np.ones(values.shape, bool)
        self.depth, self.columns = 0, np.arange(values.shape[1])

    def read(self, depth: int) -> None:
        n = len(self.sorted)
        for bounds, unseen, a, b, frontier, which in ((self.top, self.unseen_top, self.depth, depth, depth - 1, 0), (self.bottom, self.unseen_bottom, n - depth, n - self.depth, n - depth, 1)):
            at = self.order[a:b]
            for table in bounds:
                table[at, self.columns] = self.sorted[a:b]
            unseen[at, self.columns] = False
            # what is not read from the top is at most the frontier there; from the bottom, at least
            edge = np.broadcast_to(self.sorted[frontier], unseen.shape)
            np.copyto(bounds[which], edge, where=unseen)
        self.depth = depth

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bound of each query's score for each row."""
        plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        return plus @ self.top[0].T + minus @ self.bottom[1].T, plus @ self.top[1].T + minus @ self.bottom[0].T


def best(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, at_least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's place, score) of every row that may be among a query's k best, and the steps that each query was open; at_least: scores known to be reached k times."""
    lists, n, open_ = Lists(values), len(ids), np.arange(len(queries))
    found, steps = [], np.zeros(len(queries), np.int64)
    for step in range(1, STEPS + 1):
        lists.read(max(1, -(-step * n // STEPS)))
        done = []
        for at in range(0, len(open_), CHUNK):
            part = open_[at : at + CHUNK]
            upper, lower = lists.bounds(queries[part])
            own = query_ids[part, None] == ids[None, :]
            upper[own] = lower[own] = -np.inf
            reached = np.maximum(at_least[part], np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else -np.inf)
            slack = 1 + 1e-9 * np.abs(reached, where=np.isfinite(reached), out=np.zeros(len(reached)))
            may = (upper >= (reached - slack)[:, None]) & ~own
            ended = (may.sum(axis=1) <= k) | (step == STEPS)
            q, r = np.nonzero(may & ended[:, None])
            found.append((part[q], r))
            done.append(ended)
        steps[open_] = step
        open_ = open_[~np.concatenate(done)] if done else open_
        if not len(open_):
            break
    q, r = (np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i in (0, 1))
    scores = np.empty(len(q), np.int64)
    for at in range(0, len(q), 1 << 16):
        scores[at : at + (1 << 16)] = np.einsum("ij,ij->i", queries[q[at : at + (1 << 16)]], values[r[at : at + (1 << 16)]])
    return q, r, scores, steps


def kept_best(q: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id."""
    order = np.lexsort((vec, -score, q))
    q = q[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def _best(query_ids: np.ndarray, queries: np.ndarray, k: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query among all blocks of a task."""
        q, vec, score = (np.empty(0, np.int64) for _ in range(3))
        for row in (r for part in slices(batches, 1) for r in part.to_pylist()):
            ids, values = unpacked(row["rows"], row["dims"], row["ids"], row["values"])
            dims = max(values.shape[1], queries.shape[1])
            at_least, worst = np.full(len(queries), -np.inf), np.full(len(queries), np.iinfo(np.int64).max)
            counts = np.bincount(q, minlength=len(queries))
            np.minimum.at(worst, q, score)
            at_least[counts >= k] = worst[counts >= k]
            more_q, r, more, _ = best(ids, widened(values, dims), query_ids, widened(queries, dims), k, at_least)
            q, vec, score = np.concatenate([q, more_q]), np.concatenate([vec, ids[r]]), np.concatenate([score, more])
            keep = kept_best(q, vec, score, k)
            q, vec, score = q[keep], vec[keep], score[keep]
        yield rows_out(query_id=(query_ids[q], pa.int64()), vec_id=(vec, pa.int64()), score=(score, pa.int64()))

    return run


def query_blocks(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the packed queries, about QUERY_BLOCK at a time; one block without queries if there are none."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def joined() -> tuple[np.ndarray, np.ndarray]:
        dims = max((v.shape[1] for _, v in held), default=0)
        return np.concatenate([np.empty(0, np.int64), *(i for i, _ in held)]), np.concatenate([np.empty((0, dims), np.int64), *(widened(v, dims) for _, v in held)])

    none = True
    for r in asked.toLocalIterator():
        held.append(unpacked(r["rows"], r["dims"], r["ids"], r["values"]))
        if sum(len(i) for i, _ in held) >= QUERY_BLOCK:
            yield joined()
            held, none = [], False
    if held or none:
        yield joined()


def top_k(rows: DataFrame, k: int = K, every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every`."""
    vector = F.col(vector_col).cast("array<double>")
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.where(finite).distinct()
    data, asked = packed(vectors), packed(vectors.where(F.col("id") % every == 0))
    passes = [data.mapInArrow(_best(*block, k), "query_id long, vec_id long, score long") for block in query_blocks(asked)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.union, passes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
