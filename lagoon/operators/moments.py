"""First and second moments over lags: one aggregation feeds every covariance, correlation and linear model.

A row with a null value is no observation of the vector series: moments over lags are taken without it, and windows
that lack it aren't full. That holds for the generated aggregation and for the kernel alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions.linalg import block_toeplitz
from lagoon.operators.windows import BLOCK, OWN, framed, owned, with_halo
from lagoon.series import TICK, TimeSeries

#: Products of lagged columns that one generated aggregation may hold; beyond, blocks go to an Arrow kernel.
SQL_PRODUCTS = 40


def average(ts: TimeSeries) -> DataFrame:
    """dim, mean: sums over the declared number of samples, or over the rows."""
    n = F.lit(ts.n_samples) if ts.n_samples is not None else F.count("*")
    return _long(ts.df.agg(F.array(*[F.sum(F.col(v).cast("double")) / n for v in ts.values]).alias("m")), "mean")


def _long(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.posexplode("m").alias("dim", name))


def mean_of(ts: TimeSeries) -> np.ndarray:
    return np.array([r["mean"] for r in average(ts).orderBy("dim").collect()], float)


def second_moment(ts: TimeSeries, mean: np.ndarray | None = None) -> DataFrame:
    """i, j, value: (1/n) sum (v - m)(v - m)'; m is zero unless given."""
    m = np.zeros(ts.dim) if mean is None else np.asarray(mean, float)
    x = [F.col(v).cast("double") - F.lit(float(m[i])) for i, v in enumerate(ts.values)]
    pairs = [(i, j) for i in range(ts.dim) for j in range(i, ts.dim)]
    sums = ts.df.agg(*[F.avg(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{min(i, j)}_{max(i, j)}").alias("value")) for i in range(ts.dim) for j in range(ts.dim)]
    return sums.select(F.inline(F.array(*cells)))


def covariance(ts: TimeSeries, mean: np.ndarray | None = None) -> DataFrame:
    """As second_moment; the mean is zero unless given (the sample mean is mean_of())."""
    return second_moment(ts, mean)


def centred_covariance(ts: TimeSeries) -> DataFrame:
    """i, j, value around the sample mean, in one pass."""
    pairs = [(i, j) for i in range(ts.dim) for j in range(i, ts.dim)]
    sums = ts.df.agg(*[F.covar_pop(ts.values[i], ts.values[j]).alias(f"s{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{min(i, j)}_{max(i, j)}").alias("value")) for i in range(ts.dim) for j in range(ts.dim)]
    return sums.select(F.inline(F.array(*cells)))


# lag moments


def observed(ts: TimeSeries) -> TimeSeries:
    """Only rows that have all values."""
    return ts.filter(reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in ts.values]))


def by_block(ts: TimeSeries, bck: int, fwd: int, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray | None]) -> np.ndarray | None:
    """Sum over all blocks of kernel(ticks, values, is_target), an array of fixed size; None without rows.

    Blocks stream through each task, which keeps one partial array; partial arrays are summed by position in Spark, so the driver gets one array, however many blocks there are.
    """
    keys = list(ts.keys)
    df = with_halo(ts, bck, fwd)
    group = F.xxhash64(*keys, BLOCK) if keys else F.col(BLOCK)
    target = F.col(BLOCK) == F.col(OWN)
    rows = df.select(group.alias("g"), F.col(TICK).alias("t"), target.alias("target"), *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(ts.values)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], None

        def add(block: list[np.ndarray]) -> None:
            nonlocal total
            part = kernel(block[1], np.stack(block[3:], axis=1), block[2].astype(bool))
            if part is not None:
                total = part if total is None else total + part

        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if not held else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cuts = np.flatnonzero(np.diff(held[0])) + 1
            for a, b in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                add([x[a:b] for x in held])
            held = [x[cuts[-1] :] for x in held] if len(cuts) else held
        if held and len(held[0]):
            add(held)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total, pa.float64())], names=["pos", "x"])

    parts = rows.repartition("g").sortWithinPartitions("g", "t").mapInArrow(run, "pos long, x double")
    found = parts.groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect()
    return np.array([r["x"] for r in found]) if found else None


@dataclass
class LagGram:
    """Counts, sums and all products of the stacked lags z_t = [x_t; x_{t-1}; ...; x_{t-L}] over full windows."""

    n: int
    total: np.ndarray
    n_full: int
    sums: np.ndarray
    gram: np.ndarray
    dim: int

    @property
    def mean(self) -> np.ndarray:
        return self.total / max(self.n, 1)

    def centred(self, mean: np.ndarray | None = None) -> np.ndarray:
        """(1/n_full) sum (z - m)(z - m)'."""
        m = np.tile(self.mean if mean is None else np.asarray(mean, float), len(self.sums) // self.dim)
        s = self.sums / self.n_full
        return self.gram / self.n_full - np.outer(s, m) - np.outer(m, s) + np.outer(m, m)


def lag_gram(ts: TimeSeries, max_lag: int) -> LagGram:
    """One job for everything that a linear model with max_lag lags needs."""
    ts.require(bck=max_lag * ts.delta)
    ts = observed(ts)
    d, width, reach = ts.dim, max_lag + 1, max_lag * ts.delta

    def kernel(t: np.ndarray, v: np.ndarray, target: np.ndarray) -> np.ndarray:
        last = np.searchsorted(t, t, "right")
        full = target & (last - np.searchsorted(t, t - reach, "left") == width)
        at = last[full] - 1
        z = np.concatenate([v[at - h] for h in range(width)], axis=1)
        return np.concatenate([[target.sum()], v[target].sum(axis=0), [full.sum()], z.sum(axis=0), (z.T @ z).ravel()])

    x = by_block(ts, reach, 0, kernel)
    if x is None:
        x = np.zeros(1 + d + 1 + width * d + (width * d) ** 2)
    a, b, c = np.split(x, [1 + d, 2 + d + width * d])[0], x[1 + d], x[2 + d :]
    return LagGram(int(a[0]), a[1:], int(b), c[: width * d], c[width * d :].reshape(width * d, width * d), d)


class LagMatrices:
    """A matrix for each lag -L..L: rows (lag, i, j, value), or numpy [2L + 1, d, d]."""

    def __init__(self, df: DataFrame, max_lag: int, dim: int):
        self.df, self.max_lag, self.dim = df, max_lag, dim

    def matrices(self) -> np.ndarray:
        out = np.full((2 * self.max_lag + 1, self.dim, self.dim), np.nan)
        for lag, i, j, value in self.df.select("lag", "i", "j", "value").collect():
            out[lag + self.max_lag, i, j] = np.nan if value is None else value
        return out


def _lag_columns(ts: TimeSeries, max_lag: int) -> tuple[DataFrame, Column]:
    """Owned rows with lag columns l{h}_{j}, and whether a row's window is full."""
    reach = max_lag * ts.delta
    df, frame, order = framed(ts, reach, 0)
    lags = [F.lag(F.col(v).cast("double"), h).over(order).alias(f"l{h}_{j}") for h in range(1, max_lag + 1) for j, v in enumerate(ts.values)]
    rows = owned(df.select("*", *(F.col(v).cast("double").alias(f"l0_{j}") for j, v in enumerate(ts.values)), *lags, F.count("*").over(frame).alias("_n")))
    return rows, F.col("_n") == max_lag + 1


def _lag_frame(ts: TimeSeries, max_lag: int, mean: np.ndarray | None, cells: list[tuple[int, int, int]]) -> DataFrame:
    """One row: c{h}_{i}_{j} = E over full windows of x_t[i] x_{t-h}[j], less m m'; lazily, without a job."""
    rows, full = _lag_columns(observed(ts), max_lag)
    products = [F.avg(F.when(full, F.col(f"l0_{i}") * F.col(f"l{h}_{j}"))).alias(f"p{h}_{i}_{j}") for h, i, j in cells]
    means = [F.avg(f"l0_{i}").alias(f"m{i}") if mean is None else F.max(F.lit(float(mean[i]))).alias(f"m{i}") for i in range(ts.dim)]
    sums = rows.agg(*products, *means)
    return sums.select(*[(F.col(f"p{h}_{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{h}_{i}_{j}") for h, i, j in cells])


def cross_covariance(ts: TimeSeries, max_lag: int, mean: np.ndarray | None = None) -> LagMatrices:
    """E x_t x_{t+lag}' - m m' for lags -L..L, over full windows of L + 1 rows with one divisor for all lags; m the mean of all rows unless given."""
    ts.require(bck=max_lag * ts.delta)
    d = ts.dim
    if (max_lag + 1) * d * d <= SQL_PRODUCTS:
        cells = [(h, i, j) for h in range(max_lag + 1) for i in range(d) for j in range(d)]
        row = _lag_frame(ts, max_lag, mean, cells)
        out = []
        for lag in range(-max_lag, max_lag + 1):
            for i in range(d):
                for j in range(d):
                    a, b = (i, j) if lag <= 0 else (j, i)
                    out.append(F.struct(F.lit(lag).alias("lag"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{abs(lag)}_{a}_{b}").alias("value")))
        return LagMatrices(row.select(F.inline(F.array(*out))), max_lag, d)
    back = lag_covariances(ts, max_lag, mean)
    rows = [(lag, i, j, float(back[abs(lag)][(i, j) if lag <= 0 else (j, i)])) for lag in range(-max_lag, max_lag + 1) for i in range(d) for j in range(d)]
    return LagMatrices(ts.df.sparkSession.createDataFrame(rows, "lag int, i int, j int, value double"), max_lag, d)


def lag_covariances(ts: TimeSeries, max_lag: int, mean: np.ndarray | None = None) -> list[np.ndarray]:
    """E x_t x_{t-h}' - m m' for h = 0..L on the driver: one block job."""
    g = lag_gram(ts, max_lag)
    if not g.n_full:
        raise ValueError(f"no window has {max_lag + 1} rows; is the series on a grid of {ts.delta}?")
    m = g.mean if mean is None else np.asarray(mean, float)
    d = ts.dim
    return [g.gram[:d, h * d : (h + 1) * d] / g.n_full - np.outer(m, m) for h in range(max_lag + 1)]


def cross_correlation(ts: TimeSeries, max_lag: int, mean: np.ndarray | None = None) -> LagMatrices:
    """Cross-covariance over the root of both variances; null where a variance is zero."""
    cov = cross_covariance(ts, max_lag, mean).df
    var = cov.where("lag = 0 and i = j").select("i", "value")
    left, right = var.select("i", F.col("value").alias("vi")), var.select(F.col("i").alias("j"), F.col("value").alias("vj"))
    joined = cov.join(F.broadcast(left), "i").join(F.broadcast(right), "j")  # dim rows each
    scale = F.sqrt(F.col("vi") * F.col("vj"))
    return LagMatrices(joined.select("lag", "i", "j", F.when(scale > 0, F.col("value") / scale).alias("value")), max_lag, ts.dim)


def auto_covariance(ts: TimeSeries, max_lag: int, mean: np.ndarray | None = None) -> DataFrame:
    """dim, lag 0..L, value for each dimension alone; the mean is zero unless given."""
    ts.require(bck=max_lag * ts.delta)
    m = np.zeros(ts.dim) if mean is None else np.asarray(mean, float)
    cells = [(h, i, i) for h in range(max_lag + 1) for i in range(ts.dim)]
    if len(cells) <= SQL_PRODUCTS:
        row = _lag_frame(ts, max_lag, m, cells)
        out = [F.struct(F.lit(i).alias("dim"), F.lit(h).alias("lag"), F.col(f"c{h}_{i}_{i}").alias("value")) for h, i, _ in cells]
        return row.select(F.inline(F.array(*out)))
    back = lag_covariances(ts, max_lag, m)
    return ts.df.sparkSession.createDataFrame([(i, h, float(back[h][i, i])) for h, i, _ in cells], "dim int, lag int, value double")


def yule_walker(back: list[np.ndarray]) -> list[np.ndarray]:
    """A_1..A_p of a VAR from E x_t x_{t-h}', h = 0..p."""
    p = len(back) - 1
    at = lambda lag: back[-lag] if lag <= 0 else back[lag].T
    return [x.T for x in block_toeplitz([at(k) for k in range(1 - p, p)], [at(h) for h in range(1, p + 1)])]


def partial_cross_correlation(ts: TimeSeries, max_lag: int, mean: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The transposed VAR(L) coefficient matrices, and the first of them."""
    found = [a.T for a in yule_walker(lag_covariances(ts, max_lag, mean))]
    return found, found[0]
