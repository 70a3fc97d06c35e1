"""Seeded synthetic series: ticks 0, delta, 2 delta, ... and values v0, v1, ..."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one generated chunk of a recursive series.
CHUNK = 1 << 16


def ones(spark: SparkSession, columns: int, n: int, delta: int = 1, partitions: int | None = None) -> DataFrame:
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return rows.select((F.col("id") * delta).alias("t"), *(F.lit(1.0).alias(f"v{i}") for i in range(columns)))


def white_noise(spark: SparkSession, columns: int, n: int, delta: int = 1, kind: str = "gaussian", magnitudes=None, seed: int = 0, partitions: int = 8) -> DataFrame:
    """Independent noise times a magnitude: gaussian (sd 1) or uniform (-0.5..0.5); the same for equal seed and partitions."""
    m = [1.0] * columns if magnitudes is None else magnitudes
    draw = lambda i: F.randn(seed + i) if kind == "gaussian" else F.rand(seed + i) - 0.5
    return spark.range(0, n, 1, partitions).select((F.col("id") * delta).alias("t"), *((draw(i) * float(m[i])).alias(f"v{i}") for i in range(columns)))


def hashed_noise(t: Column, dim: int, seed: int) -> Column:
    """Uniform noise (-0.5..0.5) that depends on tick, dimension and seed only, so it can be had for any tick in any task."""
    return F.pmod(F.xxhash64(t, F.lit(dim), F.lit(seed)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40)) - 0.5


def simulate(n: int, phis: list[np.ndarray], thetas: list[np.ndarray], noise: np.ndarray, magnitudes: np.ndarray) -> np.ndarray:
    """x_t = e_t + sum Theta_h (m o e_{t-h}) + sum Phi_h (m o x_{t-h}); lags before the first sample count as 0, and the first p samples are without the AR part."""
    p, q = len(phis), len(thetas)
    x = noise.copy()
    for h, theta in enumerate(thetas, 1):
        x[h:] += (noise[:-h] * magnitudes) @ theta.T if h < n else 0
    if p:
        stacked = np.concatenate([phi * magnitudes for phi in phis], axis=1)
        for t in range(p, n):
            x[t] += stacked @ x[t - p : t][::-1].ravel()
    return x if p or q else noise


def _noise(kind: str, seed: int, block: int, first: int, n: int, d: int) -> np.ndarray:
    """Noise of one block, the same in any task; "md5" depends on tick, dimension and seed alone, so any engine can have it."""
    if kind == "md5":
        return np.array([[int(md5(f"{seed}:{j}:{t}".encode()).hexdigest()[:13], 16) / 2**52 - 0.5 for j in range(d)] for t in range(first, first + n)]).reshape(n, d)
    rng = np.random.default_rng([seed, block])
    return rng.normal(size=(n, d)) if kind == "gaussian" else rng.random((n, d)) - 0.5


def varma(spark: SparkSession, phis: list, thetas: list, n: int, delta: int = 1, sigma: float = 1.0, magnitudes=None, seed: int = 0, kind: str = "gaussian") -> DataFrame:
    """Vector ARMA, in blocks of CHUNK rows on all tasks.

    The recursion is affine in its state, the last samples and noise. One pass runs each block from zero and gives its
    last state; the driver composes these (a vector for each block) to the state that each block really starts
    from; the second pass runs the blocks from there.
    """
    phis, thetas = [np.atleast_2d(np.asarray(p, float)) for p in phis], [np.atleast_2d(np.asarray(t, float)) for t in thetas]
    d, p, q = (phis or thetas)[0].shape[0], len(phis), len(thetas)
    m = np.ones(d) if magnitudes is None else np.asarray(magnitudes, float)
    blocks, size = max(1, -(-n // CHUNK)), max(CHUNK, p + q)

    def block(b: int, state: np.ndarray) -> np.ndarray:
        """Samples of a block after a state: p samples, then q rows of noise."""
        first, rows = b * size, min(size, n - b * size)
        e = np.concatenate([state[p:], sigma * _noise(kind, seed, b, first, rows, d)])
        x = np.concatenate([state[:p], simulate(rows + q, [], thetas, e, m)[q:]])
        if p:
            stacked = np.concatenate([phi * m for phi in phis], axis=1)
            for t in range(2 * p if b == 0 else p, p + rows):  # the first p samples of all are without the AR part
                x[t] += stacked @ x[t - p : t][::-1].ravel()
        return np.concatenate([x, e[len(e) - q :]]) if q else x

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for part in batches for b in part.column(0).to_pylist()):
            x = block(b, np.zeros((p + q, d)))
            last = np.concatenate([x[: len(x) - q][-p:] if p else x[:0], x[len(x) - q :]])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([last.ravel().tolist()], pa.list_(pa.float64()))], names=["b", "last"])

    starts = {0: np.zeros((p + q, d))}
    if blocks > 1 and p + q:
        found = spark.range(0, blocks - 1, 1, blocks - 1).mapInArrow(ends, "b long, last array<double>").orderBy("b").toLocalIterator()
        step = np.linalg.matrix_power(_companion(phis, thetas, m, d), size)
        for r in found:
            starts[r["b"] + 1] = (step @ starts[r["b"]].ravel()).reshape(p + q, d) + np.array(r["last"]).reshape(p + q, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for part in batches for b in part.column(0).to_pylist()):
            rows = min(size, n - b * size)
            x = block(b, starts.get(b, np.zeros((p + q, d))))[p : p + rows]
            t = (b * size + np.arange(rows, dtype=np.int64)) * delta
            yield pa.RecordBatch.from_arrays([pa.array(t), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(d))], names=["t", *(f"v{i}" for i in range(d))])

    columns = "t long, " + ", ".join(f"v{i} double" for i in range(d))
    return spark.range(0, blocks if n else 0, 1, blocks).mapInArrow(run, columns)


def _companion(phis: list[np.ndarray], thetas: list[np.ndarray], m: np.ndarray, d: int) -> np.ndarray:
    """One step without new noise of the state (samples, oldest first, then noise, oldest first)."""
    p, q = len(phis), len(thetas)
    out = np.zeros(((p + q) * d, (p + q) * d))
    for h in range(p - 1):
        out[h * d : (h + 1) * d, (h + 1) * d : (h + 2) * d] = np.eye(d)
    for h in range(q - 1):
        out[(p + h) * d : (p + h + 1) * d, (p + h + 1) * d : (p + h + 2) * d] = np.eye(d)
    if p:
        own = slice((p - 1) * d, p * d)
        for h, phi in enumerate(phis, 1):
            out[own, (p - h) * d : (p - h + 1) * d] = phi * m
        for h, theta in enumerate(thetas, 1):
            out[own, (p + q - h) * d : (p + q - h + 1) * d] = theta * m
    return out


def var(spark: SparkSession, phis: list, n: int, **how) -> DataFrame:
    return varma(spark, phis, [], n, **how)


def vma(spark: SparkSession, thetas: list, n: int, **how) -> DataFrame:
    return varma(spark, [], thetas, n, **how)


def _diagonal(coeffs: list) -> list[np.ndarray]:
    """coeffs[dim] are the lags of one dimension; dimensions may differ in order."""
    order = max(map(len, coeffs), default=0)
    return [np.diag([c[h] if h < len(c) else 0.0 for c in coeffs]) for h in range(order)]


def ar(spark: SparkSession, phis: list, n: int, **how) -> DataFrame:
    return varma(spark, _diagonal(phis), [], n, **how)


def ma(spark: SparkSession, thetas: list, n: int, **how) -> DataFrame:
    return varma(spark, [], _diagonal(thetas), n, **how)


def arma(spark: SparkSession, phis: list, thetas: list, n: int, **how) -> DataFrame:
    return varma(spark, _diagonal(phis), _diagonal(thetas), n, **how)
