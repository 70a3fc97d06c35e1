"""Gradient estimators. AR losses are quadratic in the coefficients, so one job's moments give every loss and gradient; only MA models rescan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lagoon.functions.linalg import spectral_radius
from lagoon.operators.models import VectorModel, fit_vma, var_from_covariances
from lagoon.operators.moments import LagGram, lag_gram, mean_of
from lagoon.series import TICK, TimeSeries


class ARLoss:
    """(1/N) sum e' P e of e = (x_t - m) - sum A_h (x_{t-h} - m), and its gradient, from lag moments. P = diag(1 / sigma^2)."""

    def __init__(self, gram: LagGram, sigma2: np.ndarray, mean=None, rescale_by_spectral_radius: bool = False):
        d, c = gram.dim, gram.centred(mean)
        self.d, self.precision = d, np.diag(1 / np.asarray(sigma2, float))
        self.xx, self.xz, self.zz = c[:d, :d], c[:d, d:], c[d:, d:]
        self.rescale = rescale_by_spectral_radius

    def _flat(self, coeffs: list[np.ndarray]) -> np.ndarray:
        if self.rescale and (rho := spectral_radius(coeffs)) > 0:
            coeffs = [c / rho for c in coeffs]
        return np.concatenate(coeffs, axis=1)

    def loss(self, coeffs: list[np.ndarray]) -> float:
        a = self._flat(coeffs)
        return float(np.trace(self.precision @ (self.xx - a @ self.xz.T - self.xz @ a.T + a @ self.zz @ a.T)))

    def gradient(self, coeffs: list[np.ndarray]) -> list[np.ndarray]:
        g = -2 * self.precision @ (self.xz - self._flat(coeffs) @ self.zz)
        return np.split(g, g.shape[1] // self.d, axis=1)


class MALoss:
    """The same loss for x_t = m + e_t + sum B_h e_{t-h}: innovations are a running state, so each evaluation is an ordered scan of every series."""

    def __init__(self, ts: TimeSeries, order: int, sigma2: np.ndarray, mean: np.ndarray):
        keys = list(ts.keys)
        rows = ts.df.select(F.xxhash64(*keys).alias("g") if keys else F.lit(0).cast("long").alias("g"), TICK, *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(ts.values)))
        rows = (rows.repartition("g") if keys else rows.coalesce(1)).sortWithinPartitions("g", TICK)
        self.rows, self.d, self.order = rows.cache(), ts.dim, order
        self.precision, self.mean = 1 / np.asarray(sigma2, float), np.asarray(mean, float)

    def both(self, coeffs: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        d, q, mean, precision, b = self.d, self.order, self.mean, self.precision, [np.array(c) for c in coeffs]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            series, past, total, n = None, np.zeros((q, d)), np.zeros(1 + q * d * d), 0
            for batch in batches:
                for g, x in zip(batch["g"].to_numpy(), batch.iloc[:, 2:].to_numpy(), strict=True):
                    if g != series:
                        series, past = g, np.zeros((q, d))
                    e = x - mean - sum(b[h] @ past[h] for h in range(q))
                    total[0] += e @ (precision * e)
                    total[1:] += -2 * np.concatenate([np.outer(precision * e, past[h]).ravel() for h in range(q)])
                    past = np.concatenate([e[None], past[:-1]])
                    n += 1
            yield pd.DataFrame({"pos": range(len(total) + 1), "x": [n, *total]})

        found = self.rows.mapInPandas(run, "pos long, x double").groupBy("pos").agg(F.sum("x").alias("x")).orderBy("pos").collect()
        x = np.array([r["x"] for r in found])
        n = max(x[0], 1)
        return float(x[1] / n), list((x[2:] / n).reshape(self.order, self.d, self.d))

    def loss(self, coeffs) -> float:
        return self.both(coeffs)[0]

    def gradient(self, coeffs) -> list[np.ndarray]:
        return self.both(coeffs)[1]

    def close(self) -> None:
        self.rows.unpersist()


def _norm(g: list[np.ndarray]) -> float:
    return float(np.sqrt(sum((x * x).sum() for x in g)))


def gradient_descent(problem, start: list[np.ndarray], step: Callable[[int], float], precision: float = 1e-4, max_iter: int = 100) -> list[np.ndarray]:
    """Backtracking (0.4, 0.9, ten tries) until the gradient's norm is at most precision * (1 + loss)."""
    x, loss = [np.array(c, float) for c in start], problem.loss(start)
    for i in range(max_iter):
        g = problem.gradient(x)
        size = _norm(g)
        if size <= precision * (1 + loss):
            break
        t = step(i)
        for _ in range(10):
            new = [a - t * b for a, b in zip(x, g, strict=True)]
            new_loss = problem.loss(new)
            if new_loss <= loss - 0.4 * t * size**2:
                break
            t *= 0.9
        if not new_loss < loss:
            break
        x, loss = new, new_loss
    return x


def soft_threshold(a: np.ndarray, t: float) -> np.ndarray:
    return np.sign(a) * np.maximum(np.abs(a) - t, 0)


def l1_descent(problem, start: list[np.ndarray], step: Callable[[int], float], lam: float, precision: float = 1e-6, max_iter: int = 1000, truncate: float | None = None) -> list[np.ndarray]:
    """Gradient steps with soft thresholds of step * lam, of all coefficients or (truncate=t) of those of absolute value t or less; until the penalised loss moves by at most precision."""
    whole = lambda c: problem.loss(c) + lam * sum(np.abs(m).sum() for m in c)
    x = [np.array(c, float) for c in start]
    loss = whole(x)
    for i in range(max_iter):
        t = step(i)
        moved = [a - t * b for a, b in zip(x, problem.gradient(x), strict=True)]
        x = [soft_threshold(a, t * lam) if truncate is None else np.where(np.abs(a) <= truncate, soft_threshold(a, t * lam), a) for a in moved]
        new = whole(x)
        if abs(loss - new) <= precision:
            break
        loss = new
    return x


def _start(ts: TimeSeries, p: int, mean) -> tuple[LagGram, VectorModel]:
    gram = lag_gram(ts, p)
    if not gram.n_full:
        raise ValueError(f"no window has {p + 1} rows; is the series on a grid of {ts.delta}?")
    m, d = gram.mean if mean is None else np.asarray(mean, float), ts.dim
    back = [gram.gram[:d, h * d : (h + 1) * d] / gram.n_full - np.outer(m, m) for h in range(p + 1)]
    return gram, var_from_covariances(back)


def _ar_step(problem: ARLoss) -> float:
    """One over the gradient's largest slope."""
    return 1.0 / (2 * float(np.linalg.eigvalsh(problem.zz)[-1]) * float(problem.precision.max()))


def fit_var_gd(ts: TimeSeries, p: int, precision: float = 1e-4, max_iter: int = 100, mean=None, **how) -> VectorModel:
    """Gradient descent from the Yule-Walker estimate; one Spark job."""
    gram, first = _start(ts, p, mean)
    problem = ARLoss(gram, np.diag(first.noise), mean, **how)
    return VectorModel(gradient_descent(problem, first.ar, lambda i: _ar_step(problem), precision, max_iter), [], first.noise)


def fit_var_l1(ts: TimeSeries, p: int, lam: float, precision: float = 1e-6, max_iter: int = 1000, mean=None, truncate: float | None = None) -> VectorModel:
    """L1-penalised coefficients; one Spark job."""
    gram, first = _start(ts, p, mean)
    c, d, a = gram.centred(mean), ts.dim, np.concatenate(first.ar, axis=1)
    residual = c[:d, :d] - a @ c[:d, d:].T - c[:d, d:] @ a.T + a @ c[d:, d:] @ a.T
    problem = ARLoss(gram, np.diag(residual), mean)
    return VectorModel(l1_descent(problem, first.ar, lambda i: _ar_step(problem), lam, precision, max_iter, truncate), [], first.noise)


def fit_vma_gd(ts: TimeSeries, q: int, precision: float = 1e-4, max_iter: int = 100, mean=None, depth: int | None = None) -> VectorModel:
    """Gradient descent from the innovations estimate; two ordered scans for each step."""
    first = fit_vma(ts, q, mean, depth)
    problem = MALoss(ts, q, np.diag(first.noise), mean_of(ts) if mean is None else mean)
    try:
        found = gradient_descent(problem, first.ma, lambda i: 0.45 * 0.9**i, precision, max_iter)
    finally:
        problem.close()
    return VectorModel([], found, first.noise)
