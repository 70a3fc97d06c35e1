"""Linear models: estimates from lag moments, and residuals as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.functions.linalg import block_innovations, block_toeplitz, durbin_levinson, innovations
from lagoon.operators.moments import auto_covariance, lag_covariances, yule_walker
from lagoon.operators.windows import framed, owned
from lagoon.series import TICK, TimeSeries


@dataclass
class VectorModel:
    """ar: A_1..A_p, ma: B_1..B_q, noise: covariance of the innovations."""

    ar: list[np.ndarray]
    ma: list[np.ndarray]
    noise: np.ndarray

    @property
    def coefficients(self) -> list[np.ndarray]:
        return [*self.ar, *self.ma]

    def to_df(self, spark) -> DataFrame:
        """kind, lag, i, j, value."""
        parts = [("ar", h + 1, a) for h, a in enumerate(self.ar)] + [("ma", h + 1, b) for h, b in enumerate(self.ma)] + [("noise", 0, self.noise)]
        rows = [(k, h, i, j, float(m[i, j])) for k, h, m in parts for i in range(len(m)) for j in range(len(m))]
        return spark.createDataFrame(rows, "kind string, lag int, i int, j int, value double")


@dataclass
class ScalarModels:
    """A univariate model for each dimension: ar[dim], ma[dim] and noise variances."""

    ar: list[np.ndarray]
    ma: list[np.ndarray]
    noise: np.ndarray

    def to_df(self, spark) -> DataFrame:
        """dim, kind, lag, value."""
        rows = [(i, k, h + 1, float(c)) for k, m in (("ar", self.ar), ("ma", self.ma)) for i, cs in enumerate(m) for h, c in enumerate(cs)]
        rows += [(i, "noise", 0, float(v)) for i, v in enumerate(self.noise)]
        return spark.createDataFrame(rows, "dim int, kind string, lag int, value double")


def _autocov(ts: TimeSeries, lags: int, mean) -> np.ndarray:
    out = np.zeros((ts.dim, lags + 1))
    for dim, lag, value in auto_covariance(ts, lags, mean).collect():
        if value is None:
            raise ValueError(f"no window has {lags + 1} rows; is the series on a grid of {ts.delta}?")
        out[dim, lag] = value
    return out


def _steps(order: int, depth: int | None) -> int:
    """Innovation steps: the order itself unless given; 10 orders or more remove the recursion's bias."""
    return order if depth is None else max(order, depth)


def fit_ar(ts: TimeSeries, p: int, mean=None) -> ScalarModels:
    found = [durbin_levinson(g, p) for g in _autocov(ts, p, mean)]
    return ScalarModels([c for c, _ in found], [np.zeros(0)] * ts.dim, np.array([v for _, v in found]))


def fit_ma(ts: TimeSeries, q: int, mean=None, depth: int | None = None) -> ScalarModels:
    steps = _steps(q, depth)
    found = [innovations(g, q, steps) for g in _autocov(ts, steps, mean)]
    return ScalarModels([np.zeros(0)] * ts.dim, [c for c, _ in found], np.array([v for _, v in found]))


def arma_from_psi(psi: list[np.ndarray], p: int, q: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """AR and MA matrices from psi_1..psi_{p+q}: psi_j = B_j + sum_{i <= min(j, p)} A_i psi_{j-i}."""
    d = psi[0].shape[0]
    at = lambda j: np.eye(d) if j == 0 else psi[j - 1] if j > 0 else np.zeros((d, d))
    ar = [x.T for x in block_toeplitz([at(q + k).T for k in range(1 - p, p)], [at(q + h).T for h in range(1, p + 1)])] if p else []
    ma = [at(j) - sum((ar[i - 1] @ at(j - i) for i in range(1, min(j, p) + 1)), np.zeros((d, d))) for j in range(1, q + 1)]
    return ar, ma


def fit_arma(ts: TimeSeries, p: int, q: int, mean=None, depth: int | None = None) -> ScalarModels:
    steps, ar, ma, noise = _steps(p + q, depth), [], [], []
    for g in _autocov(ts, steps, mean):
        psi, var = innovations(g, p + q, steps)
        a, b = arma_from_psi([np.array([[x]]) for x in psi], p, q)
        ar.append(np.array([x[0, 0] for x in a]))
        ma.append(np.array([x[0, 0] for x in b]))
        noise.append(var)
    return ScalarModels(ar, ma, np.array(noise))


def var_from_covariances(back: list[np.ndarray]) -> VectorModel:
    ar = yule_walker(back)
    noise = back[0] - sum(a @ back[h + 1].T for h, a in enumerate(ar))
    return VectorModel(ar, [], noise)


def fit_var(ts: TimeSeries, p: int, mean=None) -> VectorModel:
    """Yule-Walker on one job's lag moments."""
    return var_from_covariances(lag_covariances(ts, p, mean))


def fit_vma(ts: TimeSeries, q: int, mean=None, depth: int | None = None) -> VectorModel:
    steps = _steps(q, depth)
    ma, noise = block_innovations(lag_covariances(ts, steps, mean), q, steps)
    return VectorModel([], ma, noise)


def fit_varma(ts: TimeSeries, p: int, q: int, mean=None, depth: int | None = None) -> VectorModel:
    steps = _steps(p + q, depth)
    psi, noise = block_innovations(lag_covariances(ts, steps, mean), p + q, steps)
    ar, ma = arma_from_psi(psi, p, q)
    return VectorModel(ar, ma, noise)


def var_residuals(ts: TimeSeries, coeffs: list[np.ndarray], mean=None) -> DataFrame:
    """Each row with r0, r1, ...: x_t - m - sum A_h (x_{t-h} - m). Lags that the series or its window lacks count as the mean."""
    p, d = len(coeffs), ts.dim
    if any(c.shape != (d, d) for c in coeffs):
        raise ValueError(f"coefficients of {[c.shape for c in coeffs]} don't fit a series of {d} dimensions")
    m = np.zeros(d) if mean is None else np.asarray(mean, float)
    reach = p * ts.delta
    df, _, order = framed(ts, reach, 0)
    lagged = [F.when(F.col(TICK) - F.lag(TICK, h).over(order) <= reach, F.lag(F.col(v).cast("double"), h).over(order) - float(m[j])).alias(f"_l{h}_{j}") for h in range(1, p + 1) for j, v in enumerate(ts.values)]
    rows = owned(df.select("*", *lagged))
    out = []
    for i, v in enumerate(ts.values):
        predicted = F.lit(float(m[i]))
        for h, c in enumerate(coeffs, 1):
            for j in np.flatnonzero(c[i]):
                predicted = predicted + F.coalesce(F.col(f"_l{h}_{j}"), F.lit(0.0)) * float(c[i, j])
        out.append((F.col(v).cast("double") - predicted).alias(f"r{i}"))
    return rows.select(*ts.df.columns, *out)


def ar_residuals(ts: TimeSeries, coeffs: list[np.ndarray], mean=None) -> DataFrame:
    """As var_residuals with one AR model for each dimension; coeffs[dim] are its lags 1..p."""
    if len(coeffs) != ts.dim:
        raise ValueError(f"{len(coeffs)} models don't fit a series of {ts.dim} dimensions")
    p = max(map(len, coeffs))
    padded = np.array([[*c, *[0.0] * (p - len(c))] for c in coeffs])
    return var_residuals(ts, [np.diag(padded[:, h]) for h in range(p)], mean)


def residual_series(ts: TimeSeries, residuals: DataFrame) -> TimeSeries:
    return ts.with_df(residuals, [f"r{i}" for i in range(ts.dim)])
