"""Dense linear algebra on small, already reduced matrices: recursions and solvers of linear time-series models."""

from __future__ import annotations

import numpy as np


def durbin_levinson(autocov: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """AR coefficients and noise variance from autocovariances at lags 0..order."""
    if autocov[0] == 0:
        raise ValueError("a constant dimension has no AR model: its variance is zero")
    phi, var = np.zeros(0), float(autocov[0])
    for k in range(1, order + 1):
        last = (autocov[k] - phi @ autocov[k - 1 : 0 : -1]) / var
        phi = np.append(phi - last * phi[::-1], last)
        var *= 1 - last * last
    return phi, var


def innovations(autocov: np.ndarray, order: int, depth: int | None = None) -> tuple[np.ndarray, float]:
    """MA coefficients 1..order and noise variance after `depth` (order, unless given) innovation steps."""
    thetas, noise = block_innovations([np.atleast_2d(g) for g in autocov], order, depth)
    return np.array([t[0, 0] for t in thetas]), float(noise[0, 0])


def block_innovations(cov: list[np.ndarray], order: int, depth: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Multivariate innovations: cov[h] = E x_t x_{t-h}' for h = 0..depth. Coefficients 1..order and noise covariance."""
    depth = order if depth is None else depth
    gamma = lambda h: cov[h] if h >= 0 else cov[-h].T
    noise, theta = [np.array(cov[0], float)], {}
    for m in range(1, depth + 1):
        for j in range(m):
            rest = gamma(m - j) - sum((theta[m, m - i] @ noise[i] @ theta[j, j - i].T for i in range(j)), np.zeros_like(cov[0]))
            theta[m, m - j] = solve(noise[j].T, rest.T).T
        noise.append(cov[0] - sum(theta[m, m - j] @ noise[j] @ theta[m, m - j].T for j in range(m)))
    return [theta[depth, j] for j in range(1, order + 1)], noise[depth]


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError as e:
        raise ValueError("singular covariance: a dimension is constant or a combination of others") from e


def toeplitz(r: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x with T x = y, where T[i, j] = r[i + p - 1 - j] and r has 2p - 1 numbers; O(p^2) by bordering."""
    p = len(y)
    t = lambda k: r[k + p - 1]
    forward, backward, x = np.array([1 / t(0)]), np.array([1 / t(0)]), np.array([y[0] / t(0)])
    for n in range(1, p):
        below, above = np.array([t(n - j) for j in range(n)]), np.array([t(-j - 1) for j in range(n)])
        e_f, e_b = below @ forward, above @ backward
        f, b = np.append(forward, 0), np.insert(backward, 0, 0)
        scale = 1 - e_f * e_b
        forward, backward = (f - e_f * b) / scale, (b - e_b * f) / scale
        x = np.append(x, 0) + (y[n] - below @ x) * backward
    return x


def block_toeplitz(r: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Blocks X with sum_j R[i + p - 1 - j] X_j = Y_i; r has 2p - 1 blocks."""
    p, d = len(y), r[0].shape[0]
    x = solve(np.block([[r[i + p - 1 - j] for j in range(p)] for i in range(p)]), np.concatenate(y))
    return [x[i * d : (i + 1) * d] for i in range(p)]


def spectral_radius(coeffs: list[np.ndarray]) -> float:
    """Largest modulus of the companion matrix' eigenvalues; below 1 for a stable model."""
    p, d = len(coeffs), coeffs[0].shape[0]
    companion = np.zeros((p * d, p * d))
    companion[:d] = np.concatenate(coeffs, axis=1)
    companion[d:, :-d] = np.eye((p - 1) * d)
    return float(np.abs(np.linalg.eigvals(companion)).max())


def make_stable(coeffs: list[np.ndarray], limit: float = 0.95) -> list[np.ndarray]:
    """A copy scaled down until its spectral radius is at most `limit`."""
    out = [np.array(c, float) for c in coeffs]
    while (rho := spectral_radius(out)) > limit:
        out = [c * (limit / rho) for c in out]
    return out


def rbf_smooth(matrix: np.ndarray, width_x: int, width_y: int, sigma_x: float, sigma_y: float) -> np.ndarray:
    """Separable Gaussian smoothing, exp(-distance^2 / sigma), truncated and weight-normalised; rows first, then columns."""

    def along(m: np.ndarray, width: int, sigma: float) -> np.ndarray:
        at = np.arange(len(m))
        gap = at[:, None] - at[None, :]
        w = np.where(np.abs(gap) <= width, np.exp(-(gap**2) / sigma), 0.0)
        return (w @ m) / w.sum(axis=1, keepdims=True)

    return along(along(np.asarray(matrix, float), width_x, sigma_x).T, width_y, sigma_y).T
