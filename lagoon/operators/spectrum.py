"""Spectra over sliding windows, block by block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.operators.moments import by_block
from lagoon.series import TimeSeries

#: Windows transformed at once.
CHUNK = 256


def taper(width: int) -> tuple[np.ndarray, float]:
    """Welch window 1 - u^2 and one over its power."""
    w = 1 - np.linspace(-1, 1, width) ** 2
    return w, 1 / (w**2).sum()


def _transforms(t: np.ndarray, v: np.ndarray, target: np.ndarray, width: int, reach: int):
    """FFTs [window, dim, frequency] of the tapered full windows around targets, in chunks."""
    first, last = np.searchsorted(t, t - reach, "left"), np.searchsorted(t, t + reach, "right")
    at = first[target & (last - first == width)]
    if len(t) < width:
        return
    w, _ = taper(width)
    windows = np.lib.stride_tricks.sliding_window_view(v, width, axis=0)
    for i in range(0, len(at), CHUNK):
        yield np.fft.fft(windows[at[i : i + CHUNK]] * w, axis=2)


def spectra(ts: TimeSeries, max_lag: int) -> np.ndarray:
    """S[i, j, f]: mean over full windows of F_i conj(F_j), scaled by the taper's power; Hermitian in (i, j)."""
    reach, width, d = max_lag * ts.delta, 2 * max_lag + 1, ts.dim
    ts.require(reach, reach)

    def kernel(t: np.ndarray, v: np.ndarray, target: np.ndarray) -> np.ndarray:
        total, n = np.zeros((d, d, width), complex), 0
        for f in _transforms(t, v, target, width, reach):
            total += np.einsum("nif,njf->ijf", f, f.conj())
            n += len(f)
        return np.concatenate([[n], total.real.ravel(), total.imag.ravel()])

    x = by_block(ts, reach, reach, kernel)
    if x is None or not x[0]:
        raise ValueError(f"no window has {width} rows; is the series on a grid of {ts.delta}?")
    re, im = x[1:].reshape(2, d, d, width)
    return (re + 1j * im) * taper(width)[1] / x[0]


def cross_spectrum(ts: TimeSeries, max_lag: int) -> DataFrame:
    """i, j, freq_idx, re, im, magnitude, phase (atan of im/re), angle (all four quadrants)."""
    s = spectra(ts, max_lag)
    rows = [(i, j, f, float(s[i, j, f].real), float(s[i, j, f].imag)) for i in range(ts.dim) for j in range(ts.dim) for f in range(s.shape[2])]
    df = ts.df.sparkSession.createDataFrame(rows, "i int, j int, freq_idx int, re double, im double")
    return df.select("*", F.hypot("re", "im").alias("magnitude"), F.atan(F.try_divide("im", "re")).alias("phase"), F.atan2("im", "re").alias("angle"))


def log_periodogram(ts: TimeSeries, max_lag: int) -> DataFrame:
    """dim, freq_idx, power (tapered, normalised), log_power (null at zero power)."""
    s = spectra(ts, max_lag)
    rows = [(i, f, float(s[i, i, f].real)) for i in range(ts.dim) for f in range(s.shape[2])]
    df = ts.df.sparkSession.createDataFrame(rows, "dim int, freq_idx int, power double")
    return df.withColumn("log_power", F.when(F.col("power") > 0, F.ln("power")))
