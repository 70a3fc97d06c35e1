"""Models against theory and against plain numpy; tolerances follow from the sample sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.functions import linalg
from lagoon.operators import models, moments, optim, seasonal, spatial, spectrum
from lagoon.series import TimeSeries
from lagoon.sources import generate

RNG = np.random.default_rng(1)


def series(df, d, **more):
    return TimeSeries.from_df(df, "t", [f"v{i}" for i in range(d)], **({"delta": 1, "bck": 40, "fwd": 40} | more))


def test_toeplitz_solvers():
    r, y = RNG.normal(size=9) + 3 * (np.arange(9) == 4), RNG.normal(size=5)
    t = np.array([[r[i + 4 - j] for j in range(5)] for i in range(5)])
    assert t @ linalg.toeplitz(r, y) == pytest.approx(y, abs=1e-7)
    blocks, ys = [RNG.normal(size=(3, 3)) for _ in range(5)], [RNG.normal(size=(3, 2)) for _ in range(3)]
    x = linalg.block_toeplitz(blocks, ys)
    for i in range(3):
        assert sum(blocks[i + 2 - j] @ x[j] for j in range(3)) == pytest.approx(ys[i], abs=1e-7)


def test_recursions_on_exact_covariances():
    phi, var = np.array([0.5, -0.3]), 2.0
    g = np.zeros(60)
    psi = np.zeros(4000)
    psi[0] = 1
    for k in range(1, 4000):
        psi[k] = phi[0] * psi[k - 1] + (phi[1] * psi[k - 2] if k > 1 else 0)
    g = np.array([var * psi[: 4000 - h] @ psi[h:] for h in range(60)])
    coefs, noise = linalg.durbin_levinson(g, 2)
    assert coefs == pytest.approx(phi) and noise == pytest.approx(var)
    theta, noise = linalg.innovations(np.array([1.25, 0.5] + [0.0] * 39), 1, 40)
    assert theta == pytest.approx([0.5], abs=1e-6) and noise == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        linalg.durbin_levinson(np.zeros(3), 2)


def test_varma_from_exact_psi():
    a, b = np.array([[0.4, 0.1], [0.0, 0.3]]), np.array([[0.2, 0.0], [0.1, 0.2]])
    psi = [a + b, a @ (a + b)]
    ar, ma = models.arma_from_psi(psi, 1, 1)
    assert ar[0] == pytest.approx(a) and ma[0] == pytest.approx(b)
    ar, ma = models.arma_from_psi([a + b, a @ (a + b), a @ a @ (a + b)], 1, 2)  # p < q
    assert ar[0] == pytest.approx(a) and ma[1] == pytest.approx(np.zeros((2, 2)), abs=1e-12)


def test_stability():
    wild = [np.array([[1.5, 0.2], [0.1, 0.9]]), np.array([[0.3, 0.0], [0.0, 0.2]])]
    calm = linalg.make_stable(wild)
    assert linalg.spectral_radius(wild) > 1 and linalg.spectral_radius(calm) <= 0.95 + 1e-9 and wild[0][0, 0] == 1.5


def test_white_noise_and_ma_covariances(spark):
    n = 20_000
    ts = series(generate.white_noise(spark, 2, n, magnitudes=[2.0, 2.0], seed=3), 2)
    cov = moments.cross_covariance(ts, 3).matrices()
    assert np.abs(cov[3] - 4 * np.eye(2)).max() < 20 / np.sqrt(n)
    assert all(np.abs(cov[3 + h]).max() < 20 / np.sqrt(n) for h in (1, 2, 3))
    assert all((cov[3 - h] == cov[3 + h].T).all() for h in range(4))
    ma = series(generate.ma(spark, [[0.5]], n, sigma=2.0, seed=4), 1)
    cov = moments.cross_covariance(ma, 2).matrices()[:, 0, 0]
    assert cov == pytest.approx([0, 2, 5, 2, 0], abs=30 / np.sqrt(n))
    assert moments.cross_correlation(ma, 1).matrices()[:, 0, 0] == pytest.approx([0.4, 1, 0.4], abs=4 / np.sqrt(n))


def test_models_recover_parameters(spark):
    n, tol = 40_000, 0.04
    phi = [RNG.uniform(-0.2, 0.2, (3, 3)) for _ in range(2)]
    fit = models.fit_var(series(generate.var(spark, phi, n, sigma=0.5, seed=5), 3), 2)
    assert np.abs(np.array(fit.ar) - phi).max() < tol and np.abs(fit.noise - 0.25 * np.eye(3)).max() < 0.01
    theta = np.array([[0.5, 0.1], [0.0, -0.4]])
    fit = models.fit_vma(series(generate.vma(spark, [theta], n, seed=6), 2), 1, depth=20)
    assert np.abs(fit.ma[0] - theta).max() < tol
    a, b = np.array([[0.5, 0.1], [0.0, 0.4]]), np.array([[0.4, 0.0], [0.1, 0.3]])
    fit = models.fit_varma(series(generate.varma(spark, [a], [b], n, seed=7), 2), 1, 1, depth=30)
    assert np.abs(fit.ar[0] - a).max() < 3 * tol and np.abs(fit.ma[0] - b).max() < 3 * tol
    ar = models.fit_ar(series(generate.ar(spark, [[0.5, -0.3], [0.2]], n, seed=8), 2), 2)
    assert ar.ar[0] == pytest.approx([0.5, -0.3], abs=tol) and ar.ar[1] == pytest.approx([0.2, 0.0], abs=tol)
    arma = models.fit_arma(series(generate.arma(spark, [[0.6]], [[0.3]], n, seed=9), 1), 1, 1, depth=30)
    assert (arma.ar[0][0], arma.ma[0][0]) == pytest.approx((0.6, 0.3), abs=2 * tol)
    ma = models.fit_ma(series(generate.ma(spark, [[0.5]], n, seed=10), 1), 1, depth=20)
    assert ma.ma[0] == pytest.approx([0.5], abs=tol)
    assert models.fit_var(series(generate.var(spark, phi, 500, seed=5), 3), 1).to_df(spark).count() == 18


def test_partial_correlation_is_the_transposed_model(spark):
    ts = series(generate.var(spark, [[[0.4, 0.2], [0.0, 0.3]]], 3000, seed=2), 2)
    found, first = moments.partial_cross_correlation(ts, 1)
    assert found[0] == pytest.approx(models.fit_var(ts, 1).ar[0].T) and (first == found[0]).all()


@pytest.mark.parametrize("block", [4, 100_000])
def test_residuals(spark, block):
    x = RNG.normal(size=(80, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "t long, v0 double, v1 double").repartition(3)
    phi, m = [RNG.normal(size=(2, 2)) for _ in range(2)], np.array([0.3, -0.2])
    ts = series(df, 2, block=block)
    got = np.array([(r["r0"], r["r1"]) for r in models.var_residuals(ts, phi, m).orderBy("t").collect()])
    z = x - m
    want = z - np.array([sum((phi[h] @ z[t - 1 - h] for h in range(2) if t > h), np.zeros(2)) for t in range(80)])
    assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        models.var_residuals(ts, [np.eye(3)])
    with pytest.raises(ValueError):
        models.ar_residuals(ts, [np.array([0.5])])


def test_ar_loss_from_moments(spark):
    x = RNG.normal(size=(300, 2)).cumsum(axis=0) * 0.1
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "t long, v0 double, v1 double")
    problem = optim.ARLoss(moments.lag_gram(series(df, 2, block=32), 2), np.array([0.5, 2.0]))
    a, z = [RNG.normal(size=(2, 2)) for _ in range(2)], x - x.mean(axis=0)
    e = z[2:] - z[1:-1] @ a[0].T - z[:-2] @ a[1].T
    assert problem.loss(a) == pytest.approx(((e**2) / [0.5, 2.0]).sum(axis=1).mean())
    step = [np.zeros((2, 2)), np.array([[0, 1e-6], [0, 0]])]
    slope = (problem.loss([p + s for p, s in zip(a, step, strict=True)]) - problem.loss(a)) / 1e-6
    assert problem.gradient(a)[1][0, 1] == pytest.approx(slope, rel=1e-3)


def test_gradient_estimators(spark):
    phi = [np.array([[0.5, 0.0], [0.0, -0.4]])]
    ts = series(generate.var(spark, phi, 20_000, seed=12), 2)
    assert np.abs(optim.fit_var_gd(ts, 1).ar[0] - phi[0]).max() < 0.03
    sparse = optim.fit_var_l1(ts, 1, 0.1).ar[0]
    assert sparse[0, 1] == sparse[1, 0] == 0 and 0.3 < sparse[0, 0] < 0.5
    kept = optim.fit_var_l1(ts, 1, 0.1, truncate=0.05).ar[0]
    assert kept[0, 0] == pytest.approx(0.5, abs=0.03) and abs(kept[0, 1]) < 0.02
    ma = series(generate.ma(spark, [[0.5]], 4000, seed=13), 1)
    assert optim.fit_vma_gd(ma, 1, max_iter=4).ma[0][0, 0] == pytest.approx(0.5, abs=0.06)


@pytest.mark.parametrize("block", [10, 1000])
def test_spectrum_against_numpy(spark, block):
    x, lags = RNG.normal(size=(60, 2)), 3
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "t long, v0 double, v1 double")
    ts = series(df, 2, block=block)
    w, scale = spectrum.taper(7)
    want = np.zeros((2, 2, 7), complex)
    for t in range(3, 57):
        f = np.fft.fft(x[t - 3 : t + 4].T * w)
        want += f[:, None] * f[None].conj()
    got = spectrum.spectra(ts, lags)
    assert got == pytest.approx(want * scale / 54) and got[0, 1] == pytest.approx(got[1, 0].conj())
    row = spectrum.cross_spectrum(ts, lags).where("i = 0 and j = 1 and freq_idx = 2").first()
    assert row["magnitude"] == pytest.approx(abs(got[0, 1, 2])) and row["angle"] == pytest.approx(np.angle(got[0, 1, 2]))
    with pytest.raises(ValueError):
        spectrum.spectra(series(df, 2, bck=1), lags)


def test_season_and_smoothing(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "t long, v0 double")
    ts, bucket = series(df, 1), F.pmod("t", F.lit(3))
    profile = seasonal.mean_profile(ts, bucket)
    assert {r["v0"] for r in seasonal.remove_season(ts, profile, bucket).df.collect()} == {0.0}
    part = seasonal.remove_season(ts, profile.where("bucket > 0"), bucket).df
    assert part.where("no_profile").count() == 10 and part.where("v0 is null").count() == 10
    m = linalg.rbf_smooth(np.ones((4, 5)), 1, 2, 1.0, 2.0)
    assert m == pytest.approx(np.ones((4, 5)))


def test_quadtree_holds_its_points(spark):
    points = [(float(a), float(b)) for a, b in np.clip(RNG.normal(0.2, 0.2, (400, 2)), 0, 1)] + [(1.0, 1.0), (0.0, 0.0), (2.0, 0.5)]
    df = spark.createDataFrame(points, "lon double, lat double")
    box = (0.0, 0.0, 1.0, 1.0)
    tree = spatial.QuadTree.build(spatial.grid_counts(df, "lon", "lat", box, 16, 16), box, 16, 16, 30)
    assert sum(x.n for x in tree.leaves) == 402
    counts = {r["leaf_id"]: r["count"] for r in tree.align(df, "lon", "lat").groupBy("leaf_id").count().collect()}
    assert counts.pop(None) == 1 and counts == {x.leaf_id: x.n for x in tree.leaves if x.n}
    spatial_small = spatial.BROADCAST_CELLS
    try:
        spatial.BROADCAST_CELLS = 0  # a shuffle join
        again = {r["leaf_id"]: r["count"] for r in tree.align(df, "lon", "lat").groupBy("leaf_id").count().collect()}
    finally:
        spatial.BROADCAST_CELLS = spatial_small
    assert again.pop(None) == 1 and again == counts
    one = spatial.QuadTree.build(spatial.grid_counts(df, "lon", "lat", box, 1, 1), box, 1, 1, 0)
    assert len(one.leaves) == 1


@pytest.mark.parametrize("p,q", [(2, 0), (0, 2), (2, 1), (1, 3)])
def test_generated_blocks_are_one_recursion(spark, monkeypatch, p, q):
    """A series in blocks is the series of one block: the state is carried over every edge."""
    phis = [np.array([[0.5, 0.2], [-0.1, 0.3]]) / (h + 1) for h in range(p)]
    thetas = [np.array([[0.4, 0.0], [0.3, -0.2]]) / (h + 1) for h in range(q)]
    how = {"sigma": 2.0, "magnitudes": [1.5, 0.5], "seed": 3, "kind": "md5"}
    rows = lambda: np.array([r[:] for r in generate.varma(spark, phis, thetas, 50, **how).orderBy("t").collect()])
    whole = rows()
    e = 2.0 * generate._noise("md5", 3, 0, 0, 50, 2)
    assert whole[:, 1:] == pytest.approx(generate.simulate(50, phis, thetas, e, np.array([1.5, 0.5])))
    monkeypatch.setattr(generate, "CHUNK", 7)
    assert rows() == pytest.approx(whole)
