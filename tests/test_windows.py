"""Windows against brute force, on awkward series and for every block width."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagoon.operators import intervals, joins, moments, resample, windows
from lagoon.series import TICK, TimeSeries

RNG = np.random.default_rng(0)


def frame(spark, ticks, values, **more):
    rows = [(int(t), *(None if x is None else float(x) for x in np.atleast_1d(v))) for t, v in zip(ticks, values, strict=True)]
    d = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"v{i} double" for i in range(d))).repartition(3)
    return TimeSeries.from_df(df, "k", [f"v{i}" for i in range(d)], **({"delta": 1, "bck": 5, "fwd": 5} | more))


SERIES = {
    "grid": np.arange(60),
    "gaps": np.sort(RNG.choice(200, 60, replace=False)),
    "peers": np.sort(RNG.integers(0, 40, 60)),
    "negative": np.arange(-30, 30),
    "one": np.array([7]),
}


@pytest.mark.parametrize("name", SERIES)
@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_sliding_sums(spark, name, block):
    t = SERIES[name]
    x = np.arange(len(t)) * 1.5
    for bck, fwd in ((5, 5), (4, 0), (0, 3)):
        got = windows.sliding_agg(frame(spark, t, x, block=block), {"s": F.sum("v0"), "n": F.count("*")}, bck, fwd)
        want = sorted((int(a), float(x[(t >= a - bck) & (t <= a + fwd)].sum()), int(((t >= a - bck) & (t <= a + fwd)).sum())) for a in t)
        assert sorted((r["k"], r["s"], r["n"]) for r in got.collect()) == want


@pytest.mark.parametrize("block", [2, 9, 1000])
def test_kernel_and_fold(spark, block):
    t, x = SERIES["peers"], RNG.random(60)
    ts = frame(spark, t, x, block=block)
    got = windows.sliding_kernel(ts, lambda a, v: (float(v.max() - v.min()), len(a)) if len(a) > 3 else None, "x double, n long", 3, 2)
    want = [(int(a), float(np.ptp(x[m])), int(m.sum())) for a in t for m in [(t >= a - 3) & (t <= a + 2)] if m.sum() > 3]
    assert sorted((r[TICK], r["x"], r["n"]) for r in got.collect()) == sorted(want)
    total = windows.sliding_fold(ts, {"hi": F.max("v0"), "lo": F.min("v0")}, {"x": F.sum(F.col("hi") - F.col("lo"))}, bck=3, fwd=2).first()["x"]
    assert total == pytest.approx(sum(np.ptp(x[(t >= a - 3) & (t <= a + 2)]) for a in t))


@pytest.mark.parametrize("block", [3, 1000])
def test_panels(spark, block):
    rows = [(g, int(t), float(x)) for g in ("a", "b", None) for t, x in zip(SERIES["peers"], RNG.random(60), strict=True)]
    df = spark.createDataFrame(rows, "g string, k long, v0 double").repartition(3)
    ts = TimeSeries.from_df(df, "k", "v0", delta=1, bck=5, fwd=5, keys=("g",), block=block)
    got = sorted((str(r["g"]), r["k"], round(r["s"], 9)) for r in windows.sliding_agg(ts, {"s": F.sum("v0")}, 2, 3).collect())
    again = sorted((str(r["g"]), r[TICK], round(r["s"], 9)) for r in windows.sliding_kernel(ts, lambda a, v: (float(v.sum()),), "s double", 2, 3).collect())
    want = sorted((str(g), t, round(sum(x for h, u, x in rows if h == g and t - 2 <= u <= t + 3), 9)) for g, t, _ in rows)
    assert got == want == again
    gram = moments.lag_gram(ts, 1)
    assert gram.n == 180 and gram.total[0] == pytest.approx(sum(x for _, _, x in rows))


def test_ones_in_a_symmetric_window(spark):
    """h rows at both edges have no full window; the fold of full ones is (2h + 1)(n - 2h)."""
    n, h = 800, 5
    got = windows.sliding_agg(frame(spark, range(n), np.ones(n), block=64), {"s": F.sum("v0")}, h, h, full=2 * h + 1)
    assert got.count() == n - 2 * h and {r["s"] for r in got.collect()} == {2 * h + 1.0}


@pytest.mark.parametrize("bck,fwd", [(0, 0), (3, 0), (2, 4)])
def test_memory_has_one_state_for_each_series(spark, bck, fwd):
    t = np.concatenate([SERIES["gaps"], SERIES["peers"]])
    g = np.repeat([1, 2], 60)
    rows = [(int(a), int(b), float(i)) for i, (a, b) in enumerate(zip(t, g, strict=True))]
    df = spark.createDataFrame(rows, "k long, g long, v0 double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        ts = TimeSeries.from_df(df, "k", "v0", delta=1, keys=("g",))
        got = windows.sliding_with_memory(ts, lambda a, v, s: ((float(v.sum()) + s, s), s + 1), 0, "x double, i long", bck, fwd).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in (1, 2):
        own = sorted((a, v) for a, b, v in rows if b == key)
        at = np.array([a for a, _ in own])
        sums = sorted(float(sum(v for b, v in own if a - bck <= b <= a + fwd)) for a in at)
        mine = [r for r in got if r["g"] == key]
        assert sorted(r["i"] for r in mine) == list(range(60))
        assert sorted(r["x"] - r["i"] for r in mine) == sums
        assert [r[TICK] for r in sorted(mine, key=lambda r: r["i"])] == sorted(at.tolist())
    fold = windows.fold_with_memory(ts, lambda a, v, s: ((s,), s + 1), 0, "i long", {"n": F.sum("i")}, bck=0, fwd=0)
    assert {r["n"] for r in fold.collect()} == {60 * 59 // 2}


def test_targets_and_filters(spark):
    t, x = SERIES["gaps"], RNG.random(60)
    ts = frame(spark, t, x)
    targets = spark.createDataFrame([(int(a),) for a in range(-5, 210, 7)], "at long")
    got = {r["at"]: r["n"] for r in windows.at_targets(ts, targets, "at", {"n": F.count("*")}, 3, 4).collect()}
    want = {a: int(((t >= a - 3) & (t <= a + 4)).sum()) for a in range(-5, 210, 7)}
    assert got == {a: n for a, n in want.items() if n}
    near = windows.sliding_agg(ts, {"n": F.count("*")}, 3, 4, target_filter="k > 50", window_filter="n >= 2")
    assert sorted(r["k"] for r in near.collect()) == [int(a) for a in t if a > 50 and ((t >= a - 3) & (t <= a + 4)).sum() >= 2]
    part = ts.between(50, 60)
    assert part.df.agg(F.min("k"), F.max("k")).first()[:] == (t[t >= 45].min(), t[t <= 65].max())


def test_collect_take_reduce(spark):
    t, x = SERIES["grid"], RNG.random((60, 2))
    ts = frame(spark, t, x)
    ticks, values = ts.collect()
    assert (ticks == t).all() and (values == x).all()
    assert [r["k"] for r in ts.take(3)] == [0, 1, 2] and ts.count() == 60
    assert len(ts.collect(sample=20, seed=1)[0]) < 60
    got = ts.reduce(lambda a, b: F.zip_with(a, b, lambda p, q: F.least(p, q))).first()["value"]
    assert got == x.min(axis=0).tolist()
    assert ts.to_long().count() == 120 and ts.dims(1, 2).dim == 1
    with pytest.raises(ValueError):
        ts.require(bck=6)
    with pytest.raises(ValueError):
        TimeSeries.from_df(ts.df, "k", "nope", delta=1)


def brute_covariance(t, x, lags):
    d = x.shape[1]
    out, n = np.zeros((2 * lags + 1, d, d)), 0
    for i, a in enumerate(t):
        m = np.flatnonzero((t >= a - lags) & (t <= a))
        if len(m) == lags + 1:
            n += 1
            for h in range(lags + 1):
                out[lags - h] += np.outer(x[i], x[m[-1 - h]])
    mean = x.mean(axis=0)
    out[: lags + 1] = out[: lags + 1] / n - np.outer(mean, mean)
    for h in range(1, lags + 1):
        out[lags + h] = out[lags - h].T
    return out


@pytest.mark.parametrize("name", ["grid", "gaps", "negative"])
@pytest.mark.parametrize("block", [1, 5, 1000])
@pytest.mark.parametrize("lags,d", [(2, 2), (4, 3)])  # a column plan, and the block kernel
def test_cross_covariance(spark, name, block, lags, d):
    t, x = SERIES[name], RNG.normal(size=(60, d))
    if name == "gaps":
        t = np.sort(RNG.choice(70, 60, replace=False))
    got = moments.cross_covariance(frame(spark, t, x, block=block), lags).matrices()
    assert got == pytest.approx(brute_covariance(t, x, lags), abs=1e-9)


def test_moment_edges(spark):
    few = frame(spark, [0, 1], [[1.0], [2.0]])
    assert np.isnan(moments.cross_covariance(few, 3).matrices()).all()
    with pytest.raises(ValueError):
        moments.lag_covariances(few, 3)
    with pytest.raises(ValueError):
        moments.cross_covariance(few, 9)
    flat = moments.cross_correlation(frame(spark, range(30), np.ones((30, 1))), 1).df
    assert {r["value"] for r in flat.collect()} == {None}
    x = RNG.normal(size=(50, 2))
    ts = frame(spark, range(50), x)
    second = {(r["i"], r["j"]): r["value"] for r in moments.second_moment(ts, x.mean(axis=0)).collect()}
    assert all(second[i, j] == pytest.approx(np.cov(x.T, bias=True)[i, j]) for i in (0, 1) for j in (0, 1))
    halved = TimeSeries.from_df(ts.df.drop(TICK), "k", ["v0"], delta=1, n_samples=100)
    assert moments.average(halved).first()["mean"] == pytest.approx(x[:, 0].mean() / 2)


def test_resampling_edges(spark):
    df = spark.createDataFrame([(3, 1.0), (7, None), (-1, 2.0)], "k long, v double")
    grid = resample.fill_grid(df, "k", ["v"])
    assert sorted((r["k"], r["v"]) for r in grid.collect()) == [(k, {3: 1.0, -1: 2.0}.get(k, 0.0)) for k in range(-1, 8)]
    assert resample.fill_grid(df.limit(0), "k", ["v"]).collect() == []
    resample.GRID_PIECE, piece = 3, resample.GRID_PIECE
    try:
        again = resample.fill_grid(df, "k", ["v"], delta=2)
        assert sorted(r["k"] for r in again.collect()) == [-1, 1, 3, 5, 7]
    finally:
        resample.GRID_PIECE = piece
    assert sorted((r["k"], r["v"]) for r in resample.sum_resample(df, F.floor(F.col("k") / 4), ["v"], 2).collect()) == [(-1, 2.0), (0, 1.0), (1, None)]


def test_asof_join_with_tolerance(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5), (1, 3)], "g long, t long")
    right = spark.createDataFrame([(1, 9, "a"), (1, 12, "b"), (1, 20, "c")], "g long, t long, x string")
    got = sorted(tuple(r) for r in joins.asof_join(left, right, "t", ["g"], ["x"], tolerance=2).collect())
    assert got == [(1, 3, None), (1, 10, "a"), (1, 20, "c"), (2, 5, None)]


def test_intervals(spark):
    df = spark.createDataFrame([(int(x),) for x in SERIES["peers"]], "k long")
    found = intervals.cut_points(df, "k", 4)
    assert found[0][0] == SERIES["peers"].min() and found[-1][1] == SERIES["peers"].max()
    assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
    probe = spark.createDataFrame([(-100,), (found[1][0],), (found[1][0] + 1,), (1000,)], "k long")
    assert [r[0] for r in probe.orderBy("k").select(intervals.interval_of(F.col("k"), found)).collect()] == [0, 0, 1, len(found) - 1]
    assert intervals.cut_points(df.limit(0), "k", 4) == [] and intervals.cut_points(df.limit(1), "k", 1)[0][0] == df.first()[0]
    with pytest.raises(ValueError):
        intervals.cut_points(df, "k", 0)
    parts = intervals.range_partitioned(df, "k", 3).select("k", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("a").collect()
    assert all(x["b"] <= y["a"] for x, y in zip(parts, parts[1:], strict=False))


@pytest.mark.parametrize("d", [2, 3])  # a column plan, and the block kernel
def test_null_rows_are_no_observations(spark, d):
    """Both ways to the lag moments leave out rows with a null value, and windows that lack them."""
    lags, x = 6, RNG.normal(size=(200, d))
    rows = [[None if (i, j) in ((20, 0), (90, 1), (91, 0)) else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    assert ((lags + 1) * d * d <= moments.SQL_PRODUCTS) == (d == 2)
    keep = np.array([None not in r for r in rows])
    want = brute_covariance(np.arange(200)[keep], x[keep], lags)
    ts = frame(spark, range(200), rows, bck=lags, block=40)
    assert moments.cross_covariance(ts, lags).matrices() == pytest.approx(want, abs=1e-9)
    own = {(r["dim"], r["lag"]): r["value"] for r in moments.auto_covariance(ts, lags, x[keep].mean(axis=0)).collect()}
    assert all(own[i, h] == pytest.approx(want[lags - h, i, i], abs=1e-9) for i in range(d) for h in range(lags + 1))
    assert np.isfinite(moments.cross_correlation(ts, lags).matrices()).all()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocks_do_not_change_joins_and_sessions(spark, block):
    rng = np.random.default_rng(3)
    keys = [int(k) if k else None for k in rng.integers(0, 4, 200)]
    df = spark.createDataFrame([(k, int(t), i, "x") for i, (k, t) in enumerate(zip(keys, rng.integers(0, 90, 200), strict=True))], "g int, t long, i int, _side string")
    left, right = df.where("i % 2 = 0"), df.where("i % 2 = 1").groupBy("g", "t").agg(F.max("i").alias("v"))
    rows = lambda x: sorted(map(tuple, x.collect()), key=repr)
    for tolerance in (None, 4):
        assert rows(joins.asof_join(left, right, "t", ["g"], ["v"], tolerance, block)) == rows(joins.asof_join(left, right, "t", ["g"], ["v"], tolerance))
    count = lambda x: rows(x.groupBy("g", "session").agg(F.count("*"), F.min("t"), F.max("t")))
    assert count(joins.sessions(df, ["g"], "t", 2, block)) == count(joins.sessions(df, ["g"], "t", 2))


def test_names_that_windows_use_are_refused(spark):
    with pytest.raises(ValueError):
        TimeSeries.from_df(spark.range(3).selectExpr("id as k", "id as v", "id as _blk"), "k", "v", delta=1)
