"""Named queries over the shared tables, each with the SQL that gives the same rows where SQL can say it.

Main series: sums of event values by hour, for two event types, on a full grid. Sums of two-decimal
values are taken in decimals, so that both engines get the same doubles; other results are rounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagoon.functions import tables
from lagoon.functions import time as tf
from lagoon.functions.linalg import make_stable, spectral_radius
from lagoon.operators import intervals, joins, models, moments, optim, resample, seasonal, spatial, spectrum, windows
from lagoon.series import TICK, TimeSeries
from lagoon.sources import generate
from lagoon.streaming import streams

HOUR = tf.MICROS["h"]
NAMES = ["click", "error"]
LAGS = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hourly(spark: SparkSession, sf_dir: str, names=NAMES, bck: int = 6, fwd: int = 6) -> TimeSeries:
    grid = resample.hourly_grid(_table(spark, sf_dir, "events"), "ts", "event_type", list(names), "value")
    return TimeSeries.from_df(grid, "k", [f"v{i}" for i in range(len(names))], delta=1, bck=bck, fwd=fwd, block=256)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return events.withColumn("t", tf.micros(events, "ts"))


def _panel(spark: SparkSession, sf_dir: str, bck: int = 6 * HOUR, fwd: int = 6 * HOUR) -> TimeSeries:
    return TimeSeries.from_df(_events(spark, sf_dir).select("t", "user_id", "event_id", "value"), "t", "value", delta=HOUR, bck=bck, fwd=fwd, keys=("user_id",))


def _round(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def _dec(col) -> F.Column:
    return F.sum(F.col(col).cast("decimal(28,2)")).cast("double")


# SQL of the main series, and pieces of SQL
S = """b AS (SELECT epoch_us(ts) // 3600000000 AS k,
  CAST(SUM(CAST(CASE WHEN event_type = 'click' THEN value ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS v0,
  CAST(SUM(CAST(CASE WHEN event_type = 'error' THEN value ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS v1
  FROM events GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(k) FROM b), (SELECT max(k) FROM b))) AS k),
s AS (SELECT g.k, COALESCE(v0, 0) AS v0, COALESCE(v1, 0) AS v1 FROM g LEFT JOIN b USING (k))"""


def _lag_sql(mean0: str = "(SELECT avg(v0) FROM s)", mean1: str = "(SELECT avg(v1) FROM s)", lags: int = LAGS) -> str:
    """c(h, i, j, value): E x_t[i] x_{t-h}[j] over full windows, less the means' product."""
    shifted = ", ".join(f"lag(v{j}, {h}) OVER (ORDER BY k) AS l{h}_{j}" for h in range(1, lags + 1) for j in (0, 1))
    parts = [
        f"SELECT {h} AS h, {i} AS i, {j} AS j, avg(v{i} * {f'l{h}_{j}' if h else f'v{j}'}) - {(mean0, mean1)[i]} * {(mean0, mean1)[j]} AS value FROM w WHERE l{lags}_0 IS NOT NULL"
        for h in range(lags + 1) for i in (0, 1) for j in (0, 1)
    ]
    return f"w AS (SELECT *, {shifted} FROM s), c AS ({' UNION ALL '.join(parts)})"


BOTH = f"WITH {S}, {_lag_sql()}, x AS (SELECT -h AS lag, i, j, value FROM c UNION ALL SELECT h, j, i, value FROM c WHERE h > 0)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# resampling and merging


@query("SELECT epoch_us(ts) // 3600000000 AS k, event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def sum_resample_hourly(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return resample.resample(events, {"k": resample.bucket(events, "ts", "1h"), "event_type": F.col("event_type")}, {"total": _dec("value")})


@query("SELECT epoch_us(ts) // 3600000000 AS k, round(CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 6) AS mean FROM events GROUP BY 1")
def mean_resample_hourly(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return resample.resample(events, {"k": resample.bucket(events, "ts", "1h")}, {"mean": _dec("value") / F.count("*")}, after={"mean": F.round("mean", 6)})


@query("SELECT epoch_us(ts) // 60000000 + 1 AS k, COUNT(*) AS n FROM events GROUP BY 1")
def minute_align_count(spark, sf_dir):
    return resample.align_up_count(_table(spark, sf_dir, "events"), "ts", "1m")


@query(f"WITH {S} SELECT k, v0, v1 FROM s")
def fill_hourly_grid(spark, sf_dir):
    return _hourly(spark, sf_dir).df.select("k", "v0", "v1")


@query("""SELECT epoch_us(o_orderdate) // 86400000000 AS k,
  CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS f,
  CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS o,
  CAST(SUM(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS p FROM orders GROUP BY 1""")
def pivot_outer_merge(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    out = resample.pivot_merge(orders, resample.bucket(orders, "o_orderdate", "1d"), "o_orderstatus", ["F", "O", "P"], _dec("o_totalprice"))
    return out.select("k", *(F.col(c).alias(c.lower()) for c in ("F", "O", "P")))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, user_id, value FROM events WHERE event_type = 'error'")
def row_bind(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    parts = [events.where(F.col("event_type") == n).drop("event_type") for n in NAMES]
    return parts[0].unionByName(parts[1])


# projections, filters, reductions


@query(f"WITH {S} SELECT k, round(sqrt(v0), 6) AS r0, round(ln(v1 + 1), 6) AS r1 FROM s")
def map_transform(spark, sf_dir):
    ts = _hourly(spark, sf_dir).with_values(r0=F.sqrt("v0"), r1=F.ln(F.col("v1") + 1))
    return _round(ts.df.select("k", "r0", "r1"), 6, "r0", "r1")


@query(f"WITH {S} SELECT k, v0, v1 FROM s WHERE v0 > 50 AND k % 2 = 0")
def filter_series(spark, sf_dir):
    return _hourly(spark, sf_dir).filter("v0 > 50 and k % 2 = 0").df.select("k", "v0", "v1")


@query("SELECT vec_id, round(CAST(embedding[3] AS DOUBLE), 6) AS e2, round(CAST(embedding[5] AS DOUBLE), 6) AS e4 FROM embeddings")
def dimension_slice(spark, sf_dir):
    ts = TimeSeries.from_array(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 64, delta=1)
    part = ts.dims(2, 5)
    return part.df.select("vec_id", *(F.round(part.values[i], 6).alias(f"e{i + 2}") for i in (0, 2)))


@query("SELECT min(epoch_us(ts)) AS first_t, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS most FROM events")
def reduce_min_sum(spark, sf_dir):
    return TimeSeries.from_df(_events(spark, sf_dir), "t", "value", delta=1).fold(first_t=F.min("t"), total=_dec("value"), most=F.max("value"))


@query("SELECT event_type, round(sum(sqrt(value)), 4) AS total, COUNT(*) AS n FROM events GROUP BY 1")
def fold_sqrt_sum(spark, sf_dir):
    ts = TimeSeries.from_df(_events(spark, sf_dir), "t", "value", delta=1, keys=("event_type",))
    return _round(ts.fold(total=F.sum(F.sqrt("value")), n=F.count("*")), 4, "total")


@query("SELECT max(v0) AS m0, max(v1) AS m1 FROM (WITH " + S + " SELECT * FROM s)")
def reduce_combine_max(spark, sf_dir):
    out = _hourly(spark, sf_dir).reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)), "m")
    return out.select(F.get("m", F.lit(0)).alias("m0"), F.get("m", F.lit(1)).alias("m1"))


@query("SELECT COUNT(*) AS n FROM events")
def count_series(spark, sf_dir):
    return TimeSeries.from_df(_events(spark, sf_dir), "t", "value", delta=1).fold(n=F.count("*"))


@query("SELECT event_id, epoch_us(ts) AS t, value FROM events ORDER BY ts, event_id LIMIT 100")
def take_first_n(spark, sf_dir):
    return _events(spark, sf_dir).orderBy("t", "event_id").limit(100).select("event_id", "t", "value")


@query("SELECT event_id, user_id, rank FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def top_k_by_key(spark, sf_dir):
    out = joins.ranked(_table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), "event_id"])
    return out.where("rank <= 3").select("event_id", "user_id", F.col("rank").cast("long").alias("rank"))


# moments


@query(f"WITH {S} SELECT 0 AS dim, round(avg(v0), 6) AS mean FROM s UNION ALL SELECT 1, round(avg(v1), 6) FROM s")
def series_mean(spark, sf_dir):
    return _round(moments.average(_hourly(spark, sf_dir)), 6, "mean")


_CELLS = [(i, j) for i in (0, 1) for j in (0, 1)]


@query(f"WITH {S} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(avg(v{i} * v{j}), 4) AS value FROM s" for i, j in _CELLS))
def second_moment(spark, sf_dir):
    return _round(moments.second_moment(_hourly(spark, sf_dir)), 4, "value")


@query(f"WITH {S} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(covar_pop(v{i}, v{j}), 4) AS value FROM s" for i, j in _CELLS))
def covariance(spark, sf_dir):
    return _round(moments.centred_covariance(_hourly(spark, sf_dir)), 4, "value")


@query(f"{BOTH} SELECT lag, i, j, round(value, 4) AS value FROM x")
def cross_covariance(spark, sf_dir):
    return _round(moments.cross_covariance(_hourly(spark, sf_dir), LAGS).df, 4, "value")


@query(f"{BOTH} SELECT x.lag, x.i, x.j, round(x.value / sqrt(a.value * b.value), 6) AS value FROM x JOIN c a ON a.h = 0 AND a.i = x.i AND a.j = x.i JOIN c b ON b.h = 0 AND b.i = x.j AND b.j = x.j")
def cross_correlation(spark, sf_dir):
    return _round(moments.cross_correlation(_hourly(spark, sf_dir), LAGS).df, 6, "value")


@query(f"WITH {S}, {_lag_sql('0', '0')} SELECT i AS dim, h AS lag, round(value, 4) AS value FROM c WHERE i = j")
def auto_covariance(spark, sf_dir):
    return _round(moments.auto_covariance(_hourly(spark, sf_dir), LAGS), 4, "value")


# windows

_PANEL = "SELECT event_id, round({a} OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND {f}), 4) AS x{m} FROM events"


@query(_PANEL.format(a="sum(value)", f="INTERVAL 6 HOUR FOLLOWING", m=", COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND INTERVAL 6 HOUR FOLLOWING) AS n"))
def moving_sum_sym(spark, sf_dir):
    out = windows.sliding_agg(_panel(spark, sf_dir), {"x": F.sum("value"), "n": F.count("*")})
    return _round(out.select("event_id", "x", "n"), 4, "x")


@query(_PANEL.format(a="avg(value)", f="CURRENT ROW", m=""))
def moving_avg_bck_range(spark, sf_dir):
    return _round(windows.sliding_agg(_panel(spark, sf_dir), {"x": F.avg("value")}, fwd=0).select("event_id", "x"), 4, "x")


_HALO = "WITH " + S + ", w AS (SELECT k, v0, CAST(sum(v0) OVER f AS DOUBLE) AS x, COUNT(*) OVER f AS n FROM s WINDOW f AS (ORDER BY k RANGE BETWEEN 4 PRECEDING AND 2 FOLLOWING)) "


@query(_HALO + "SELECT k, round(x, 4) AS x FROM w WHERE n = 7")
def full_window_only(spark, sf_dir):
    return _round(windows.sliding_agg(_hourly(spark, sf_dir), {"x": F.sum("v0")}, 4, 2, full=7).select("k", "x"), 4, "x")


@query(_HALO + "SELECT k, round(x, 4) AS x FROM w WHERE k % 3 = 0")
def target_filter(spark, sf_dir):
    return _round(windows.sliding_agg(_hourly(spark, sf_dir), {"x": F.sum("v0")}, 4, 2, target_filter="k % 3 = 0").select("k", "x"), 4, "x")


@query("WITH " + S + ", w AS (SELECT k, sum(v0) OVER f AS x, min(v0) OVER f AS least FROM s WINDOW f AS (ORDER BY k RANGE BETWEEN 4 PRECEDING AND 2 FOLLOWING)) SELECT k, round(x, 4) AS x FROM w WHERE least > 0")
def window_filter(spark, sf_dir):
    return _round(windows.sliding_agg(_hourly(spark, sf_dir), {"x": F.sum("v0"), "least": F.min("v0")}, 4, 2, window_filter="least > 0").select("k", "x"), 4, "x")


@query("WITH " + S + ", w AS (SELECT (max(v0) OVER f) - (min(v0) OVER f) AS x FROM s WINDOW f AS (ORDER BY k RANGE BETWEEN 4 PRECEDING AND 2 FOLLOWING)) SELECT round(sum(x), 4) AS total, COUNT(*) AS n FROM w")
def sliding_fold_total(spark, sf_dir):
    out = windows.sliding_fold(_hourly(spark, sf_dir), {"hi": F.max("v0"), "lo": F.min("v0")}, {"total": F.sum(F.col("hi") - F.col("lo")), "n": F.count("*")}, bck=4, fwd=2)
    return _round(out, 4, "total")


@query("WITH " + S + ", t AS (SELECT DISTINCT k * 2 - k % 5 - (SELECT min(k) FROM s) AS target FROM s WHERE k % 5 = 0) SELECT target, round(sum(v0), 4) AS x, COUNT(*) AS n FROM t JOIN s ON k BETWEEN target - 4 AND target + 2 GROUP BY target")
def sliding_explicit_targets(spark, sf_dir):
    ts = _hourly(spark, sf_dir)
    first = ts.df.agg(F.min("k").alias("k0"))
    targets = ts.df.where("k % 5 = 0").join(F.broadcast(first))  # one row
    targets = targets.select((F.col("k") * 2 - F.col("k") % 5 - F.col("k0")).alias("target")).distinct()
    return _round(windows.at_targets(ts, targets, "target", {"x": F.sum("v0"), "n": F.count("*")}, 4, 2), 4, "x")


@query("WITH " + S + ", w AS (SELECT k, quantile_cont(v0, 0.5) OVER (ORDER BY k RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS x FROM s) SELECT k, round(x, 6) AS x FROM w")
def sliding_kernel_median(spark, sf_dir):
    out = windows.sliding_kernel(_hourly(spark, sf_dir), lambda t, v: (float(np.median(v[:, 0])),), "x double", 3, 3)
    return _round(out.select(F.col(TICK).alias("k"), "x"), 6, "x")


@query("SELECT user_id, epoch_us(ts) AS t, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS x FROM events")
def memory_cumulative(spark, sf_dir):
    step = lambda t, v, s: ((s[0] + 1, s[1] + float(v[-1, 0])), (s[0] + 1, s[1] + float(v[-1, 0])))
    out = windows.sliding_with_memory(_panel(spark, sf_dir, 0, 0), step, (0, 0.0), "n long, x double")
    return _round(out.select("user_id", F.col(TICK).alias("t"), "n", "x"), 4, "x")


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
r AS (SELECT user_id, t, n, value AS x FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.t, o.n, 0.7 * r.x + 0.3 * o.value FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, t, round(x, 4) AS x FROM r""")
def memory_ewma(spark, sf_dir):
    def step(t, v, s):
        x = float(v[-1, 0]) if s is None else 0.7 * s + 0.3 * float(v[-1, 0])
        return (x,), x

    out = windows.sliding_with_memory(_panel(spark, sf_dir, 0, 0), step, None, "x double")
    return _round(out.select("user_id", F.col(TICK).alias("t"), "x"), 4, "x")


@query("SELECT user_id, round(sum(x), 2) AS total FROM (SELECT user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS x FROM events) GROUP BY 1")
def memory_fold(spark, sf_dir):
    step = lambda t, v, s: ((s + float(v[-1, 0]),), s + float(v[-1, 0]))
    return _round(windows.fold_with_memory(_panel(spark, sf_dir, 0, 0), step, 0.0, "x double", {"total": F.sum("x")}), 2, "total")


@query("WITH " + S + ", a AS (SELECT k, sum(v0) OVER (ORDER BY k RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM s) SELECT k, round(max(x) OVER (ORDER BY k RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS y FROM a")
def chained_slidings(spark, sf_dir):
    ts = _hourly(spark, sf_dir)
    first = windows.sliding_agg(ts, {"x": F.sum("v0")}, 2, 0)
    return _round(windows.sliding_agg(ts.with_df(first, ["x"]), {"y": F.max("x")}, 3, 1).select("k", "y"), 4, "y")


# seasons

_WEEK = "CAST((isodow(ts) - 1) * 288 + greatest(hour(ts) * 60 + minute(ts) - 1, 0) // 5 AS BIGINT)"


@query(f"SELECT {_WEEK} AS bucket, round(avg(value), 6) AS value FROM events GROUP BY 1")
def seasonal_profile(spark, sf_dir):
    ts = TimeSeries.from_df(_events(spark, sf_dir), "t", "value", delta=1)
    return _round(seasonal.mean_profile(ts, tf.week_bucket(F.col("ts"))), 6, "value")


@query("WITH p AS (SELECT hour(ts) AS h, avg(value) AS m FROM events GROUP BY 1) SELECT event_id, round(value - m, 6) + 0.0 AS value FROM events JOIN p ON h = hour(ts)")
def remove_season(spark, sf_dir):
    ts = TimeSeries.from_df(_events(spark, sf_dir), "t", "value", delta=1)
    profile = seasonal.mean_profile(ts, tf.day_bucket(F.col("ts")))
    return _round(seasonal.remove_season(ts, profile, tf.day_bucket(F.col("ts"))).df.select("event_id", "value"), 6, "value")


@query("""WITH p AS (SELECT CAST(isodow(ts) - 1 AS INTEGER) AS day, CAST(greatest(hour(ts) * 60 + minute(ts) - 1, 0) // 60 AS INTEGER) AS hour, avg(value) AS v FROM events GROUP BY 1, 2),
g AS (SELECT CAST(d AS INTEGER) AS day, CAST(h AS INTEGER) AS hour, coalesce(v, 0) AS v FROM (SELECT unnest(range(7)) AS d), (SELECT unnest(range(24)) AS h) LEFT JOIN p ON day = d AND hour = h),
a AS (SELECT x.day, x.hour, sum(exp(-power(x.day - y.day, 2) / 1.0) * y.v) / sum(exp(-power(x.day - y.day, 2) / 1.0)) AS v FROM g x JOIN g y ON x.hour = y.hour AND abs(x.day - y.day) <= 1 GROUP BY 1, 2)
SELECT x.day, x.hour, round(sum(exp(-power(x.hour - y.hour, 2) / 4.0) * y.v) / sum(exp(-power(x.hour - y.hour, 2) / 4.0)), 6) AS value FROM a x JOIN a y ON x.day = y.day AND abs(x.hour - y.hour) <= 3 GROUP BY 1, 2""")
def smoothed_profile(spark, sf_dir):
    ts = TimeSeries.from_df(_events(spark, sf_dir), "t", "value", delta=1)
    profile = seasonal.mean_profile(ts, tf.week_bucket(F.col("ts"), 60))
    m = seasonal.smooth_profile(profile, "value", 7, 24, (1, 3), (1.0, 4.0))
    return spark.createDataFrame([(d, h, round(float(m[d, h]), 6)) for d in range(7) for h in range(24)], "day int, hour int, value double")


# models


_AR = f"WITH {S}, {_lag_sql('0', '0', 2)}, y AS (SELECT i, max(CASE WHEN h = 0 THEN value END) AS g0, max(CASE WHEN h = 1 THEN value END) AS g1, max(CASE WHEN h = 2 THEN value END) AS g2 FROM c WHERE i = j GROUP BY i) "


@query(_AR + "SELECT i AS dim, 'ar' AS kind, 1 AS lag, round(g1 * (g0 - g2) / (g0 * g0 - g1 * g1), 6) AS value FROM y UNION ALL SELECT i, 'ar', 2, round((g0 * g2 - g1 * g1) / (g0 * g0 - g1 * g1), 6) FROM y UNION ALL SELECT i, 'noise', 0, round(g0 - g1 * g1 * (g0 - g2) / (g0 * g0 - g1 * g1) - g2 * (g0 * g2 - g1 * g1) / (g0 * g0 - g1 * g1), 6) FROM y")
def ar2_coef(spark, sf_dir):
    return _round(models.fit_ar(_hourly(spark, sf_dir), 2).to_df(spark), 6, "value")


@query(f"WITH {S}, {_lag_sql('0', '0', 1)}, y AS (SELECT i, max(CASE WHEN h = 0 THEN value END) AS g0, max(CASE WHEN h = 1 THEN value END) AS g1 FROM c WHERE i = j GROUP BY i) SELECT i AS dim, 'ar' AS kind, 1 AS lag, round(g1 / g0, 6) AS value FROM y UNION ALL SELECT i, 'noise', 0, round(g0 - g1 * g1 / g0, 6) FROM y")
def ar1_coef(spark, sf_dir):
    return _round(models.fit_ar(_hourly(spark, sf_dir), 1).to_df(spark), 6, "value")


@query(f"""WITH {S}, {_lag_sql(lags=1)}, y AS (SELECT
  max(CASE WHEN h=0 AND i=0 AND j=0 THEN value END) a, max(CASE WHEN h=0 AND i=0 AND j=1 THEN value END) b, max(CASE WHEN h=0 AND i=1 AND j=1 THEN value END) d,
  max(CASE WHEN h=1 AND i=0 AND j=0 THEN value END) p, max(CASE WHEN h=1 AND i=0 AND j=1 THEN value END) q, max(CASE WHEN h=1 AND i=1 AND j=0 THEN value END) r, max(CASE WHEN h=1 AND i=1 AND j=1 THEN value END) u FROM c)
SELECT 0 AS i, 0 AS j, round((p*d - q*b) / (a*d - b*b), 6) AS value FROM y UNION ALL SELECT 0, 1, round((q*a - p*b) / (a*d - b*b), 6) FROM y
UNION ALL SELECT 1, 0, round((r*d - u*b) / (a*d - b*b), 6) FROM y UNION ALL SELECT 1, 1, round((u*a - r*b) / (a*d - b*b), 6) FROM y""")
def var1_coef(spark, sf_dir):
    fitted = models.fit_var(_hourly(spark, sf_dir), 1).to_df(spark)
    return _round(fitted.where("kind = 'ar'").select("i", "j", "value"), 6, "value")


_PHI = [[0.4, -0.2], [0.3, 0.1]]


@query(f"WITH {S} SELECT k, round(v0 - 0.4 * coalesce(lag(v0, 1) OVER (ORDER BY k), 0) + 0.2 * coalesce(lag(v0, 2) OVER (ORDER BY k), 0), 6) AS r0, round(v1 - 0.3 * coalesce(lag(v1, 1) OVER (ORDER BY k), 0) - 0.1 * coalesce(lag(v1, 2) OVER (ORDER BY k), 0), 6) AS r1 FROM s")
def ar_residuals(spark, sf_dir):
    out = models.ar_residuals(_hourly(spark, sf_dir), [np.array(p) for p in _PHI])
    return _round(out.select("k", "r0", "r1"), 6, "r0", "r1")


@query(f"WITH {S}, r AS (SELECT v0 - 10 - 0.5 * coalesce(lag(v0) OVER (ORDER BY k) - 10, 0) - 0.1 * coalesce(lag(v1) OVER (ORDER BY k) - 20, 0) AS r0, v1 - 20 + 0.2 * coalesce(lag(v0) OVER (ORDER BY k) - 10, 0) AS r1 FROM s) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(avg(r{i} * r{j}), 4) AS value FROM r" for i, j in _CELLS))
def var_residual_moment(spark, sf_dir):
    ts = _hourly(spark, sf_dir)
    out = models.var_residuals(ts, [np.array([[0.5, 0.1], [-0.2, 0.0]])], [10.0, 20.0])
    return _round(moments.second_moment(models.residual_series(ts, out)), 4, "value")


def _model(fit):
    def run(spark, sf_dir):
        df = fit(_hourly(spark, sf_dir, bck=40, fwd=40)).to_df(spark)
        # variances are some 10^5 times as large as coefficients
        return df.withColumn("value", F.when(F.col("kind") == "noise", F.round("value", 3)).otherwise(F.round("value", 6)) + F.lit(0.0))

    return run


QUERIES |= {
    "ma_model": _model(lambda ts: models.fit_ma(ts, 2, moments.mean_of(ts), depth=20)),
    "arma_model": _model(lambda ts: models.fit_arma(ts, 1, 1, moments.mean_of(ts), depth=20)),
    "var_model": _model(lambda ts: models.fit_var(ts, 3)),
    "vma_model": _model(lambda ts: models.fit_vma(ts, 1, depth=20)),
    "varma_model": _model(lambda ts: models.fit_varma(ts, 1, 1, depth=20)),
    "var_gradient_descent": _model(lambda ts: optim.fit_var_gd(ts, 2)),
    "var_l1_descent": _model(lambda ts: optim.fit_var_l1(ts, 2, 0.05)),
    "var_l1_truncated": _model(lambda ts: optim.fit_var_l1(ts, 2, 0.05, truncate=0.2)),
    "vma_gradient_descent": _model(lambda ts: optim.fit_vma_gd(ts, 1, depth=20)),
}


def _eliminated(given: str, steps: int, name: str = "e") -> str:
    """name(k, i, j, x): the matrix given(i, j, x) after k steps of Gauss-Jordan elimination; rows k and below hold the Schur complement."""
    return (
        f"{name}(k, i, j, x) AS (SELECT 0, i, j, x FROM {given} UNION ALL "
        f"SELECT a.k + 1, a.i, a.j, CASE WHEN a.i = a.k THEN r.x / d.x ELSE a.x - c.x * r.x / d.x END FROM {name} a "
        f"JOIN {name} r ON r.i = a.k AND r.j = a.j JOIN {name} c ON c.i = a.i AND c.j = a.k JOIN {name} d ON d.i = a.k AND d.j = a.k WHERE a.k < {steps})"
    )


def _cell_at(k: int, i: int, j: int, table: str = "e") -> str:
    return f"(SELECT x FROM {table} WHERE k = {k} AND i = {i} AND j = {j})"


#: Yule-Walker equations: rows and columns (lag, dimension), the right side is the covariance with the present.
def _walker(lags: int) -> str:
    left = "SELECT CAST(2 * h.h + i.i AS INTEGER) AS i, CAST(2 * g.h + j.i AS INTEGER) AS j, c.value AS x FROM range({0}) h(h), range({0}) g(h), range(2) i(i), range(2) j(i), c WHERE c.h = abs(g.h - h.h) AND CASE WHEN g.h >= h.h THEN c.i = i.i AND c.j = j.i ELSE c.i = j.i AND c.j = i.i END"
    right = "SELECT CAST(2 * (c.h - 1) + c.j AS INTEGER), CAST(2 * {0} + c.i AS INTEGER), c.value FROM c WHERE c.h BETWEEN 1 AND {0}"
    return f"y AS ({left.format(lags)} UNION ALL {right.format(lags)}), {_eliminated('y', 2 * lags)}, a AS (SELECT CAST(i // 2 + 1 AS INTEGER) AS lag, CAST(j - {2 * lags} AS INTEGER) AS i, CAST(i % 2 AS INTEGER) AS j, x FROM e WHERE k = {2 * lags} AND j >= {2 * lags})"


_RECURSIVE = f"WITH RECURSIVE {S}, "
SQL["var_model"] = f"""{_RECURSIVE}{_lag_sql(lags=3)}, {_walker(3)}
SELECT 'ar' AS kind, lag, i, j, round(x, 6) + 0.0 AS value FROM a UNION ALL
SELECT 'noise', 0, c.i, c.j, round(c.value - (SELECT sum(a.x * b.value) FROM a JOIN c b ON b.h = a.lag AND b.j = a.j WHERE a.i = c.i AND b.i = c.j), 3) FROM c WHERE h = 0"""


def _innovated(lags: int, dims: int, mean0: str = "(SELECT avg(v0) FROM s)", mean1: str = "(SELECT avg(v1) FROM s)", only: int = 0) -> str:
    """e: the block Toeplitz matrix of lags 0..lags after eliminating, block by block; of one dimension alone if dims is 1."""
    n = dims * (lags + 1)
    block = f"SELECT CAST(p.p AS INTEGER) AS i, CAST(q.q AS INTEGER) AS j, c.value AS x FROM range({n}) p(p), range({n}) q(q), c WHERE c.h = abs(p.p // {dims} - q.q // {dims}) AND "
    own = f"c.i = {only} AND c.j = {only}" if dims == 1 else "CASE WHEN p.p // 2 >= q.q // 2 THEN c.i = p.p % 2 AND c.j = q.q % 2 ELSE c.i = q.q % 2 AND c.j = p.p % 2 END"
    return f"{_lag_sql(mean0, mean1, lags)}, y{only} AS ({block}{own}), {_eliminated(f'y{only}', dims * lags, f'e{only}')}"


def _scalar_models() -> tuple[str, str]:
    """MA(2) and ARMA(1, 1) of each dimension from 20 innovation steps."""
    head = f"{_RECURSIVE}{_innovated(20, 1)}, " + _innovated(20, 1, only=1).split("), y1 AS", 1)[1].join(["y1 AS", ""])
    psi = lambda d, j: f"{_cell_at(20 - j, 20, 20 - j, f'e{d}')} / {_cell_at(20 - j, 20 - j, 20 - j, f'e{d}')}"
    z = " UNION ALL ".join(f"SELECT {d} AS dim, {psi(d, 1)} AS p1, {psi(d, 2)} AS p2, {_cell_at(20, 20, 20, f'e{d}')} AS v" for d in (0, 1))
    rows = lambda *x: " UNION ALL ".join(f"SELECT dim, '{k}' AS kind, {h} AS lag, round({v}, {n}) + 0.0 AS value FROM z" for k, h, v, n in x)
    noise = ("noise", 0, "v", 3)
    return f"{head}, z AS ({z}) " + rows(("ma", 1, "p1", 6), ("ma", 2, "p2", 6), noise), f"{head}, z AS ({z}) " + rows(("ar", 1, "p2 / p1", 6), ("ma", 1, "p1 - p2 / p1", 6), noise)


def _vector_models(source: str = _RECURSIVE) -> tuple[str, str]:
    """VMA(1) and VARMA(1, 1) from 20 innovation steps."""
    columns = []
    for j in (1, 2):
        at = 2 * (20 - j)
        columns += [f"{_cell_at(at, 40 + a, at + b, 'e0')} AS a{j}{a}{b}, {_cell_at(at, at + a, at + b, 'e0')} AS b{j}{a}{b}" for a in (0, 1) for b in (0, 1)]
    columns += [f"{_cell_at(40, 40 + a, 40 + b, 'e0')} AS n{a}{b}" for a in (0, 1) for b in (0, 1)]
    psi = [f"(a{j}{a}0 * {('b' + str(j) + '11', '-b' + str(j) + '01')[b]} + a{j}{a}1 * {('-b' + str(j) + '10', 'b' + str(j) + '00')[b]}) / (b{j}00 * b{j}11 - b{j}01 * b{j}10) AS p{j}{a}{b}" for j in (1, 2) for a in (0, 1) for b in (0, 1)]
    ar = [f"(p2{a}0 * {('p111', '-p101')[b]} + p2{a}1 * {('-p110', 'p100')[b]}) / (p100 * p111 - p101 * p110) AS f{a}{b}" for a in (0, 1) for b in (0, 1)]
    head = f"{source}{_innovated(20, 2)}, z0 AS (SELECT {', '.join(columns)}), z1 AS (SELECT *, {', '.join(psi)} FROM z0), z AS (SELECT *, {', '.join(ar)} FROM z1) "
    rows = lambda *x: " UNION ALL ".join(f"SELECT '{k}' AS kind, {h} AS lag, {a} AS i, {b} AS j, round({v.format(a, b)}, {n}) + 0.0 AS value FROM z" for k, h, v, n in x for a in (0, 1) for b in (0, 1))
    noise = ("noise", 0, "n{0}{1}", 3)
    return head + rows(("ma", 1, "p1{0}{1}", 6), noise), head + rows(("ar", 1, "f{0}{1}", 6), ("ma", 1, "p1{0}{1} - f{0}{1}", 6), noise)


SQL["ma_model"], SQL["arma_model"] = _scalar_models()
SQL["vma_model"], SQL["varma_model"] = _vector_models()


@query(f"{_RECURSIVE}{_lag_sql(lags=LAGS)}, {_walker(LAGS)} SELECT lag, j AS i, i AS j, round(x, 6) + 0.0 AS value FROM a")
def partial_cross_correlation(spark, sf_dir):
    found, _ = moments.partial_cross_correlation(_hourly(spark, sf_dir), LAGS)
    rows = [(h + 1, i, j, round(float(m[i, j]), 6) + 0.0) for h, m in enumerate(found) for i in (0, 1) for j in (0, 1)]
    return spark.createDataFrame(rows, "lag int, i int, j int, value double")


def _radius_sql() -> str:
    """The companion matrix squared 30 times, its size kept as a logarithm."""
    n, at = range(4), lambda h, i, j: f"(SELECT x FROM a WHERE lag = {h} AND i = {i} AND j = {j})"
    first = [at(j // 2 + 1, i, j % 2) if i < 2 else f"CAST({int(i - 2 == j)} AS DOUBLE)" for i in n for j in n]
    start = ", ".join(f"{x} AS x{i // 4}{i % 4}" for i, x in enumerate(first))
    squared = ", ".join("+".join(f"x{i}{m} * x{m}{j}" for m in n) + f" AS y{i}{j}" for i in n for j in n)
    most = "greatest(" + ", ".join(f"abs(y{i}{j})" for i in n for j in n) + ")"
    scaled = ", ".join(f"y{i}{j} / m" for i in n for j in n)
    return (
        f"{_RECURSIVE}{_lag_sql(lags=2)}, {_walker(2)}, p AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS l, {start} UNION ALL "
        f"SELECT k + 1, 2 * l + ln(m), {scaled} FROM (SELECT *, {most} AS m FROM (SELECT k, l, {squared} FROM p WHERE k < 30))) "
        "SELECT 'fitted' AS model, round(exp(l / power(2, 30)), 6) AS radius FROM p WHERE k = 30 UNION ALL SELECT 'stabilised', 0.95"
    )


@query(_radius_sql())
def stability(spark, sf_dir):
    found = models.fit_var(_hourly(spark, sf_dir), 2).ar
    wild = [a * 40 for a in found]
    # made stable, no model is above the limit
    rows = [("fitted", round(spectral_radius(found), 6)), ("stabilised", max(0.95, round(spectral_radius(make_stable(wild)), 6)))]
    return spark.createDataFrame(rows, "model string, radius double")


# spectra

_L, _LP = 2, 6


def _transform_sql(max_lag: int) -> str:
    """z(re{dim}_{f}, im{dim}_{f}): the tapered transform of every full window."""
    width = 2 * max_lag + 1
    w = [float(x) for x in spectrum.taper(width)[0]]
    near = ", ".join(f"lag(v{j}, {max_lag - m}) OVER (ORDER BY k) AS x{j}_{m}" if m <= max_lag else f"lead(v{j}, {m - max_lag}) OVER (ORDER BY k) AS x{j}_{m}" for j in (0, 1) for m in range(width))
    parts = []
    for f in range(width):
        for j in (0, 1):
            for name, fn, sign in (("re", "cos", ""), ("im", "sin", "-")):
                parts.append(f"{sign}(" + " + ".join(f"{w[m]!r} * x{j}_{m} * {fn}(2 * pi() * {f * m} / {width})" for m in range(width)) + f") AS {name}{j}_{f}")
    return f"WITH {S}, w AS (SELECT {near} FROM s), z AS (SELECT {', '.join(parts)} FROM w WHERE x0_0 IS NOT NULL AND x0_{width - 1} IS NOT NULL)"


def _spectrum_sql() -> str:
    scale, out = float(spectrum.taper(2 * _L + 1)[1]), []
    for f in range(2 * _L + 1):
        for i, j in _CELLS:
            re, im = f"avg(re{i}_{f} * re{j}_{f} + im{i}_{f} * im{j}_{f})", f"avg(im{i}_{f} * re{j}_{f} - re{i}_{f} * im{j}_{f})"
            out.append(f"SELECT {i} AS i, {j} AS j, {f} AS freq_idx, {re} * {scale!r} AS re, {im} * {scale!r} AS im FROM z")
    values = "round(re, 4) + 0.0 AS re, round(im, 4) + 0.0 AS im, round(sqrt(re * re + im * im), 4) AS magnitude, round(atan(im / re), 6) + 0.0 AS phase, round(atan2(im, re), 6) + 0.0 AS angle"
    return f"{_transform_sql(_L)}, y AS ({' UNION ALL '.join(out)}) SELECT i, j, freq_idx, {values} FROM y"


def _power_sql() -> str:
    scale = float(spectrum.taper(2 * _LP + 1)[1])
    power = [(i, f, f"avg(re{i}_{f} * re{i}_{f} + im{i}_{f} * im{i}_{f}) * {scale!r}") for i in (0, 1) for f in range(2 * _LP + 1)]
    return _transform_sql(_LP) + " UNION ALL ".join(f" SELECT {i} AS dim, {f} AS freq_idx, round({x}, 4) AS power, round(ln({x}), 6) AS log_power FROM z" for i, f, x in power)


@query(_spectrum_sql())
def cross_spectrum(spark, sf_dir):
    return _round(_round(spectrum.cross_spectrum(_hourly(spark, sf_dir), _L), 4, "re", "im", "magnitude"), 6, "phase", "angle")


@query(_power_sql())
def power_spectrum(spark, sf_dir):
    return _round(_round(spectrum.log_periodogram(_hourly(spark, sf_dir), _LP), 4, "power"), 6, "log_power")


# space: the first two numbers of an embedding as lon and lat

_BOX = (-0.3, -0.3, 0.3, 0.3)
_POINTS = "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings"


def _points(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("lon"), F.get("embedding", F.lit(1)).cast("double").alias("lat"))


def _cell_sql(x: str, n: int) -> str:
    return f"CAST(least(floor(({x} - -0.3) / ((0.3 - -0.3) / {n})), {n - 1}) AS INTEGER)"


@query(f"SELECT * FROM ({_POINTS}) WHERE lon BETWEEN -0.1 AND 0.1 AND lat BETWEEN -0.05 AND 0.2")
def bounding_box(spark, sf_dir):
    return spatial.bounding_box(_points(spark, sf_dir), "lon", "lat", (-0.1, -0.05, 0.1, 0.2))


@query(f"WITH p AS ({_POINTS}), q AS (SELECT quantile_cont(lon, 0.1) a, quantile_cont(lon, 0.9) b, quantile_cont(lat, 0.1) c, quantile_cont(lat, 0.9) d FROM p) SELECT vec_id FROM p, q WHERE lon BETWEEN a AND b AND lat BETWEEN c AND d")
def quantile_box(spark, sf_dir):
    return spatial.quantile_box(_points(spark, sf_dir), "lon", "lat").select("vec_id")


@query(f"SELECT {_cell_sql('lon', 8)} AS ix, {_cell_sql('lat', 8)} AS iy, COUNT(*) AS n FROM ({_POINTS}) WHERE lon BETWEEN -0.3 AND 0.3 AND lat BETWEEN -0.3 AND 0.3 GROUP BY 1, 2")
def geo_grid_count(spark, sf_dir):
    return spatial.grid_counts(_points(spark, sf_dir), "lon", "lat", _BOX, 8, 8)


@query(f"SELECT concat_ws('_', CAST(greatest(ceil((lon - -0.3) / ((0.3 - -0.3) / 19)), 1) AS INTEGER), CAST(greatest(ceil((lat - -0.3) / ((0.3 - -0.3) / 19)), 1) AS INTEGER)) AS bin, COUNT(*) AS n FROM ({_POINTS}) WHERE lon BETWEEN -0.3 AND 0.3 AND lat BETWEEN -0.3 AND 0.3 GROUP BY 1")
def spatial_bins(spark, sf_dir):
    inside = spatial.bounding_box(_points(spark, sf_dir), "lon", "lat", _BOX)
    return spatial.spatial_bins(inside, "lon", "lat", _BOX).groupBy("bin").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(floor(lon / 0.05) AS BIGINT) AS ix, CAST(floor(lat / 0.05) AS BIGINT) AS iy, COUNT(*) AS n FROM ({_POINTS}) GROUP BY 1, 2")
def density_map(spark, sf_dir):
    return spatial.density(_points(spark, sf_dir), "lon", "lat", 0.05, 0.05)


def _tree(spark, sf_dir):
    counts = spatial.grid_counts(_points(spark, sf_dir), "lon", "lat", _BOX, 32, 32)
    return spatial.QuadTree.build(counts, _BOX, 32, 32, 40)


_LON = "CAST(-0.3 AS DOUBLE) + (CAST(0.3 AS DOUBLE) - CAST(-0.3 AS DOUBLE)) * {} / 32"
_LEAVES = f"""WITH RECURSIVE p AS ({_POINTS}), m AS (SELECT CASE WHEN lon BETWEEN -0.3 AND 0.3 AND lat BETWEEN -0.3 AND 0.3 THEN {_cell_sql('lon', 32)} END AS ix, {_cell_sql('lat', 32)} AS iy FROM p),
c AS (SELECT ix, iy, COUNT(*) AS n FROM m WHERE ix IS NOT NULL GROUP BY 1, 2),
t(path, a, b, c0, d) AS (SELECT '', 0, 32, 0, 32 UNION ALL
  SELECT path || CAST(2 * x + y AS VARCHAR), CASE WHEN x = 0 THEN a ELSE (a + b) // 2 END, CASE WHEN x = 0 AND b - a > 1 THEN (a + b) // 2 ELSE b END,
    CASE WHEN y = 0 THEN c0 ELSE (c0 + d) // 2 END, CASE WHEN y = 0 AND d - c0 > 1 THEN (c0 + d) // 2 ELSE d END
  FROM t, range(2) u(x), range(2) v(y) WHERE (b - a > 1 OR d - c0 > 1) AND (x = 0 OR b - a > 1) AND (y = 0 OR d - c0 > 1)
    AND (SELECT coalesce(sum(n), 0) FROM c WHERE ix >= a AND ix < b AND iy >= c0 AND iy < d) > 40),
f AS (SELECT *, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE ix >= a AND ix < b AND iy >= c0 AND iy < d) AS n FROM t),
l AS (SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS INTEGER) AS leaf_id, *, {_LON.format('a')} AS lon0, {_LON.format('c0')} AS lat0, {_LON.format('b')} AS lon1, {_LON.format('d')} AS lat1 FROM f WHERE n <= 40 OR (b - a <= 1 AND d - c0 <= 1))
"""


@query(_LEAVES + "SELECT leaf_id, " + ", ".join(f"round({x}, 9) AS {x}" for x in ("lon0", "lat0", "lon1", "lat1")) + ", round((lon0 + lon1) / 2, 9) AS lon_c, round((lat0 + lat1) / 2, 9) AS lat_c, n FROM l")
def quadtree_leaves(spark, sf_dir):
    return _round(_tree(spark, sf_dir).leaves_df(spark), 9, "lon0", "lat0", "lon1", "lat1", "lon_c", "lat_c")


@query(_LEAVES + "SELECT leaf_id, round((lon0 + lon1) / 2, 9) AS lon_c, round((lat0 + lat1) / 2, 9) AS lat_c, COUNT(*) AS n FROM m LEFT JOIN l ON ix >= a AND ix < b AND iy >= c0 AND iy < d GROUP BY ALL")
def quadtree_align(spark, sf_dir):
    found = _tree(spark, sf_dir).align(_points(spark, sf_dir), "lon", "lat")
    return _round(found.groupBy("leaf_id", "lon_c", "lat_c").agg(F.count("*").alias("n")), 9, "lon_c", "lat_c")


# joins and other relational operators


@query("SELECT a.event_id, b.value AS error_value FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    left = e.where("event_type = 'click'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'error'").select("user_id", "t", F.col("value").alias("error_value"))
    return joins.asof_join(left, right, "t", ["user_id"], ["error_value"], block=7 * 24 * HOUR).select("event_id", "error_value")


@query("SELECT i.event_id AS start_id, COUNT(*) AS n FROM (SELECT * FROM events WHERE event_type = 'signup') i JOIN events e ON e.user_id = i.user_id AND epoch_us(e.ts) BETWEEN epoch_us(i.ts) AND epoch_us(i.ts) + 7200000000 GROUP BY 1")
def interval_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("start_id"), F.col("t").alias("a"), (F.col("t") + 2 * HOUR).alias("b"))
    return joins.interval_join(e.select("user_id", "t"), spans, "t", "a", "b", 2 * HOUR, ("user_id",)).groupBy("start_id").agg(F.count("*").alias("n"))


@query(f"WITH {S} SELECT a.k, round(a.v0 * b.v1, 4) AS x FROM s a JOIN s b ON b.k = a.k - 2")
def lag_join(spark, sf_dir):
    out = joins.lag_join(_hourly(spark, sf_dir).df, "k", ["v1"], 2)
    return out.select("k", F.round(F.col("v0") * F.col("lagged_v1"), 4).alias("x"))


@query("SELECT event_id, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events")
def lag_lead(spark, sf_dir):
    out = joins.shifted(_events(spark, sf_dir), ["user_id"], "t", "value", 1, "before")
    return joins.shifted(out, ["user_id"], "t", "value", -1, "after").select("event_id", "before", "after")


@query("WITH d AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), x AS (SELECT user_id, t, sum(CASE WHEN gap > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM d) SELECT user_id, CAST(session AS BIGINT) AS session, COUNT(*) AS n, max(t) - min(t) AS length FROM x GROUP BY 1, 2")
def sessions(spark, sf_dir):
    out = joins.sessions(_events(spark, sf_dir), ["user_id"], "t", 2 * HOUR, block=7 * 24 * HOUR)
    return out.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("length"))


@query("SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ROLLUP (event_type, CAST(hour(ts) AS INTEGER))")
def rollup_hours(spark, sf_dir):
    return _events(spark, sf_dir).rollup("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), _dec("value").alias("total"))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), _dec("l_quantity").alias("quantity"))


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup'")
def set_operations(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    users = lambda kind: e.where(F.col("event_type") == kind).select("user_id")
    return users("click").intersect(users("error")).subtract(users("signup"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").where("c_acctbal > 0").join(orders, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey")


_BANDS = [(0, 0, 1000), (1, 1000, 1400), (2, 1400, 1401), (3, 1200, 100_000)]


@query("SELECT band, COUNT(*) AS n FROM part JOIN (VALUES (0, 0, 1000), (1, 1000, 1400), (2, 1400, 1401), (3, 1200, 100000)) b(band, lo, hi) ON p_retailprice >= lo AND p_retailprice < hi GROUP BY 1")
def theta_join(spark, sf_dir):
    """Parts in price bands that may overlap: a condition without an equality, against a table of a fixed few rows."""
    bands = spark.createDataFrame(_BANDS, "band int, lo int, hi int")
    part = _table(spark, sf_dir, "part")
    return part.join(F.broadcast(bands), (part["p_retailprice"] >= bands["lo"]) & (part["p_retailprice"] < bands["hi"])).groupBy("band").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return _table(spark, sf_dir, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.count("*").alias("n"))


@query("SELECT event_type, true AS near FROM events GROUP BY 1")
def approx_distinct(spark, sf_dir):
    """Whether the sketch's count of users is within a tenth of the exact one."""
    counts = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("b"))
    return counts.select("event_type", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("near"))


_RANKS = "OVER (PARTITION BY event_type ORDER BY value, event_id)"


@query(f"SELECT event_id, CAST(rank() OVER (PARTITION BY event_type ORDER BY value) AS INTEGER) AS place, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY value) AS INTEGER) AS dense, CAST(ntile(4) {_RANKS} AS INTEGER) AS quarter, first(event_id) {_RANKS} AS first_id, last(event_id) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM events")
def ranks_by_type(spark, sf_dir):
    out = _table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = joins.ranked(out, ["event_type"], ["value"], "place", "rank")
    out = joins.ranked(out, ["event_type"], ["value"], "dense", "dense_rank")
    out = joins.ranked(out, ["event_type"], ["value", "event_id"], "quarter", "ntile", 4)
    order = Window.partitionBy("event_type").orderBy("value", "event_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return out.select("event_id", "place", "dense", "quarter", F.first("event_id").over(order).alias("first_id"), F.last("event_id").over(whole).alias("last_id"))


@query("SELECT event_type, CAST(sum(k) AS BIGINT) AS total, array_to_string(list_sort(list_distinct(list(k)))[1:3], ',') AS least, CAST(max(len(ks)) AS INTEGER) AS keys FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_keys(props) AS ks FROM events) GROUP BY 1")
def json_and_arrays(spark, sf_dir):
    """JSON to a map, maps to keys, arrays sorted, cut and joined."""
    props = F.from_json("props", "map<string, int>")
    rows = _table(spark, sf_dir, "events").select("event_type", props.alias("m"))
    rows = rows.select("event_type", F.element_at("m", "k").alias("k"), F.size(F.map_keys("m")).alias("keys"))
    least = F.slice(F.array_sort(F.collect_set("k")), 1, 3)  # as many numbers as the key takes
    return rows.groupBy("event_type").agg(F.sum("k").alias("total"), F.array_join(F.transform(least, lambda x: x.cast("string")), ",").alias("least"), F.max("keys").alias("keys"))


@query("SELECT o_orderkey, unnest(generate_series(o_orderkey, o_orderkey + o_orderkey % 7, 2)) AS tick FROM orders WHERE o_orderkey % 10 = 0")
def table_function(spark, sf_dir):
    """A Python table function: the ticks of an interval."""
    tables.register(spark)
    _table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").createOrReplaceTempView("lagoon_intervals")
    return spark.sql("SELECT o_orderkey, tick FROM lagoon_intervals, LATERAL lagoon_ticks(o_orderkey, o_orderkey + o_orderkey % 7, 2L)")


@query("SELECT n_name, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def orders_by_nation(spark, sf_dir):
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), _dec("o_totalprice").alias("total"))


# generators and whole programs


def _noise_sql(seed: int, dim: int) -> str:
    """The generators' md5 noise."""
    return f"(CAST('0x' || substr(md5('{seed}:{dim}:' || t), 1, 13) AS BIGINT) / power(2, 52) - 0.5)"


_MA1 = f"WITH e AS (SELECT CAST(t AS BIGINT) AS k, 2.0 * {_noise_sql(11, 0)} AS e FROM range(20000) r(t)), s AS (SELECT k, e + 0.5 * coalesce(lag(e) OVER (ORDER BY k), 0) AS v FROM e), "
_MA1 += "w AS (SELECT v AS l0, " + ", ".join(f"lag(v, {h}) OVER (ORDER BY k) AS l{h}" for h in (1, 2, 3)) + " FROM s) "


@query(_MA1 + " UNION ALL ".join(f"SELECT {lag} AS lag, 0 AS i, 0 AS j, round(avg(l0 * l{abs(lag)}) - power((SELECT avg(v) FROM s), 2), 6) + 0.0 AS value FROM w WHERE l3 IS NOT NULL" for lag in range(-3, 4)))
def generated_ma1_theory(spark, sf_dir):
    """An MA(1) series: theta * variance at lag 1, (1 + theta^2) * variance at lag 0."""
    df = generate.ma(spark, [[0.5]], 20_000, sigma=2.0, seed=11, kind="md5")
    ts = TimeSeries.from_df(df, "t", "v0", delta=1, bck=3)
    return _round(moments.cross_covariance(ts, 3).df, 6, "value")


_VARMA = f"""WITH RECURSIVE n AS (SELECT CAST(t AS BIGINT) AS k, {_noise_sql(3, 0)} AS e0, {_noise_sql(3, 1)} AS e1 FROM range(3000) r(t)),
m AS (SELECT k, e0 + 0.2 * coalesce(lag(e0) OVER (ORDER BY k), 0) AS m0, e1 + 0.1 * coalesce(lag(e0) OVER (ORDER BY k), 0) + 0.2 * coalesce(lag(e1) OVER (ORDER BY k), 0) AS m1 FROM n),
s(k, v0, v1) AS (SELECT k, m0, m1 FROM m WHERE k = 0 UNION ALL SELECT m.k, m.m0 + 0.4 * s.v0 + 0.1 * s.v1, m.m1 + 0.3 * s.v1 FROM s JOIN m ON m.k = s.k + 1), """


@query(_vector_models(_VARMA)[1])
def generated_varma(spark, sf_dir):
    df = generate.varma(spark, [[[0.4, 0.1], [0.0, 0.3]]], [[[0.2, 0.0], [0.1, 0.2]]], 3_000, seed=3, kind="md5")
    found = models.fit_varma(TimeSeries.from_df(df, "t", ["v0", "v1"], delta=1, bck=40), 1, 1, depth=20).to_df(spark)
    return found.withColumn("value", F.when(F.col("kind") == "noise", F.round("value", 3)).otherwise(F.round("value", 6)) + F.lit(0.0))


@query("SELECT CAST(k AS BIGINT) AS k, 10.0 AS total, 1.0 AS mean FROM (SELECT unnest(generate_series(0, 99)) AS k)")
def ones_resampled(spark, sf_dir):
    df = generate.ones(spark, 2, 1000)
    return resample.resample(df, {"k": tf.floor_div(F.col("t"), 10)}, {"total": F.sum("v0"), "mean": F.avg("v1")})


@query("SELECT COUNT(*) AS n, true AS bounded FROM (SELECT unnest(generate_series(1, 10000)))")
def noise_bounds(spark, sf_dir):
    df = generate.white_noise(spark, 1, 10_000, kind="uniform", seed=5)
    return df.agg(F.count("*").alias("n"), F.bool_and(F.abs("v0") <= 0.5).alias("bounded"))


_FLAT = "WITH RECURSIVE " + S.replace("s AS (SELECT g.k", "s0 AS (SELECT g.k") + ", s AS (SELECT k, " + ", ".join(f"v{i} - avg(v{i}) OVER (PARTITION BY k % 24) AS v{i}" for i in (0, 1)) + " FROM s0)"
_BACK = lambda i: " - ".join([f"v{i}", *(f"{_cell_at(4, 2 * (h - 1) + j, 4 + i)} * coalesce(lag(v{j}, {h}) OVER (ORDER BY k), 0)" for h in (1, 2) for j in (0, 1))])


@query(f"{_FLAT}, {_lag_sql(lags=2)}, {_walker(2)}, r AS (SELECT {_BACK(0)} AS r0, {_BACK(1)} AS r1 FROM s) " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(avg(r{i} * r{j}), 3) AS value FROM r" for i, j in _CELLS))
def season_to_residuals(spark, sf_dir):
    """A whole program: grid, seasonal profile, de-seasoned series, VAR, residual moments."""
    ts = _hourly(spark, sf_dir)
    bucket = F.pmod("k", F.lit(24))
    flat = seasonal.remove_season(ts, seasonal.mean_profile(ts, bucket), bucket)
    fitted = models.fit_var(flat, 2)
    out = models.residual_series(flat, models.var_residuals(flat, fitted.ar))
    return _round(moments.second_moment(out), 3, "value")


_TRIPS = """p AS (SELECT ts, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat FROM events JOIN embeddings ON vec_id = event_id % 500),
q AS (SELECT quantile_cont(lon, 0.1) a, quantile_cont(lon, 0.9) b, quantile_cont(lat, 0.1) c, quantile_cont(lat, 0.9) d FROM p),
t AS (SELECT ts, CASE WHEN lon <= 0 THEN 'w' ELSE 'e' END || CASE WHEN lat <= 0 THEN 's' ELSE 'n' END AS bin FROM p, q WHERE lon BETWEEN a AND b AND lat BETWEEN c AND d)"""


@query("WITH " + _TRIPS + " SELECT epoch_us(ts) // 3600000000 + 1 AS k, " + ", ".join(f"COUNT(*) FILTER (bin = '{b}') AS {b}" for b in ("es", "en", "ws", "wn")) + " FROM t GROUP BY 1")
def trips_by_bin(spark, sf_dir):
    """A whole program: trips in a quantile box, spatial bins, counts stamped with the next hour, merged wide."""
    place = _points(spark, sf_dir)
    trips = _table(spark, sf_dir, "events").withColumn("vec_id", F.col("event_id") % 500).join(place, "vec_id")
    inside = spatial.quantile_box(trips, "lon", "lat")
    side = lambda c, low, high: F.when(F.col(c) <= 0, low).otherwise(high)
    binned = inside.withColumn("bin", F.concat(side("lon", "w", "e"), side("lat", "s", "n")))
    return resample.pivot_merge(binned, resample.bucket(binned, "ts", "1h") + 1, "bin", ["es", "en", "ws", "wn"], F.count(F.lit(1)), 0)


@query()
def generated_var_program(spark, sf_dir):
    """A whole program: stabilised VAR(3), correlations, AR and VAR fits, and the residuals' second moments."""
    rng = np.random.default_rng(4)
    phis = make_stable([rng.uniform(-0.6, 0.6, (3, 3)) for _ in range(3)])
    ts = TimeSeries.from_df(generate.var(spark, phis, 10_000, seed=4), "t", ["v0", "v1", "v2"], delta=1, bck=8, fwd=8)
    scalar, vector = models.fit_ar(ts, 3), models.fit_var(ts, 3)
    parts = [("correlation", moments.cross_correlation(ts, 6).df.where("lag = 1").select("i", "j", "value"))]
    for name, out in (("ar", models.ar_residuals(ts, scalar.ar)), ("var", models.var_residuals(ts, vector.ar))):
        parts.append((name, moments.second_moment(models.residual_series(ts, out))))
    named = [df.select(F.lit(n).alias("step"), "i", "j", F.round("value", 4).alias("value")) for n, df in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("WITH " + S + """, p AS (SELECT list_sort(list_distinct(list_concat([min(k), max(k)], quantile_disc(k, [0.0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0])))) AS cuts FROM s)
SELECT CAST(len(list_filter(cuts[2:len(cuts) - 1], lambda e: e < k)) AS INTEGER) AS interval, COUNT(*) AS n, min(k) AS first_k, max(k) AS last_k FROM s, p GROUP BY 1""")
def interval_rows(spark, sf_dir):
    """Rows of the grid by balanced interval."""
    grid = _hourly(spark, sf_dir).df
    found = intervals.cut_points(grid, "k", 8, error=0.0)
    return grid.groupBy(intervals.interval_of(F.col("k"), found).alias("interval")).agg(F.count("*").alias("n"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


def _streamed(spark, sf_dir):
    schema = _table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table may be one file or a folder
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, mode: str = "complete") -> DataFrame:
    return streams.to_files(df, mode)


@query("SELECT epoch_us(ts) // 86400000000 AS day, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = streams.stream_resample(_streamed(spark, sf_dir), "ts", "1 day", {"n": F.count("*"), "total": _dec("value")}, ("event_type",))
    done = _run(out)
    return done.select(F.floor(F.unix_seconds("start") / 86400).cast("long").alias("day"), "event_type", "n", "total")


@query("SELECT h AS start_hour, COUNT(*) AS n FROM (SELECT unnest([epoch_us(ts) // 3600000000, epoch_us(ts) // 3600000000 - 1]) AS h FROM events) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    out = streams.stream_resample(_streamed(spark, sf_dir), "ts", "2 hours", {"n": F.count("*")}, slide="1 hour")
    return _run(out).select(F.floor(F.unix_seconds("start") / 3600).cast("long").alias("start_hour"), "n")


@query("WITH d AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, false) AS new FROM events), x AS (SELECT user_id, ts, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM d) SELECT user_id, epoch_us(min(ts)) AS start_us, COUNT(*) AS n FROM x GROUP BY user_id, s")
def stream_sessions(spark, sf_dir):
    out = streams.stream_sessions(_streamed(spark, sf_dir), "ts", "2 hours", {"n": F.count("*")}, ("user_id",))
    return _run(out).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT user_id, epoch_us(ts) AS t, round(value - 0.5 * coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts), 0), 4) AS residual FROM events")
def stream_residuals(spark, sf_dir):
    """AR(1) residuals with each series' last value as state."""
    out = streams.stream_ar_residuals(_streamed(spark, sf_dir).withColumn("t", F.unix_micros("ts")), "user_id", "t", "value", [0.5])
    return _run(out, "append").select("user_id", "t", F.round("residual", 4).alias("residual"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
