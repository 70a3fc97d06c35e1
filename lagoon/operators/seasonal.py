"""Seasonal profiles, and series without them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions.linalg import rbf_smooth
from lagoon.series import TimeSeries

#: Buckets up to which a profile may be broadcast; it is counted first.
BROADCAST_BUCKETS = 100_000


def mean_profile(ts: TimeSeries, bucket: Column) -> DataFrame:
    """bucket and each value's mean in it."""
    return ts.df.groupBy(bucket.alias("bucket")).agg(*(F.avg(v).alias(v) for v in ts.values))


def remove_season(ts: TimeSeries, profile: DataFrame, bucket: Column) -> TimeSeries:
    """Values less their bucket's mean; a bucket that the profile lacks gives null and no_profile = true."""
    named = profile.select(F.col("bucket").alias("_bucket"), *(F.col(v).alias(f"_p_{v}") for v in ts.values))
    if profile.count() <= BROADCAST_BUCKETS:
        named = F.broadcast(named)
    joined = ts.df.withColumn("_bucket", bucket).join(named, "_bucket", "left")
    rest = [c for c in ts.df.columns if c not in ts.values]
    values = [(F.col(v) - F.col(f"_p_{v}")).alias(v) for v in ts.values]
    return ts.with_df(joined.select(*rest, *values, F.col(f"_p_{ts.values[0]}").isNull().alias("no_profile")))


def smooth_profile(profile: DataFrame, value: str, rows: int, cols: int, width: tuple[int, int], sigma: tuple[float, float]) -> np.ndarray:
    """A profile of rows * cols buckets (day by step, say) as a smoothed matrix; missing buckets count as 0."""
    m = np.zeros(rows * cols)
    for r in profile.select("bucket", value).where(F.col("bucket").between(0, rows * cols - 1)).collect():
        m[r[0]] = r[1] or 0.0
    return rbf_smooth(m.reshape(rows, cols), *width, *sigma)
