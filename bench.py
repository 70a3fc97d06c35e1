"""Headline queries, timed. Prints one JSON line; BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
#: Queries of the catalog that are timed, and (dims, samples, lags) of the cross-covariance grid.
NAMES = ["sum_resample_hourly", "pivot_outer_merge", "moving_sum_sym", "cross_covariance", "cross_correlation", "auto_covariance", "seasonal_profile", "remove_season", "ar2_coef", "var_model", "ar_residuals", "cross_spectrum", "memory_ewma", "asof_join", "geo_grid_count", "orders_by_nation"]
GRID = [(1, 10_000, 6), (3, 100_000, 6), (1, 1_000_000, 6), (3, 1_000_000, 1), (3, 1_000_000, 6), (3, 1_000_000, 14)]


def best(f, runs: int) -> float:
    times = []
    for _ in range(runs):
        t = time.perf_counter()
        f()
        times.append(time.perf_counter() - t)
    return round(min(times), 4)


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from lagoon.operators import moments
    from lagoon.plans import catalog
    from lagoon.series import TimeSeries
    from lagoon.sources import generate

    queries, out = catalog.queries(), {}
    for name in NAMES:
        out[name] = best(lambda: queries[name](spark, SF_DIR).collect(), 2)  # noqa: B023
    for d, n, lags in GRID:
        # as published figures have it: over a series that is already in memory
        df = generate.white_noise(spark, d, n, seed=1, partitions=CPUS).cache()
        df.count()
        ts = TimeSeries.from_df(df, "t", [f"v{i}" for i in range(d)], delta=1, bck=lags, block=max(4096, -(-n // CPUS)))
        out[f"crosscov_d{d}_n{n}_lag{lags}"] = best(lambda: moments.cross_covariance(ts, lags).matrices(), 3)  # noqa: B023
        df.unpersist()
    total = round(sum(out.values()), 4)
    print(json.dumps({"metric": "sum of best query times", "value": total, "unit": "sec", "queries": out, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
