"""Buckets, grids and merges of irregular series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions.time import floor_div, micros, span


def bucket(df: DataFrame, ts: str, width: str | int) -> Column:
    """Number of the bucket that a time falls into."""
    return floor_div(micros(df, ts), span(width))


def resample(df: DataFrame, by: dict[str, Column], aggregates: dict[str, Column], before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """Bucket, map rows, aggregate, map results: partial aggregation before the one shuffle."""
    rows = df.withColumns(before) if before else df
    out = rows.groupBy(*(c.alias(n) for n, c in by.items())).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.withColumns(after) if after else out


def sum_resample(df: DataFrame, by: Column, values: list[str], exact_scale: int | None = None) -> DataFrame:
    """Sums by bucket k; with exact_scale, in decimals of that scale, so that the order of rows doesn't matter."""
    total = (lambda v: F.sum(F.col(v).cast(f"decimal(28,{exact_scale})")).cast("double")) if exact_scale is not None else F.sum
    return resample(df, {"k": by}, {v: total(v) for v in values})


def mean_resample(df: DataFrame, by: Column, values: list[str]) -> DataFrame:
    return resample(df, {"k": by}, {v: F.avg(v) for v in values})


def align_up_count(df: DataFrame, ts: str, width: str | int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows by bucket, stamped with the next boundary."""
    return df.groupBy(*by, (bucket(df, ts, width) + 1).alias("k")).agg(F.count("*").alias("n"))


#: Ticks of a grid that one row is exploded to; a longer grid is dealt out in such pieces.
GRID_PIECE = 1 << 16


def fill_grid(df: DataFrame, tick: str, values: list[str], delta: int = 1, fill: float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every tick from the first to the last (of each key), missing ones filled."""
    df = df.select(*keys, tick, *values)
    # all columns, so that the plan below is the same for both uses and its exchange is made once
    whole = F.struct(tick, *values)
    edge = (df.where(F.col(tick).isNotNull()).groupBy(*keys) if keys else df.where(F.col(tick).isNotNull())).agg(F.min(whole).alias("a"), F.max(whole).alias("b"))
    edge = edge.select(*keys, F.col(f"a.`{tick}`").alias("_lo"), F.col(f"b.`{tick}`").alias("_hi"))
    # without rows there is no grid
    piece = F.lit(delta * GRID_PIECE).cast("long")
    pieces = edge.where("_lo is not null").select(*keys, "_hi", F.explode(F.sequence("_lo", "_hi", piece)).alias("_lo"))
    pieces = pieces.repartition(*keys, "_lo")
    grid = pieces.select(*keys, F.explode(F.sequence(F.col("_lo"), F.least(F.col("_hi"), F.col("_lo") + piece - 1), F.lit(delta).cast("long"))).alias(tick))
    return grid.join(df, [*keys, tick], "left").fillna(fill, values)


def pivot_merge(df: DataFrame, tick: Column, name: str, names: list, value: Column, fill: float = 0.0) -> DataFrame:
    """The full outer merge of one series for each name, missing values filled: one pivoting aggregation in place of N - 1 joins."""
    out = df.groupBy(tick.alias("k")).pivot(name, names).agg(value)
    return out.fillna(fill, [str(n) for n in names])


def hourly_grid(events: DataFrame, ts: str, name: str, names: list[str], value: str, width: str | int = "1h") -> DataFrame:
    """k, v0, v1, ...: sums of two-decimal values by bucket for each name, on a full grid."""
    k = bucket(events, ts, width)
    sums = [F.sum(F.when(F.col(name) == n, F.col(value)).otherwise(0).cast("decimal(18,2)")).cast("double").alias(f"v{i}") for i, n in enumerate(names)]
    return fill_grid(events.groupBy(k.alias("k")).agg(*sums), "k", [f"v{i}" for i in range(len(names))])
