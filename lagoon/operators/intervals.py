"""Balanced time intervals: cut points from approximate quantiles, and the interval of each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_points(df: DataFrame, tick: str, intervals: int, error: float = 1e-3) -> list[tuple[int, int]]:
    """About `intervals` pairs (start, end) with equal shares of the rows, from the first to the last tick; fewer where ticks repeat. Empty without rows."""
    if intervals < 1:
        raise ValueError("at least one interval is needed")
    found = df.where(F.col(tick).isNotNull()).approxQuantile(tick, [i / intervals for i in range(intervals + 1)], error)
    if not found:
        return []
    edge = df.agg(F.min(tick), F.max(tick)).first()
    points = sorted({edge[0], edge[1], *(int(x) for x in found)})
    return list(zip(points, points[1:], strict=False)) or [(edge[0], edge[1])]


def interval_of(x: Column, intervals: list[tuple[int, int]]) -> Column:
    """Number of the interval that holds x: before the first it is the first, after the last the last, and a shared edge belongs to the earlier one."""
    inner = F.array(*[F.lit(int(start)).cast("long") for start, _ in intervals[1:]]) if len(intervals) > 1 else F.array().cast("array<long>")
    return F.size(F.filter(inner, lambda e: e < x)).cast("int")


def range_partitioned(df: DataFrame, tick: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt by ranges of the tick and sorted in each: Spark samples the cut points itself."""
    out = df.repartitionByRange(partitions, tick) if partitions else df.repartitionByRange(tick)
    return out.sortWithinPartitions(tick)
