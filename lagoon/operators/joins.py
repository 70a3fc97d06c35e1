"""Time joins and the relational operators around series: thin, so that the optimizer picks the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.time import floor_div
from lagoon.series import unused


def with_each(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the other columns of groups, by columns that may be null."""
    names = [unused(rows, f"_by{i}") for i in range(len(by))]
    groups = groups.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), *(c for c in groups.columns if c not in by))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)])
    return rows.join(groups, same, "left").drop(*names)


def asof_join(left: DataFrame, right: DataFrame, on: str, keys: list[str], values: list[str], tolerance: int | None = None, block: int | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before it (within tolerance), by key: a union and one ordered pass.

    With block, a key's history is cut into time blocks of that width, ordered one by one; the last right row before a
    block comes from a table with one row for each key and block. So a hot key is spread over tasks.
    """
    side, at, blk, last, before = (unused(left, x) for x in ("_side", "_at", "_block", "_last", "_before"))
    own = [unused(left, f"_{v}") for v in values]
    found = F.struct(F.col(on).cast("long").alias("at"), *(F.col(o) for o in own))
    l = left.withColumns({side: F.lit(1), **{o: F.lit(None).cast(right.schema[v].dataType) for o, v in zip(own, values, strict=True)}})  # noqa: E741
    r = right.select(*keys, on, F.lit(0).alias(side), *(F.col(v).alias(o) for o, v in zip(own, values, strict=True)))
    both = l.unionByName(r, allowMissingColumns=True).withColumn(at, F.when(F.col(side) == 0, found))
    group = list(keys)
    if block:
        both, group = both.withColumn(blk, floor_div(F.col(on), block)), [*keys, blk]
    so_far = Window.partitionBy(*group).orderBy(on, side).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(last, F.last(at, ignorenulls=True).over(so_far))
    if block:
        ends = both.groupBy(*group).agg(F.max_by(at, F.when(F.col(side) == 0, F.col(on))).alias(before))
        earlier = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*group, F.last(before, ignorenulls=True).over(earlier).alias(before))
        out = with_each(out, ends, group).withColumn(last, F.coalesce(last, before))
    near = F.lit(True) if tolerance is None else F.col(on).cast("long") - F.col(f"`{last}`.at") <= tolerance
    return out.where(F.col(side) == 1).select(*left.columns, *(F.when(near, F.col(f"`{last}`.`{o}`")).alias(v) for o, v in zip(own, values, strict=True)))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points with every interval [start, end] that holds them, as an equi-join on buckets of `width`."""
    cut = points.withColumn("_bucket", floor_div(F.col(at), width))
    spread = intervals.withColumn("_bucket", F.explode(F.sequence(floor_div(F.col(start), width), floor_div(F.col(end), width))))
    return cut.join(spread, [*keys, "_bucket"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def lag_join(df: DataFrame, tick: str, values: list[str], lag: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their values `lag` ticks before, as lagged_*: an equi-join, for sparse data and many series."""
    before = df.select(*keys, (F.col(tick) + lag).alias(tick), *(F.col(v).alias(f"lagged_{v}") for v in values))
    return df.join(before, [*keys, tick])


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank", how: str = "row_number", tiles: int | None = None) -> DataFrame:
    """row_number, rank, dense_rank, percent_rank, cume_dist or (with tiles) ntile by group."""
    value = F.ntile(tiles) if how == "ntile" else getattr(F, how)()
    return df.withColumn(name, value.over(Window.partitionBy(*by).orderBy(*order)))


def shifted(df: DataFrame, by: list[str], order: str, value: Column | str, n: int, name: str) -> DataFrame:
    """The value n rows before (negative: after)."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, F.lag(value, n).over(w) if n >= 0 else F.lead(value, -n).over(w))


def sessions(df: DataFrame, keys: list[str], tick: str, gap: int, block: int | None = None) -> DataFrame:
    """df with session: a number by key that grows where the gap to the row before exceeds `gap`.

    With block, a key's history is cut into time blocks of that width; what is carried into a block, the last tick and
    the number of sessions before it, comes from a table with one row for each key and block.
    """
    new, blk = unused(df, "_new"), unused(df, "_block")
    if not block:
        w = Window.partitionBy(*keys).orderBy(tick)
        flagged = df.withColumn(new, F.coalesce((F.col(tick) - F.lag(tick).over(w) > gap).cast("long"), F.lit(0)))
        return flagged.withColumn("session", F.sum(new).over(w)).drop(new)
    group = [*keys, blk]
    w = Window.partitionBy(*group).orderBy(tick)
    rows = df.withColumn(blk, floor_div(F.col(tick), block))
    rows = rows.withColumn(new, F.coalesce((F.col(tick) - F.lag(tick).over(w) > gap).cast("long"), F.lit(0)))
    rows = rows.withColumn("session", F.sum(new).over(w))
    ends = rows.groupBy(*group).agg(F.min(tick).alias("first"), F.max(tick).alias("last"), F.sum(new).alias("inner"))
    order = Window.partitionBy(*keys).orderBy(blk)
    ends = ends.withColumn("start", F.coalesce((F.col("first") - F.lag("last").over(order) > gap).cast("long"), F.lit(0)))
    base = (F.sum(F.col("inner") + F.col("start")).over(order) - F.col("inner"))
    name = unused(rows, "base")
    joined = with_each(rows, ends.select(*group, base.alias(name)), group)
    return joined.select(*df.columns, (F.col("session") + F.col(name)).alias("session"))
