"""Windows over time. One long series is cut into blocks with a replicated halo, so that no window needs one task to hold it all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lagoon.functions.time import floor_div
from lagoon.series import TICK, TimeSeries

BLOCK, OWN = "_blk", "_own"


def with_halo(ts: TimeSeries, bck: int, fwd: int) -> DataFrame:
    """Each row in the block that owns it and in every block whose windows [t - bck, t + fwd] reach it."""
    width = ts.block_width(bck, fwd)
    t = F.col(TICK)
    copies = F.explode(F.sequence(floor_div(t - fwd, width), floor_div(t + bck, width)))
    return ts.df.select("*", floor_div(t, width).alias(OWN), copies.alias(BLOCK))


def framed(ts: TimeSeries, bck: int, fwd: int) -> tuple[DataFrame, WindowSpec, WindowSpec]:
    """Rows, the range frame of each row's window, and the ordering alone. Partitioned by halo block, and by key in a panel, so one long series of many is spread too."""
    order = Window.partitionBy(*ts.keys, BLOCK).orderBy(TICK)
    return with_halo(ts, bck, fwd), order.rangeBetween(-bck, fwd), order


def owned(df: DataFrame) -> DataFrame:
    """Only targets, without replicas and block columns."""
    return df.where(F.col(BLOCK) == F.col(OWN)).drop(BLOCK, OWN)


def sliding_agg(ts: TimeSeries, aggregates: dict[str, Column], bck: int | None = None, fwd: int | None = None, target_filter: Column | str | None = None, window_filter: Column | str | None = None, full: int | None = None) -> DataFrame:
    """Aggregates of each target's window [t - bck, t + fwd] (peers included), as columns beside the row.

    target_filter picks targets, while windows still see all rows; window_filter is a condition on the
    aggregates; full keeps windows with exactly so many rows.
    """
    bck, fwd = ts.bck if bck is None else bck, ts.fwd if fwd is None else fwd
    df, frame, _ = framed(ts, bck, fwd)
    out = df.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items()), *([F.count("*").over(frame).alias("_n")] if full is not None else []))
    out = owned(out)
    if full is not None:
        out = out.where(F.col("_n") == full).drop("_n")
    for condition in (target_filter, window_filter):
        if condition is not None:
            out = out.where(condition)
    return out


def sliding_fold(ts: TimeSeries, per_window: dict[str, Column], combine: dict[str, Column], **how) -> DataFrame:
    """per_window aggregates of each window, folded by `combine` at once: nothing is materialised between."""
    windows = sliding_agg(ts, per_window, **how)
    aggs = [a.alias(n) for n, a in combine.items()]
    return windows.groupBy(*ts.keys).agg(*aggs) if ts.keys else windows.agg(*aggs)


def sliding_kernel(ts: TimeSeries, kernel: Callable[[np.ndarray, np.ndarray], tuple | None], schema: str, bck: int | None = None, fwd: int | None = None) -> DataFrame:
    """kernel(ticks, values) of each target's window, for what column expressions can't say: keys, tick and the kernel's values.

    A kernel that gives None drops its target. Blocks are worked off one by one in Arrow batches.
    """
    bck, fwd = ts.bck if bck is None else bck, ts.fwd if fwd is None else fwd
    keys, values = list(ts.keys), list(ts.values)
    names = [c.strip().split()[0] for c in schema.split(",")]
    df = with_halo(ts, bck, fwd)

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(TICK, kind="stable")
        t, v = block[TICK].to_numpy(), block[values].to_numpy()
        first, last = np.searchsorted(t, t - bck, "left"), np.searchsorted(t, t + fwd, "right")
        target = (block[BLOCK] == block[OWN]).to_numpy()
        found = {i: r for i in np.flatnonzero(target) if (r := kernel(t[first[i] : last[i]], v[first[i] : last[i]])) is not None}
        out = block.iloc[list(found)][[*keys, TICK]].reset_index(drop=True)
        for n, column in zip(names, zip(*found.values(), strict=True) if found else [[]] * len(names), strict=True):
            out[n] = list(column)
        return out

    kinds = ", ".join(f"`{c}` {ts.df.schema[c].dataType.simpleString()}" for c in [*keys, TICK])
    return df.select(*keys, TICK, *values, BLOCK, OWN).groupBy(*keys, BLOCK).applyInPandas(run, f"{kinds}, {schema}")


def sliding_with_memory(ts: TimeSeries, kernel: Callable, init, schema: str, bck: int | None = None, fwd: int | None = None) -> DataFrame:
    """kernel(ticks, values, state) -> (values, state) over each series in time order; one state for each series, whatever the partitioning.

    Sequential within a series by definition; series run in parallel. Rows stream in order, and only the rows of the current window are held.
    """
    bck, fwd = ts.bck if bck is None else bck, ts.fwd if fwd is None else fwd
    keys, values = list(ts.keys), list(ts.values)
    names = [c.strip().split()[0] for c in schema.split(",")]

    columns = [*keys, TICK, *values]

    def fresh():
        return init() if callable(init) else init

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []  # the rows that targets of the last series may still need
        state, at = fresh(), 0  # of the last series: its state, and the first of its held rows that is no finished target

        def work(rows: list[np.ndarray], ended: bool) -> pd.DataFrame:
            nonlocal held, state, at
            t, v, n = rows[len(keys)], np.stack(rows[len(keys) + 1 :], axis=1), len(rows[0])
            cut = np.zeros(max(n - 1, 0), bool)
            for k in rows[: len(keys)]:
                empty = pd.isna(k)
                cut |= (k[1:] != k[:-1]) & ~(empty[1:] & empty[:-1])
            starts = [0, *(np.flatnonzero(cut) + 1)]
            done, found = [], []
            for a, b in zip(starts, [*starts[1:], n], strict=True):
                if a:
                    state, at = fresh(), 0
                own, x = t[a:b], v[a:b]
                # later rows may still fall into the windows of targets near the end of an unfinished series
                limit = len(own) if ended or b < n else int(np.searchsorted(own, own[-1] - fwd, "left"))
                first, last = np.searchsorted(own, own[at:limit] - bck, "left"), np.searchsorted(own, own[at:limit] + fwd, "right")
                for i, j in zip(first.tolist(), last.tolist(), strict=True):
                    result, state = kernel(own[i:j], x[i:j], state)
                    found.append(result)
                done.append(np.arange(a + at, a + max(at, limit)))
                at = max(at, limit)
            keep = min(at, int(np.searchsorted(own, (own[at] if at < len(own) else own[-1]) - bck, "left")))
            held, at = [c[a + keep :] for c in rows], at - keep
            index = np.concatenate(done)
            out = {c: x[index] for c, x in zip([*keys, TICK], rows, strict=False)}
            return pd.DataFrame(out | dict(zip(names, zip(*found, strict=True) if found else [[]] * len(names), strict=True)))

        for batch in batches:
            now = [batch[c].to_numpy() for c in columns]
            if len(now[0]):
                yield work([np.concatenate(x) for x in zip(held, now, strict=True)] if held else now, False)
        if held and len(held[0]):
            yield work(held, True)

    kinds = ", ".join(f"`{c}` {ts.df.schema[c].dataType.simpleString()}" for c in [*keys, TICK])
    rows = ts.df.select(*keys, TICK, *values)
    rows = rows.repartition(*keys) if keys else rows.coalesce(1)
    return rows.sortWithinPartitions(*keys, TICK).mapInPandas(run, f"{kinds}, {schema}")


def fold_with_memory(ts: TimeSeries, kernel: Callable, init, schema: str, combine: dict[str, Column], **how) -> DataFrame:
    """A stateful kernel's values, folded for each key."""
    rows = sliding_with_memory(ts, kernel, init, schema, **how)
    aggs = [a.alias(n) for n, a in combine.items()]
    return rows.groupBy(*ts.keys).agg(*aggs) if ts.keys else rows.agg(*aggs)


def at_targets(ts: TimeSeries, targets: DataFrame, target_col: str, aggregates: dict[str, Column], bck: int | None = None, fwd: int | None = None) -> DataFrame:
    """Aggregates over the windows around given ticks instead of data points; targets without rows give none.

    A range join as an equi-join: both sides are cut into buckets of the window's width, targets enter every bucket that they reach.
    """
    bck, fwd = ts.bck if bck is None else bck, ts.fwd if fwd is None else fwd
    width = bck + fwd + 1
    t = F.col(target_col)
    reached = targets.select(*ts.keys, t.alias("_target"), F.explode(F.sequence(floor_div(t - bck, width), floor_div(t + fwd, width))).alias("_bucket")).distinct()
    rows = ts.df.withColumn("_bucket", floor_div(F.col(TICK), width))
    near = rows.join(reached, [*ts.keys, "_bucket"]).where(F.col(TICK).between(F.col("_target") - bck, F.col("_target") + fwd))
    return near.groupBy(*ts.keys, F.col("_target").alias(target_col)).agg(*(a.alias(n) for n, a in aggregates.items()))
