"""Windows over streams with watermarks, and AR residuals with state by series."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_resample(events: DataFrame, ts: str, width: str, aggregates: dict[str, Column], keys: tuple[str, ...] = (), slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Aggregates by tumbling or sliding window; rows later than `late` are dropped and closed windows leave the state."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def stream_sessions(events: DataFrame, ts: str, gap: str, aggregates: dict[str, Column], keys: tuple[str, ...], late: str = "10 minutes") -> DataFrame:
    """Aggregates by key and session; a session ends after `gap` without rows."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *aggregates)


def to_files(df: DataFrame, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """All that a bounded stream gives, as Parquet files in a folder that driver and executors share (spark.checkpoint.dir, unless given).

    In complete mode each micro-batch replaces what the one before wrote.
    """
    spark = df.sparkSession
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lagoon-")
    at, schema = f"{folder}/stream-{uuid.uuid4().hex}", df.schema
    how = "overwrite" if mode == "complete" else "append"
    spark.createDataFrame([], schema).write.parquet(f"{at}/rows")
    write = lambda batch, _: batch.write.mode(how).parquet(f"{at}/rows")
    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/rows")


def stream_ar_residuals(events: DataFrame, key: str, tick: str, value: str, coeffs: list[float], mean: float = 0.0) -> DataFrame:
    """key, tick, residual: x_t - m - sum phi_h (x_{t-h} - m) with the last p values of each series as state, in order of arrival and of the tick within a batch."""
    p, phi = len(coeffs), list(map(float, coeffs))

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        for part in [pd.concat(list(parts)).sort_values(tick, kind="stable")]:
            out = []
            for x in part[value]:
                out.append(x - mean - sum(c * b for c, b in zip(phi, reversed(past), strict=False)))
                past = [*past, x - mean][-p:]
            yield pd.DataFrame({key: name[0], tick: part[tick], "residual": out})
        state.update((past,))

    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, tick)}
    return events.select(key, tick, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kinds[key]}, `{tick}` {kinds[tick]}, residual double", "past array<double>", "append", GroupStateTimeout.NoTimeout
    )
