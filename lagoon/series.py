"""A multivariate series over a DataFrame: names of its columns, its tick and its padding."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagoon.functions.time import micros, span

TICK = "_t"


#: Names that windows use inside.
RESERVED = {"_blk", "_own", "_n", "_bucket", "_target"}


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one if df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@dataclass(frozen=True)
class TimeSeries:
    """Rows with a tick (a long, in TICK), value columns, and key columns if it is a panel of series.

    delta, bck and fwd are in the tick's unit (microseconds for timestamps). block is the width of the
    time blocks that windows over one long series are computed in; by default it keeps the replicated
    halo below an eighth of a block.
    """

    df: DataFrame
    ts: str
    values: tuple[str, ...]
    delta: int
    bck: int = 0
    fwd: int = 0
    keys: tuple[str, ...] = ()
    block: int | None = None
    n_samples: int | None = None

    @classmethod
    def from_df(cls, df: DataFrame, ts: str, values: list[str] | str, delta: str | int, bck: str | int = 0, fwd: str | int = 0, keys=(), block: str | int | None = None, n_samples: int | None = None) -> TimeSeries:
        names = [values] if isinstance(values, str) else list(values)
        missing = {ts, *names, *keys} - set(df.columns)
        if missing:
            raise ValueError(f"no such columns: {', '.join(sorted(missing))}")
        if clash := RESERVED.intersection(df.columns):
            raise ValueError(f"windows use these names themselves: {', '.join(sorted(clash))}")
        # ts stays only if it is not the tick itself
        out = df.withColumn(TICK, micros(df, ts))
        return cls(out, ts, tuple(names), span(delta), span(bck), span(fwd), tuple(keys), None if block is None else span(block), n_samples)

    @classmethod
    def from_array(cls, df: DataFrame, ts: str, array: str, dim: int, **more) -> TimeSeries:
        """From a column of arrays with dim numbers each, laid out as columns v0, v1, ..."""
        wide = df.select("*", *[F.get(array, F.lit(i)).cast("double").alias(f"v{i}") for i in range(dim)]).drop(array)
        return cls.from_df(wide, ts, [f"v{i}" for i in range(dim)], **more)

    @property
    def dim(self) -> int:
        return len(self.values)

    def block_width(self, bck: int | None = None, fwd: int | None = None) -> int:
        bck, fwd = self.bck if bck is None else bck, self.fwd if fwd is None else fwd
        return self.block or max(8 * (bck + fwd), 4096 * self.delta, 1)

    def with_df(self, df: DataFrame, values=None) -> TimeSeries:
        return replace(self, df=df, values=tuple(values or self.values))

    # projections and filters

    def with_values(self, **exprs: Column) -> TimeSeries:
        """Values replaced by expressions over the columns; keys and ticks stay."""
        return self.with_df(self.df.select(*self.keys, *({self.ts, TICK} - set(self.keys)), *(e.alias(n) for n, e in exprs.items())), exprs)

    def filter(self, condition: Column | str) -> TimeSeries:
        """Rows for which the condition on tick and values holds; later windows don't see the others."""
        return self.with_df(self.df.where(condition))

    def dims(self, start: int, stop: int) -> TimeSeries:
        """Dimensions start..stop - 1."""
        return self.with_df(self.df, self.values[start:stop])

    def between(self, first: int, last: int) -> TimeSeries:
        """Rows that windows around targets first..last can reach: a filter that the scan can prune by."""
        return self.filter(F.col(TICK).between(first - self.bck, last + self.fwd))

    def to_array(self, name: str = "v") -> DataFrame:
        return self.df.select(*self.keys, TICK, F.array(*self.values).alias(name))

    def to_long(self) -> DataFrame:
        return self.df.select(*self.keys, TICK, F.posexplode(F.array(*[F.col(v).cast("double") for v in self.values])).alias("dim", "value"))

    # reductions

    def fold(self, **aggregates: Column) -> DataFrame:
        """Partial and final aggregation of expressions, for each key."""
        aggs = [a.alias(n) for n, a in aggregates.items()]
        return self.df.groupBy(*self.keys).agg(*aggs) if self.keys else self.df.agg(*aggs)

    def reduce(self, combine, name: str = "value") -> DataFrame:
        """An associative and commutative combine(a, b) over all rows' value arrays.

        The combiner is a column function, so it runs map-side over arrays of at most 4096 rows, and then over the partial results until one is left.
        """
        part = self.to_array().select(*self.keys, F.col("v"), F.monotonically_increasing_id().alias("n"))
        keys, width = list(self.keys), 4096
        fold = lambda c: F.reduce(F.slice(c, 2, F.size(c)), F.get(c, F.lit(0)), combine)
        rows = self.count() if not keys else part.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        for _ in range(max(1, math.ceil(math.log(max(rows, 2), width)))):
            groups = F.pmod(F.xxhash64("n"), F.lit(max(1, -(-rows // (width // 2)))))
            part = part.groupBy(*keys, groups.alias("n")).agg(F.collect_list("v").alias("all")).select(*keys, "n", fold(F.col("all")).alias("v"))
            rows = max(1, -(-rows // (width // 2)))
        return part.groupBy(*keys).agg(F.collect_list("v").alias("all")).select(*keys, fold(F.col("all")).alias(name))

    def count(self) -> int:
        return self.df.count()

    def size(self) -> int:
        """The declared number of samples, or else the counted one."""
        return self.n_samples if self.n_samples is not None else self.count()

    # to the driver

    def take(self, n: int) -> list:
        return self.df.orderBy(*self.keys, TICK).limit(n).collect()

    def collect(self, sample: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ticks and values in time order; with sample=n, of a Bernoulli sample of about n rows."""
        df = self.df.select(TICK, *self.values)
        if sample is not None:
            df = df.sample(False, min(1.0, sample / max(1, self.count())), seed)
        rows = df.orderBy(TICK).toPandas()
        return rows[TICK].to_numpy(), rows[list(self.values)].to_numpy()

    def require(self, bck: int = 0, fwd: int = 0) -> None:
        """The error contract of estimators: a window needs padding of its size."""
        if bck > self.bck or fwd > self.fwd:
            raise ValueError(f"padding ({self.bck}, {self.fwd}) is smaller than the window ({bck}, {fwd})")
