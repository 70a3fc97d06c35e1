"""Table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Ticks:
    """Ticks from start to end, both included, every step; none if one of them is null or step isn't above 0."""

    def eval(self, start: int, end: int, step: int) -> Iterator[tuple[int]]:
        if start is not None and end is not None and step is not None and step > 0:
            for t in range(start, end + 1, step):
                yield (t,)


def register(spark: SparkSession) -> None:
    """lagoon_ticks(start, end, step) for SQL."""
    spark.udtf.register("lagoon_ticks", F.udtf(Ticks, returnType="tick: bigint"))
