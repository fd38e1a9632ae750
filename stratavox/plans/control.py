"""Cancelling and timing of running work."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry ``tag``; ``cancel`` ends them from another thread."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    return spark.interruptTag(tag)


def counted(rows: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``rows`` with an observation of their number, filled by the first action on them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen


@dataclass
class Timings:
    """Seconds of named steps, for comparison of runs."""

    seconds: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def frame(self, spark: SparkSession, run: str) -> DataFrame:
        return spark.createDataFrame([(run, k, v) for k, v in self.seconds.items()], "run string, step string, seconds double")
