"""Folds over the rows of a run in order, whose state is small: for batches, and for streams with state.

A stream's rows wait in state until the watermark has passed them, so that they are folded in order
whatever the order of arrival; a timer wakes the run. State is kept by a store with timers: set
``spark.sql.streaming.stateStore.providerClass`` to Spark's RocksDB provider.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .progress import EMA_ALPHA, EMA_CHANGE, STEP_SAMPLES

KEPT = "run string, i long, gap double"


class LastMedian:
    """The median of the last ``size`` values, which are kept in order of arrival and in order of size."""

    def __init__(self, values: list[float], size: int = STEP_SAMPLES):
        self.size, self.arrived, self.sorted = size, deque(values[-size:]), sorted(values[-size:])

    def add(self, value: float) -> None:
        self.arrived.append(value)
        insort(self.sorted, value)
        if len(self.arrived) > self.size:
            del self.sorted[bisect_left(self.sorted, self.arrived.popleft())]

    def median(self) -> float | None:
        n = len(self.sorted)
        return (self.sorted[(n - 1) // 2] + self.sorted[n // 2]) / 2 if n else None


class StepFold:
    """Steps of a run without outliers: kept below ``factor`` times the median of the last ones kept, after ``skip`` rows."""

    def __init__(self, n: int = 0, last: float | None = None, kept: list[float] | None = None, skip: int = 3, factor: float = 5.0):
        self.n, self.last, self.kept, self.skip, self.factor = n, last, LastMedian(kept or []), skip, factor

    def row(self, second: float) -> tuple[int, float] | None:
        """The number and gap of the run's next row, if it is kept."""
        gap, self.last, self.n = None if self.last is None else second - self.last, second, self.n + 1
        if self.n <= self.skip or gap is None:
            return None
        median = self.kept.median()
        if median is not None and not gap < median * self.factor:
            return None
        self.kept.add(gap)
        return self.n, gap


class MeanFold:
    """The exponential mean of a run: a step moves it by a tenth of a change of at most a fifth."""

    def __init__(self, n: int = 0, mean: float | None = None):
        self.n, self.mean = n, mean

    def add(self, value: float) -> float:
        self.n += 1
        if self.mean is None:
            self.mean = value
        else:
            limit = abs(self.mean) * EMA_CHANGE
            self.mean += EMA_ALPHA * max(-limit, min(limit, value - self.mean))
        return self.mean


class _InOrder(StatefulProcessor):
    """Keeps the rows (micros, seq, value) of a run until the watermark has passed them, then folds them in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, seq long, value double")
        self.folded = handle.getValueState("folded", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for batch in rows:
            data = [(int(m), int(s), float(v)) for m, s, v in zip(batch["micros"], batch["seq"], batch["value"], strict=True)]
            if data:
                self.waiting.appendList(data)
                first = min([d[0] for d in data] + ([first] if first is not None else []))
        if first is not None:
            # One timer is enough: when it goes off it sets the next one.
            at = max(first // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(at)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(max(rest[0][0] // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.waiting.clear()
        yield pd.DataFrame(self.fold(str(key[0]), ready), columns=self.columns)

    def close(self) -> None:
        pass


class _Steps(_InOrder):
    state, columns = "n long, last long, kept array<double>", ["run", "i", "gap"]

    def fold(self, run: str, rows: list[tuple]) -> list[tuple]:
        n, last, kept = self.folded.get() if self.folded.exists() else (0, None, [])
        fold = StepFold(n, None if last is None else last / 1e6, list(kept))
        out = [(run, *found) for found in (fold.row(r[0] / 1e6) for r in rows) if found is not None]
        if rows:
            self.folded.update((fold.n, rows[-1][0], list(fold.kept.arrived)))
        return out


class _Means(_InOrder):
    state, columns = "n long, mean double", ["run", "n", "smoothed"]

    def fold(self, run: str, rows: list[tuple]) -> list[tuple]:
        n, mean = self.folded.get() if self.folded.exists() else (0, None)
        fold = MeanFold(n, mean)
        out = [(run, fold.n + 1, fold.add(r[2])) for r in rows]
        if rows:
            self.folded.update((fold.n, fold.mean))
        return out


def _stream(log: DataFrame, value: str | None, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    rows = log.withWatermark("ts", late)
    number = F.lit(0.0) if value is None else F.col(value).cast("double")
    rows = rows.select(F.col("run").cast("string").alias("run"), "ts", F.unix_micros("ts").alias("micros"), F.col("seq").cast("long").alias("seq"), number.alias("value"))
    return rows.groupBy("run").transformWithStateInPandas(processor, schema, "append", "eventTime")


def kept_steps_stream(log: DataFrame, late: str = "10 seconds") -> DataFrame:
    """``progress.without_outliers`` of a stream (run, ts, seq): run, i, gap of the steps kept.

    The state of a run is its last row, the last 100 steps kept and what still waits. Rows later than
    ``late`` behind the latest one are dropped, as by any watermark.
    """
    return _stream(log, None, late, _Steps(), KEPT)


def smoothed_steps_stream(log: DataFrame, value: str, late: str = "10 seconds") -> DataFrame:
    """run, n, smoothed after each row of a stream (run, ts, seq, ``value``), rows in order of (ts, seq)."""
    return _stream(log, value, late, _Means(), "run string, n long, smoothed double")


def kept_steps(log: DataFrame) -> DataFrame:
    """run, i, gap of the steps kept in a finished log, runs folded one by one with the streams' state."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fold, name = StepFold(), rows["run"].iloc[0]
        found = [fold.row(second) for second in rows.sort_values(["second", "seq"])["second"]]
        return pd.DataFrame([(name, *f) for f in found if f is not None], columns=["run", "i", "gap"])

    rows = log.select(F.col("run").cast("string").alias("run"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("second"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("run").applyInPandas(run, KEPT)
