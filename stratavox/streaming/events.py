"""Event streams: debouncing, first results, latest requests, smoothing with state.

Every function takes a batch or a streaming DataFrame with ts (timestamp), unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from .progress import EMA_ALPHA, EMA_CHANGE


def debounced(events: DataFrame, by: str, value: str, order: tuple[str, ...] = ("ts",), gap: str = "50 milliseconds", late: str | None = None) -> DataFrame:
    """The last value of each burst: rows of one key with less than ``gap`` between them.

    With ``late``, the watermark of a stream: bursts are emitted when it has passed them.
    """
    rows = events if late is None else events.withWatermark("ts", late)
    return rows.groupBy(by, F.session_window("ts", gap).alias("burst")).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n")).select(by, F.col("burst.start").alias("first_ts"), "n", value)


def first_results(events: DataFrame, keys: list[str], late: str | None = None, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The first row of each key. A stream keeps the first that arrives, within its watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late or "10 minutes").dropDuplicatesWithinWatermark(keys)
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("__n", n).filter("__n = 1").drop("__n")


def latest_request(events: DataFrame, by: str, payload: str, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The request that counts: the last one of each key."""
    return events.groupBy(by).agg(F.max_by(payload, F.struct(*order)).alias(payload))


def smoothed_stream(events: DataFrame, by: str, value: str) -> DataFrame:
    """key, n, smoothed: the exponential mean of ``streaming.progress`` kept as state of each key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values("ts")
        for x in rows["value"]:
            if mean is None:
                mean = float(x)
            else:
                limit = mean * EMA_CHANGE
                mean += EMA_ALPHA * max(-limit, min(limit, x - mean))
            n += 1
        state.update((n, mean))
        yield pd.DataFrame({"key": [str(key[0])], "n": [n], "smoothed": [mean]})

    rows = events.select(F.col(by).cast("string").alias("key"), "ts", F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, n long, smoothed double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)


def in_order(results: DataFrame, by: str, index: str, value: str) -> DataFrame:
    """``results`` without those whose ``value`` is null, with their place by ``index`` within their ``by``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(index)) - 1
    return results.filter(F.col(value).isNotNull()).withColumn("place", place)
