"""Progress and remaining time of running work, as window queries over a task log.

A task log has run (any type), ts (timestamp), seq (ties) and weight. Every window is partitioned
by run, so runs are independent and rows of one run are what a task orders.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the estimates.
SPEED_SAMPLES, SPEED_LEAST = 10, 5
VELOCITY_SAMPLES, VELOCITY_LEAST = 30, 5
STEP_SAMPLES, STEP_LEAST = 100, 10
BLEND = {"elapsed": 0.5, "steps": 0.3, "velocity": 0.2}
EMA_ALPHA, EMA_CHANGE = 0.1, 0.2
STALL_SECONDS = 60


def _order():
    return Window.partitionBy("run").orderBy("ts", "seq")


def _all():
    return Window.partitionBy("run")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def numbered(log: DataFrame) -> DataFrame:
    """``log`` with i (from 1), total, elapsed (seconds since the run's first row) and gap (since the row before)."""
    at = seconds(F.col("ts"))
    return log.withColumns({"i": F.row_number().over(_order()), "total": F.count("*").over(_all()), "elapsed": at - F.min(at).over(_all()), "gap": at - F.lag(at).over(_order())})


def running(log: DataFrame) -> DataFrame:
    """step (running weight), percent, eta by the mean pace so far; null before anything has passed."""
    rows = numbered(log)
    upto = _order().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"step": F.sum("weight").over(upto), "work": F.sum("weight").over(_all())})
    percent = F.least(F.lit(100.0), F.when(F.col("work") > 0, 100.0 * F.col("step") / F.col("work")).otherwise(F.lit(0.0)))
    eta = F.when(F.col("step") > 0, F.col("elapsed") / F.col("step") * (F.col("work") - F.col("step")))
    return rows.withColumns({"percent": percent, "eta": eta})


def reported(progress: DataFrame, change: float = 0.1) -> DataFrame:
    """Rows whose percent differs from the row before by more than ``change``."""
    return progress.withColumn("__p", F.lag("percent").over(_order())).filter(F.col("__p").isNull() | (F.col("percent") - F.col("__p") > change)).drop("__p")


def speed_average(log: DataFrame) -> DataFrame:
    """Mean of the last 10 cumulative speeds, and the eta from it once there are 5."""
    rows = numbered(log).filter("elapsed > 0").withColumn("speed", F.col("i") / F.col("elapsed"))
    last = _order().rowsBetween(1 - SPEED_SAMPLES, 0)
    rows = rows.withColumns({"mean_speed": F.avg("speed").over(last), "samples": F.row_number().over(_order())})
    return rows.withColumn("eta", F.when(F.col("samples") >= SPEED_LEAST, (F.col("total") - F.col("i")) / F.col("mean_speed")))


def stages(log: DataFrame, sample: int = 20, levels: int = 3) -> DataFrame:
    """Estimates after 1, 2 and 3 samples, their change against the stage before, the third one adjusted for its trend."""
    rows = numbered(log).filter(F.col("i").isin(sample, 2 * sample, 3 * sample)).withColumn("stage", (F.col("i") / sample).cast("int"))
    per_item = F.col("elapsed") / F.col("i")
    factor = sum(0.25**k for k in range(levels))
    rows = rows.withColumns({"per_item": per_item, "estimate": F.col("total") * per_item * factor})
    by_stage = Window.partitionBy("run").orderBy("stage")
    before, first = F.lag("estimate").over(by_stage), F.first("estimate").over(by_stage)
    rows = rows.withColumn("change", F.when(before > 0, (F.col("estimate") - before) / before * 100)).withColumn("ratio", F.when(first > 0, F.col("estimate") / first))
    adjusted = F.when((F.col("stage") == 3) & (F.col("ratio") > 1.5), F.col("estimate") * (1 + (F.col("ratio") - 1) * 0.3)).otherwise(F.col("estimate"))
    return rows.withColumn("adjusted", adjusted)


def stalls(log: DataFrame, least: float = STALL_SECONDS) -> DataFrame:
    """Rows that came ``least`` seconds or more after the one before."""
    return numbered(log).filter(F.col("gap") >= least)


def velocity_median(log: DataFrame) -> DataFrame:
    """Median of the last 30 velocities (rows a second), once there are 5."""
    rows = numbered(log).filter("gap > 0").withColumn("velocity", 1 / F.col("gap"))
    last = _order().rowsBetween(1 - VELOCITY_SAMPLES, 0)
    n = F.count("*").over(last)
    return rows.withColumn("median_velocity", F.when(n >= VELOCITY_LEAST, F.percentile("velocity", F.lit(0.5)).over(last)))


def trimmed_mean(sorted_values: Column) -> Column:
    """Mean of a sorted array without a tenth, and one at least, at either end; null below 10 values."""
    n = F.size(sorted_values)
    cut = F.greatest(F.lit(1), F.floor(n / 10).cast("int"))
    kept = F.slice(sorted_values, cut + 1, n - 2 * cut)
    return F.when(n >= STEP_LEAST, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept))


def step_means(log: DataFrame) -> DataFrame:
    """run, steps, step_mean over the last 100 gaps of each run."""
    last = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("ts"), F.desc("seq")))
    rows = numbered(log).filter("gap is not null").withColumn("__n", last).filter(F.col("__n") <= STEP_SAMPLES)
    # At most 100 values a run.
    return rows.groupBy("run").agg(F.array_sort(F.collect_list("gap")).alias("gaps")).select("run", F.size("gaps").alias("steps"), trimmed_mean(F.col("gaps")).alias("step_mean"))


def blended(log: DataFrame, remaining: Column) -> DataFrame:
    """run, eta: the weighted mean of the estimates that a run's last row has.

    Elapsed time weighs .5, trimmed step times .3, median velocity .2; weights of absent ones drop out.
    """
    final = numbered(log).filter(F.col("i") == F.col("total")).select("run", "total", "elapsed", remaining.alias("remaining"))
    speed = velocity_median(log).withColumn("__n", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("ts"), F.desc("seq")))).filter("__n = 1").select("run", "median_velocity")
    rows = final.join(step_means(log), "run", "left").join(speed, "run", "left")
    estimates = {"elapsed": F.col("elapsed") / F.col("total") * F.col("remaining"), "steps": F.col("step_mean") * F.col("remaining"), "velocity": F.when(F.col("median_velocity") > 0, F.col("remaining") / F.col("median_velocity"))}
    total = sum((F.coalesce(e * BLEND[k], F.lit(0.0)) for k, e in estimates.items()), F.lit(0.0))
    weight = sum((F.when(e.isNotNull(), BLEND[k]).otherwise(0.0) for k, e in estimates.items()), F.lit(0.0))
    return rows.select("run", (total / weight).alias("eta"))


def smoothed(values: Column) -> Column:
    """The last value of an exponential mean over an array: each step moves by a tenth of a change of at most a fifth."""

    def step(acc: Column, x: Column) -> Column:
        limit = acc * EMA_CHANGE
        change = F.when(F.abs(x - acc) > limit, F.when(x > acc, limit).otherwise(-limit)).otherwise(x - acc)
        return F.when(acc.isNull(), x).otherwise(acc + EMA_ALPHA * change)

    return F.aggregate(values, F.lit(None).cast("double"), step)


def smoothed_etas(log: DataFrame) -> DataFrame:
    """run, eta: the running etas of each run, smoothed in order."""
    rows = running(log).filter("eta is not null")
    return rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "eta"))).alias("e")).select("run", smoothed(F.transform("e", lambda x: x["eta"])).alias("eta"))


def without_outliers(log: DataFrame, skip: int = 3, factor: float = 5.0) -> DataFrame:
    """run, i, gap of the steps kept: each below ``factor`` times the median of the last 100 kept before it.

    What is kept depends on what was kept before, so runs are folded one by one.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for r in rows.sort_values("i").itertuples():
            if r.i > skip and r.gap == r.gap and (not kept or r.gap < np.median(kept[-STEP_SAMPLES:]) * factor):
                kept.append(r.gap)
                out.append((r.run, r.i, r.gap))
        return pd.DataFrame(out, columns=["run", "i", "gap"])

    rows = numbered(log).select(F.col("run").cast("string").alias("run"), F.col("i").cast("long").alias("i"), "gap")
    return rows.groupBy("run").applyInPandas(run, "run string, i long, gap double")


def first_warnings(lines: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` warnings of a log (ts, seq, level, ...); a report of the top rows."""
    return lines.filter(F.upper("level") == "WARNING").orderBy("ts", "seq").limit(n)


def last_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of a log (ts, seq, ...), in order."""
    return lines.orderBy(F.desc("ts"), F.desc("seq")).limit(n).orderBy("ts", "seq")


def sample_size(work: int, asked: int | None = None) -> int:
    """The size asked for, within 1 to 100, or 2 % of the work within 20 to 30."""
    return max(1, min(100, asked)) if asked is not None else max(20, min(30, int(work * 0.02)))


def generation_ratio(log: DataFrame, by: str, made: Column) -> DataFrame:
    """made, loaded and the share made, by group."""
    n = F.sum(made.cast("bigint"))
    return log.groupBy(by).agg(n.alias("made"), (F.count("*") - n).alias("loaded"), (n / F.count("*")).alias("ratio"))
