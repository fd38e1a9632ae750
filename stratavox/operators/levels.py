"""Pyramid levels: how many, how large, how much work, which one to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import duration_text

#: Fixed limits of the two generators.
LARGEST_SIDE = 500
SELECT_SIDE = 512
MAX_LEVELS = 20


def levels_needed(width: int, height: int, limit: int = LARGEST_SIDE) -> int:
    """Least number of halvings after which both sides are within ``limit``; may be 0."""
    n = 0
    while width >> n > limit or height >> n > limit:
        n += 1
    return n


def levels_needed_column(width: Column, height: Column, limit: int = LARGEST_SIDE) -> Column:
    fits = lambda k: (F.call_function("shiftright", width, k) <= limit) & (F.call_function("shiftright", height, k) <= limit)
    return F.array_min(F.filter(F.sequence(F.lit(0), F.lit(31)), fits))


def output_count(n: int, level: int, odd: str = "keep") -> int:
    for _ in range(level):
        n = n // 2 + (n % 2 if odd == "keep" else 0)
    return n


def work_estimate(seq_begin: int, seq_end: int, size: int, max_size: int) -> list[dict]:
    """Levels with images, size and weight until the size falls below ``max_size``.

    Each level counts half the images and one more, and weighs them by area.
    """
    rows, side = [], float(size)
    while side >= max_size:
        side /= 2
        rows.append({"level": len(rows) + 1, "images": (seq_end - seq_begin + 1) // 2 + 1, "size": int(side), "weight": (side / size) ** 2})
        seq_end = int((seq_end - seq_begin) / 2) + seq_begin
    return rows


def work_estimates(stacks: DataFrame, max_size: int) -> DataFrame:
    """``work_estimate`` of many stacks (stack_id, seq_begin, seq_end, size): a row for each stack and level."""
    side = lambda k: F.col("size") / F.pow(F.lit(2.0), k)
    steps = F.filter(F.sequence(F.lit(1), F.lit(62)), lambda k: side(k - 1) >= max_size)
    rows = stacks.withColumn("level", F.explode(steps))
    span = F.call_function("shiftright", (F.col("seq_end") - F.col("seq_begin")).cast("bigint"), F.col("level") - 1)
    out = {"images": F.call_function("div", span + 1, F.lit(2)) + 1, "__size": F.floor(side(F.col("level"))).cast("bigint"), "weight": F.pow(F.lit(0.25), F.col("level"))}
    return rows.withColumns(out).drop("size", "seq_begin", "seq_end").withColumnRenamed("__size", "size")


def catalog(stacks: DataFrame, limit: int = LARGEST_SIDE) -> DataFrame:
    """``stacks`` (stack_id, width, height, n) exploded to levels 0 and up with their width, height, n."""
    shift = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    rows = stacks.withColumn("level", F.explode(F.sequence(F.lit(0), levels_needed_column(F.col("width"), F.col("height"), limit))))
    unit = F.call_function("shiftleft", F.lit(1), F.col("level"))
    count = F.call_function("div", F.col("n") + unit - 1, unit)
    return rows.select("stack_id", "level", shift("width").alias("width"), shift("height").alias("height"), count.alias("n"))


def group_weights(levels: DataFrame) -> DataFrame:
    """``levels`` from 1 on with weight: an eighth of the level before."""
    return levels.filter("level >= 1").withColumn("weight", F.pow(F.lit(0.125), F.col("level") - 1))


def choose_level(levels: DataFrame, limit: int = SELECT_SIDE) -> DataFrame:
    """Per stack, the first level whose longer side is below ``limit``, or else the last one.

    An answer from such a level differs from one at full resolution, so callers ask for it by name.
    """
    order = Window.partitionBy("stack_id").orderBy(F.desc("fits"), F.when(F.col("fits"), F.col("level")).otherwise(-F.col("level")))
    rows = levels.withColumn("fits", F.greatest("width", "height") < limit).withColumn("__n", F.row_number().over(order))
    return rows.filter("__n = 1").drop("__n", "fits")


def with_weights(tasks: DataFrame, weights: DataFrame) -> DataFrame:
    """``tasks`` with the weight of their level, 1 where ``weights`` (level, weight) has none. One row per level, so few."""
    return tasks.join(weights.select("level", "weight"), "level", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def load_level(slices: DataFrame, level: int) -> DataFrame:
    """The slices of one level, unchanged; a folder per level is pruned to that level's."""
    return slices.filter(F.col("level") == level)


def load_chosen(slices: DataFrame, limit: int = SELECT_SIDE) -> DataFrame:
    """Each stack's slices at the level that ``choose_level`` names, 8 bits a pixel."""
    from ..sources.sequence import level_catalog
    from .pyramid import display_slices

    chosen = choose_level(level_catalog(slices), limit).select("stack_id", "level")
    return display_slices(slices.join(chosen, ["stack_id", "level"], "left_semi"))


def estimate_bundle(base: Column, levels: int) -> Column:
    """struct(levels, total, text): seconds by level, their sum, and the sum as text."""
    total = total_time(base, levels)
    return F.struct(level_times(base, levels).alias("levels"), total.alias("total"), duration_text(total).alias("text"))


def level_times(base: Column, levels: int, factor: float = 0.25) -> Column:
    """array of seconds by level, each a quarter of the one before."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: base * F.pow(F.lit(factor), k))


def total_time(base: Column, levels: int, factor: float = 0.25) -> Column:
    return F.aggregate(level_times(base, levels, factor), F.lit(0.0), lambda s, x: s + x)


def run_comparison(current: DataFrame, baseline: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Percent change of speed, seconds and memory by run, two decimals; regression where speed fell by more than ``threshold``."""
    measures = ("speed", "seconds", "memory")
    old = baseline.select("run", *[F.col(m).alias(f"base_{m}") for m in measures])
    change = lambda m: F.when(F.col(f"base_{m}") <= 0, F.lit(0.0)).otherwise(F.round((F.col(m) - F.col(f"base_{m}")) / F.col(f"base_{m}") * 100, 2))
    rows = current.join(old, "run").select("run", *[change(m).alias(f"{m}_change") for m in measures])
    return rows.withColumn("regression", F.col("speed_change") < -threshold)
