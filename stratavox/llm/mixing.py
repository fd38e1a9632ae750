"""Mixing sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, materialise

#: Draws have 62 bits. The cut of a source is narrowed by so many bits at a time, until so few documents are left.
DRAW_BITS, STEP_BITS, FEW = 62, 10, 10_000


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, text: Column) -> Column:
    """The seeded place of a document in its source, by its id and text; the same in every run.

    Documents without an id, or of one id, have places of their own as long as their texts differ.
    """
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), text), 64 - DRAW_BITS)


def water_fill(per_source: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = 3.0) -> DataFrame:
    """Targets of sources that share the sum of all sizes by weight, none above ``epochs`` times its size.

    ``per_source`` has one row per source (source, source_size). Sources in code-point order, null
    last, weigh ``weights``, repeating. Clamping the sources above their cap and resharing the rest
    by weight until none is above ends at one level: with sources sorted by cap / weight, the
    clamped ones are a prefix, so running sums over the sources give the fixed point exactly.
    The level is that of the first source that is not clamped; of sources that tie there, those
    behind it have sums in which it counts as clamped. Rows are sources, never documents (thousands
    of them, not millions: the running sums are one task). Sources of size 0 get target 0; an empty
    table gives none.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))))
    before = Window.orderBy("_fill", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = per_source.select("source", "source_size", rank.alias("_rank"), weight.alias("weight"))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(epochs))).withColumn("_fill", F.col("_cap") / F.col("weight"))
    rows = rows.withColumns(
        {
            "_total": F.sum("source_size").over(everything).cast("double"),
            "_weights": F.sum("weight").over(everything),
            "_caps_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("_level", (F.col("_total") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before")))
    rows = rows.withColumn("_clamped", F.col("_fill") <= F.col("_level"))
    level = F.min(F.when(~F.col("_clamped"), F.struct("_fill", "_rank", "_level"))).over(everything)["_level"]
    target = F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("weight") * level))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def plan(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = 3.0) -> DataFrame:
    """One row per source: its target, whole repetitions, and the cut for one repetition more.

    ``sizes`` has source, size and draw. A document with whole repetitions w is taken w times, and
    once more if its draw is below cut_draw; of those whose draw it is, ``cut_count`` are. The draws
    order a source's documents; the cut is where their running size is nearest to the fraction
    wanted, so a source misses its target by half of one document at most. The running sum is taken
    over the sums of hash buckets of ``STEP_BITS`` bits of the draw, then again within the bucket
    that holds the cut, until at most ``FEW`` documents are left there or they share one draw. So a
    source with a third of all rows is never gathered in one task.
    """
    drawn = sizes.select(F.col("source").alias("d_source"), "size", "draw")
    sums = drawn.groupBy(F.col("d_source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = water_fill(sums, weights, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio + F.lit(1e-12)).cast("int"))
    targets = materialise(targets.withColumn("goal", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "targets")

    def holds(rows: DataFrame, key: str) -> DataFrame:
        """source, key, before, goal, n: the one ``key`` of each source whose running sum passes the goal."""
        along = Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(along), F.lit(0)))
        return rows.filter((F.col("goal") > F.col("before")) & (F.col("goal") <= F.col("before") + F.col("size")))

    cut = targets.filter("goal > 0").select("source", "goal", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("place"))
    shift = DRAW_BITS
    while True:
        inside = drawn.join(cut, drawn["d_source"].eqNullSafe(cut["source"]) & (F.shiftright("draw", shift) == F.col("place"))).select("source", "goal", "before", "size", "draw")
        if shift == 0:
            break
        shift = max(0, shift - STEP_BITS)
        buckets = inside.groupBy("source", "goal", "before", F.shiftright("draw", shift).alias("place")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        found = materialise(holds(buckets, "place"), "cut_buckets")
        cut = found.select("source", "goal", "before", "place")
        if (found.agg(F.max("n")).first()[0] or 0) <= FEW:
            inside = drawn.join(cut, drawn["d_source"].eqNullSafe(cut["source"]) & (F.shiftright("draw", shift) == F.col("place"))).select("source", "goal", "before", "size", "draw")
            break
    # Rows of one draw repeat one id and text, so they have one size.
    last = holds(inside.groupBy("source", "goal", "before", "draw").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "draw")
    taken = F.round((F.col("goal") - F.col("before")) / (F.col("size") / F.col("n"))).cast("long")
    edge = last.select(F.col("source").alias("c_source"), F.col("draw").alias("cut_draw"), taken.alias("cut_count"))
    out = targets.join(edge, targets["source"].eqNullSafe(edge["c_source"]), "left")
    return materialise(out.select("source", "source_size", "weight", "target", "whole", "cut_draw", "cut_count"), "mix_plan")


def repetitions(docs: DataFrame, mix: DataFrame, place: Column) -> DataFrame:
    """``docs`` (source and any other columns) with source_size, target and repeats; ``place`` is each row's draw.

    Every document keeps its row: documents of sources that are not in ``mix`` get null figures and
    0 repeats. Names of the added columns that ``docs`` has already are taken over by this one.
    Rows at the cut of their source, all of one id and text, are counted off one by one: one
    document of a source, unless it is repeated.
    """
    added = ["source_size", "target", "repeats"]
    keep = [c for c in docs.columns if c not in added]
    m = mix.select(F.col("source").alias("__m_source"), *[F.col(c).alias(f"__m_{c}") for c in ("source_size", "target", "whole", "cut_draw", "cut_count")])
    placed = docs.select(*keep, place.alias("__place"))
    joined = placed.join(m, placed["source"].eqNullSafe(m["__m_source"]), "left")
    at_cut = F.coalesce(F.col("__place") == F.col("__m_cut_draw"), F.lit(False))
    number = F.row_number().over(Window.partitionBy("__m_source").orderBy("__place"))
    more = joined.filter(~at_cut).withColumn("__more", F.coalesce(F.col("__place") < F.col("__m_cut_draw"), F.lit(False)))
    rows = more.unionByName(joined.filter(at_cut).withColumn("__more", number <= F.col("__m_cut_count")))
    repeats = F.coalesce(F.col("__m_whole"), F.lit(0)) + F.when(F.col("__more"), 1).otherwise(0)
    return rows.select(*keep, F.col("__m_source_size").alias("source_size"), F.col("__m_target").alias("target"), repeats.cast("int").alias("repeats"))


def mix_sizes(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = 3.0) -> DataFrame:
    """Per document: doc_id, size, source_size, target, repeats, taken (words the mix takes).

    Null texts and empty ones have size 0; null sources form one source of their own; null ids and
    repeated rows count each. Sources that tie are filled alike, whatever their order. An empty
    table gives no rows. Extra columns of ``docs`` are ignored. The text is read once.
    """
    text = F.col("text")
    sizes = docs.select(F.col("doc_id"), F.col("source").cast(T.StringType()).alias("source"), size_of(text).alias("size"), draw(seed, text).alias("draw"))
    sizes = materialise(sizes, "sizes")
    out = repetitions(sizes, plan(sizes, weights, epochs), F.col("draw"))
    return out.select("doc_id", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = 3.0) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as many times as it is taken, columns unchanged."""
    columns = docs.columns
    place = draw(seed, F.col("text"))
    sizes = materialise(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), place.alias("draw")), "sizes")
    names = {c: f"__d_{i}" for i, c in enumerate(columns) if c not in ("doc_id", "source", "text")}
    hidden = docs.select(*[F.col(c).alias(names.get(c, c)) for c in columns])
    taken = repetitions(hidden, plan(sizes, weights, epochs), place).filter("repeats > 0")
    repeated = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return repeated.select(*[F.col(names.get(c, c)).alias(c) for c in columns])
