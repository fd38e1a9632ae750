"""Merkle manifest: a hash tree over each group's rows in id order, and one over the groups.

Ranks come from histograms of the digits of the ids, one level of digits below another, so no task
sorts a group. The digits of a rank in base ``FANOUT`` are the row's path through its tree; nodes
are made from the longest paths upward, and proofs go down the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

FANOUT = 8
#: Bits of a digit, and rows that a cell of the finest histogram may hold.
DIGIT_BITS = 12
CELL = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(texts: Column) -> Column:
    """The sha256 of the joined texts of an array, in lowercase hexadecimal."""
    return F.sha2(F.array_join(texts, ""), 256)


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lowered(text: Column) -> Column:
    """``text`` with A to Z in lower case; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def _digits(low: int | None, high: int | None) -> list[Column]:
    """Digits that order rows by id (null first), then leaf, then place, from the first to the last.

    Bits that all ids share are left out. The place, given when rows were written, tells repeated
    rows apart, which are alike in all that is returned.
    """
    def of(number: Column, bits: int) -> list[Column]:
        return [F.shiftrightunsigned(number, max(0, at)).bitwiseAND((1 << min(DIGIT_BITS, at + DIGIT_BITS)) - 1).cast("int") for at in range(bits - DIGIT_BITS, -DIGIT_BITS, -DIGIT_BITS)]

    bits = 0 if low is None else ((low ^ high) & (2**64 - 1)).bit_length()
    ids = of(F.col("key").bitwiseXOR(F.lit(-(2**63))), bits)
    ids = [F.col("key").isNotNull().cast("int")] + [F.coalesce(d, F.lit(0)) for d in ids]
    if len(ids) > 1:
        ids[:2] = [F.when(F.col("key").isNull(), -1).otherwise(ids[1])]
    leaves = [F.conv(F.substring("leaf", at, 3), 16, 10).cast("int") for at in range(1, 64, 3)]
    return ids + leaves + of(F.col("place"), 63)


def ranked(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (grp, key, leaf, place and others) with rank: 0, 1, ... by key, leaf and place in each group.

    ``groups`` is (grp, n, low, high), a row for each group. Digits are added until no cell of the
    histogram has more than ``CELL`` rows; one number for each try comes to the driver. A cell's first
    rank is the sum of what its left neighbours hold, level by level: a window never sees more than
    the digits of one level, and rows are numbered inside their cell alone.
    """
    span = groups.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("n").alias("n")).first()
    digits = _digits(span["low"], span["high"])
    names = [f"d{i}" for i in range(len(digits))]
    deep, room = 1, CELL << DIGIT_BITS
    while room < (span["n"] or 0) and deep < len(digits):
        deep, room = deep + 1, room << DIGIT_BITS
    while True:
        cells = rows.groupBy("grp", *[d.alias(n) for d, n in zip(digits[:deep], names, strict=False)]).agg(F.count("*").alias("n"))
        cells = materialise(cells, "cells")
        if deep == len(digits) or (cells.agg(F.max("n")).first()[0] or 0) <= CELL:
            break
        deep += 1
    first = None
    for k in range(1, deep + 1):
        level = cells if k == deep else cells.groupBy("grp", *names[:k]).agg(F.sum("n").alias("n"))
        before = Window.partitionBy("grp", *names[: k - 1]).orderBy(names[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        if first is not None:
            level = _same(level, first.withColumnRenamed("first", "above"), ["grp", *names[: k - 1]]).withColumn("first", F.col("first") + F.col("above")).drop("above")
        first = level
    for d, n in zip(digits[:deep], names, strict=False):
        rows = rows.withColumn(n, d)
    inside = Window.partitionBy("grp", *names[:deep]).orderBy(F.asc_nulls_first("key"), "leaf", "place")
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1)
    rows = _same(rows, first, ["grp", *names[:deep]])
    return rows.withColumn("rank", F.col("rank") + F.col("first")).drop("first", "place", *names[:deep])


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where the group's null equals null."""
    named = right.withColumnsRenamed({k: f"r_{k}" for k in keys})
    on = left["grp"].eqNullSafe(named["r_grp"])
    for k in keys[1:]:
        on = on & (left[k] == named[f"r_{k}"])
    return left.join(named, on).drop(*[f"r_{k}" for k in keys])


def grown(leaves: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The levels of nodes over ``leaves`` (grp, node, n, hash and others), from the lowest up.

    A level has (grp, node, n, kids, hash): ``kids`` are the up to ``FANOUT`` rows below in order, n
    the number of nodes of the group in the level of the kids. Where that is 1 the group is finished
    and its node goes up unchanged. ``most`` is the largest n.
    """
    levels, below = [], leaves
    while most > 1 or not levels:
        kid = F.struct("node", *[c for c in below.columns if c not in ("grp", "node", "n")])
        level = below.groupBy("grp", F.expr(f"node div {FANOUT}").alias("up")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(kid)).alias("kids"))
        joined = digest(F.transform("kids", lambda x: x["hash"]))
        level = level.select("grp", F.col("up").alias("node"), "n", "kids", F.when(F.col("n") == 1, F.get("kids", F.lit(0))["hash"]).otherwise(joined).alias("hash"))
        levels.append(materialise(level, f"{name}_{len(levels)}"))
        below = levels[-1].select("grp", "node", F.ceil(F.col("n") / FANOUT).alias("n"), "hash")
        most = -(-most // FANOUT)
    return levels


def _opened(level: DataFrame) -> DataFrame:
    """The kids of a ``level`` that has a column path: each with its own path, from itself to the root.

    A path is an array of (left, right), the hashes of the other kids of each run, joined.
    """
    kids = F.transform("kids", lambda x: x["hash"])
    own = F.transform(kids, lambda h, i: F.struct(F.array_join(F.slice(kids, 1, i), "").alias("left"), F.array_join(F.slice(kids, i + 2, FANOUT), "").alias("right")))
    steps = F.when(F.col("n") > 1, own)
    rows = level.select("grp", "subroot", "path", F.explode(F.arrays_zip(F.col("kids").alias("kid"), F.coalesce(steps, F.transform(kids, lambda h: F.lit(None).cast("struct<left:string,right:string>"))).alias("step"))).alias("x"))
    path = F.when(F.col("x.step").isNull(), F.col("path")).otherwise(F.concat(F.array("x.step"), "path"))
    return rows.select("grp", "subroot", "x.kid.*", path.alias("path"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of ``docs``.

    ``docs`` has the columns ``FIELDS``, any others are ignored; doc_id is an integer. Leaves are the
    rows of a language by ascending doc_id, null ids first, rows of one id by their leaf; rows that
    repeat all fields have equal leaves at neighbouring places, each with its own proof. Languages
    follow in the order of their bytes, null first. ``tampered`` is true where the text is checked
    with A to Z in lower case: ``folded_root`` is then recomputed from that leaf. Where it is null,
    or the text is null or has no capitals, nothing is tampered with. Nulls of any column count as
    ``-``, texts are hashed whole, an empty table gives no rows.

    A row for each language comes together in one task; everything else is dealt out by rank. The
    tree's levels are tables in the shared folder, each an eighth of the one below.
    """
    plain = leaf([F.col(c) for c in FIELDS])
    other = leaf([lowered(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    rows = docs.select(F.col("lang").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("key"), plain.alias("leaf"), F.when(tampered, other).alias("changed"), F.monotonically_increasing_id().alias("place"))
    rows = materialise(rows, "leaves")
    groups = materialise(rows.groupBy("grp").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")), "groups")
    most = groups.agg(F.max("n"), F.count("*")).first()
    leaves = ranked(rows, groups)
    sizes = groups.select("grp", "n")
    leaves = _same(leaves, sizes, ["grp"]).select("grp", F.col("rank").alias("node"), "n", F.col("leaf").alias("hash"), "key", "changed")
    levels = grown(leaves, most[0] or 0, "nodes")
    tops = levels[-1].select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("lang"), "hash")
    tops = tops.withColumn("node", F.row_number().over(Window.orderBy(F.asc_nulls_first("lang"))) - 1).withColumn("n", F.lit(most[1]))
    above = grown(tops, most[1], "tops")
    root = above[-1].select("hash").first()
    empty = F.array().cast("array<struct<left:string,right:string>>")
    open_ = above[-1].withColumn("subroot", F.lit("")).withColumn("path", empty)
    for below in [*above[:-1][::-1], None]:
        paths = _opened(open_)
        if below is not None:
            open_ = _same(below.drop("hash"), paths.select("grp", "node", "subroot", "path"), ["grp", "node"])
    paths = paths.select(F.col("lang").alias("grp"), F.lit(0).alias("node"), F.col("hash").alias("subroot"), "path")
    for below in levels[::-1]:
        open_ = _same(below.drop("hash"), paths, ["grp", "node"])
        paths = _opened(open_)
    proof = digest(F.flatten(F.transform("path", lambda s: F.array(s["left"], s["right"]))))
    found = paths.select(F.col("key").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", F.lit(root and root[0]).cast("string").alias("root"), proof.alias("proof_sha256"), fold(F.coalesce("changed", "hash"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
