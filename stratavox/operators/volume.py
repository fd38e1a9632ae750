"""Volumes in long form (z, y, x, v): cropping, resampling, statistics, thresholds.

``by`` names further key columns (stack, level) that every operator keeps apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import div, histogram_scale, threshold_on_type

#: Fixed values of the automatic set-up.
BINS = 256
MIN_SEPARABILITY = 0.2
MIN_FOREGROUND, MAX_FOREGROUND = 0.001, 0.95
TRIVIAL_COVERAGE = 0.98
OCCUPANCY = 0.001


def voxels(slices: DataFrame) -> DataFrame:
    """Long form of slices with BINARY pixels (8 or 16 bits, little-endian): keys, z, y, x, v."""
    size = div(F.col("bit_depth"), 8)
    n = (F.col("width") * F.col("height")).cast("int")
    byte = lambda i: F.conv(F.hex(F.substring("pixels", i + 1, F.lit(1))), 16, 10).cast("int")
    value = lambda i: F.when(size == 1, byte(i)).otherwise(byte(2 * i) + 256 * byte(2 * i + 1))
    rows = slices.filter("pixels is not null").select("stack_id", "level", "z", "width", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), value)).alias("p", "v"))
    return rows.select("stack_id", "level", "z", div(F.col("p"), F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).alias("x"), "v")


@dataclass(frozen=True)
class Crop:
    """Half-open bounds on the smallest level, and the factor back to the level they came from."""

    z0: int
    z_end: int
    y0: int
    y_end: int
    x0: int
    x_end: int
    factor: int

    def roi(self) -> list[int]:
        return [v * self.factor for v in (self.z0, self.z_end, self.y0, self.y_end, self.x0, self.x_end)]


def crop_bounds(current: dict, smallest: dict, bottom: int, top: int, box: tuple[int, int, int, int]) -> Crop:
    """Bounds given on one level, carried to the smallest.

    ``current`` and ``smallest`` are catalog rows with level, width, height, seq_begin, seq_end.
    Positions go through fractions of doubles and are truncated. An unset or inverted slice range
    is the whole one, up to but without the last slice. The scale is that of the levels' numbers.
    """
    count = current["seq_end"] - current["seq_begin"] + 1
    if top < 0 or bottom < 0 or bottom > top:
        bottom, top = 0, count - 1
    depth = smallest["seq_end"] - smallest["seq_begin"] + 1
    z0 = max(0, min(int(bottom / float(count) * depth), depth - 1))
    z_end = max(0, min(int(top / float(count) * depth), depth))
    if z_end <= z0:
        z_end = min(z0 + 1, depth)

    def along(lo: int, hi: int, extent: int, small: int) -> tuple[int, int]:
        a, b = int(lo / float(extent) * small), int(hi / float(extent) * small)
        if a < 0 or b > small:
            a = max(0, min(a, small - 1))
            b = max(a + 1, min(b, small))
        return a, b

    x0, x_end = along(box[0], box[2], current["width"], smallest["width"])
    y0, y_end = along(box[1], box[3], current["height"], smallest["height"])
    return Crop(z0, z_end, y0, y_end, x0, x_end, 2 ** (smallest["level"] - current["level"]))


def crop(vox: DataFrame, c: Crop) -> DataFrame:
    """The voxels within the bounds, coordinates from 0. The ranges are plain predicates, so they reach the scan."""
    inside = (F.col("z") >= c.z0) & (F.col("z") < c.z_end) & (F.col("y") >= c.y0) & (F.col("y") < c.y_end) & (F.col("x") >= c.x0) & (F.col("x") < c.x_end)
    rest = [k for k in vox.columns if k not in ("z", "y", "x")]
    return vox.filter(inside).select((F.col("z") - c.z0).alias("z"), (F.col("y") - c.y0).alias("y"), (F.col("x") - c.x0).alias("x"), *rest)


#: Slices of a bin in which voxels meet the regions of their stack.
CROP_BIN = 16


def crop_ranges(regions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Half-open bounds z0, z_end, y0, y_end, x0, x_end of each region on the smallest level of its stack, and the factor back.

    ``regions``: region_id, stack_id, level, bottom, top, x1, y1, x2, y2; ``catalog`` as from
    ``sequence.level_catalog``. Bounds follow ``crop_bounds``, with the same order of operations in
    doubles. Regions of a level that the catalog lacks are left out.
    """
    small = catalog.groupBy("stack_id").agg(F.max(F.struct("level", "width", "height", "seq_begin", "seq_end")).alias("s"))
    rows = regions.join(catalog.select("stack_id", "level", F.col("width").alias("__w"), F.col("height").alias("__h"), (F.col("seq_end") - F.col("seq_begin") + 1).alias("__n")), ["stack_id", "level"]).join(small, "stack_id")
    unset = (F.col("top") < 0) | (F.col("bottom") < 0) | (F.col("bottom") > F.col("top"))
    depth = F.col("s.seq_end") - F.col("s.seq_begin") + 1
    at = lambda v, extent, n: (v.cast("double") / extent.cast("double") * n).cast("int")
    bottom, top = F.when(unset, 0).otherwise(F.col("bottom")), F.when(unset, F.col("__n") - 1).otherwise(F.col("top"))
    z0 = F.greatest(F.lit(0), F.least(at(bottom, F.col("__n"), depth), depth - 1)).cast("int")
    z1 = F.greatest(F.lit(0), F.least(at(top, F.col("__n"), depth), depth)).cast("int")
    out = {"z0": z0, "z_end": F.when(z1 <= z0, F.least(z0 + 1, depth)).otherwise(z1).cast("int")}
    for axis, extent, n in (("y", F.col("__h"), F.col("s.height")), ("x", F.col("__w"), F.col("s.width"))):
        a, b = at(F.col(f"{axis}1"), extent, n), at(F.col(f"{axis}2"), extent, n)
        beyond = (a < 0) | (b > n)
        low = F.when(beyond, F.greatest(F.lit(0), F.least(a, n - 1))).otherwise(a)
        out |= {f"{axis}0": low.cast("int"), f"{axis}_end": F.when(beyond, F.greatest(low + 1, F.least(b, n))).otherwise(b).cast("int")}
    factor = F.pow(F.lit(2.0), F.col("s.level") - F.col("level")).cast("int")
    return rows.select("region_id", "stack_id", F.col("s.level").alias("level"), *[c.alias(k) for k, c in out.items()], factor.alias("factor"))


def crop_regions(vox: DataFrame, ranges: DataFrame) -> DataFrame:
    """region_id and the voxels of each region, coordinates from 0: crops of all stacks in one range join.

    ``vox`` is stack_id, level, z, y, x, v; ``ranges`` as from ``crop_ranges``. Voxels and regions meet in
    bins of ``CROP_BIN`` slices of their stack, each voxel in one, so a region meets only the bins that it
    reaches and a stack is many keys. Regions may overlap; an empty one gives no rows.
    """
    bins = F.sequence(F.floor(F.col("z0") / CROP_BIN), F.floor((F.col("z_end") - 1) / CROP_BIN))
    asked = ranges.filter("z_end > z0 and y_end > y0 and x_end > x0").withColumn("__bin", F.explode(bins))
    rows = vox.withColumn("__bin", F.floor(F.col("z") / CROP_BIN))
    inside = [(F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}_end")) for c in "zyx"]
    met = rows.join(asked, ["stack_id", "level", "__bin"]).filter(inside[0] & inside[1] & inside[2])
    return met.select("region_id", "stack_id", *[(F.col(c) - F.col(f"{c}0")).alias(c) for c in "zyx"], "v")


def pair_average(vox: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Floor of the mean of slices 2k and 2k + 1; a last slice without partner stays as it is."""
    half = div(F.col("z"), 2).alias("z")
    return vox.groupBy(*by, half, "y", "x").agg(div(F.sum(F.col("v").cast("bigint")), F.count("*")).cast("int").alias("v"))


def box_reduce(vox: DataFrame, width: int, height: int, variant: str = "round", by: tuple[str, ...] = ()) -> DataFrame:
    """2 by 2 means within slices: rounded half up or floored; an odd last row or column is dropped."""
    whole = vox.filter((F.col("x") < width // 2 * 2) & (F.col("y") < height // 2 * 2))
    more = 2 if variant == "round" else 0
    value = div(F.sum(F.col("v").cast("bigint")) + more, 4).cast("int")
    return whole.groupBy(*by, "z", div(F.col("y"), 2).alias("y"), div(F.col("x"), 2).alias("x")).agg(value.alias("v"))


def halve(vox: DataFrame, width: int, height: int, depth: int, variant: str = "round", odd: str = "keep", by: tuple[str, ...] = ()) -> DataFrame:
    """The next pyramid level, in one aggregation per voxel of the result.

    ``round``: each slice is reduced 2 by 2 with halves up, then pairs of slices average with halves
    up. ``floor``: pairs of pixels average first, then 2 by 2, both floored. The two roundings do
    not merge into one mean of eight, so the partial sums are kept apart within the aggregate: by
    slice parity, or by place in the square. A last slice without partner is reduced alone, or
    dropped with ``odd='drop'``.
    """
    whole = vox.filter((F.col("x") < width // 2 * 2) & (F.col("y") < height // 2 * 2))
    if odd == "drop":
        whole = whole.filter(F.col("z") < depth // 2 * 2)
    v, key = F.col("v").cast("bigint"), [div(F.col(c), 2).alias(c) for c in ("z", "y", "x")]
    alone = F.max("z") == F.min("z")
    if variant == "round":
        part = lambda p: div(F.sum(F.when(F.col("z") % 2 == p, v).otherwise(0)) + 2, 4)
        value = F.when(alone, part(0)).otherwise(div(part(0) + part(1) + 1, 2))
    else:
        places = [F.sum(F.when((F.col("y") % 2 == a) & (F.col("x") % 2 == b), v).otherwise(0)) for a in (0, 1) for b in (0, 1)]
        total = lambda n: sum((div(p, n) for p in places[1:]), div(places[0], n))
        value = div(F.when(alone, total(1)).otherwise(total(2)), 4)
    return whole.groupBy(*[F.col(c) for c in by], *key).agg(value.cast("int").alias("v")).select(*by, "z", "y", "x", "v")


def pyramid(vox: DataFrame, width: int, height: int, depth: int, levels: int, variant: str = "round", odd: str = "keep", by: tuple[str, ...] = ()) -> DataFrame:
    """Levels 1 to ``levels`` with a level column, each from the one before."""
    out = None
    for level in range(1, levels + 1):
        vox = halve(vox, width, height, depth, variant, odd, by)
        width, height, depth = width // 2, height // 2, depth // 2 + (depth % 2 if odd == "keep" else 0)
        rows = vox.withColumn("level", F.lit(level))
        out = rows if out is None else out.unionByName(rows)
    return out


def subsample(vox: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th row and column, from the first."""
    rest = [k for k in vox.columns if k not in ("y", "x")]
    return vox.filter((F.col("y") % factor == 0) & (F.col("x") % factor == 0)).select(*rest, div(F.col("y"), factor).cast("int").alias("y"), div(F.col("x"), factor).cast("int").alias("x"))


def block_mean(vox: DataFrame, width: int, height: int, factor: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Truncated means of whole blocks; what is left at the ends is dropped."""
    whole = vox.filter((F.col("x") < width // factor * factor) & (F.col("y") < height // factor * factor))
    return whole.groupBy(*by, "z", div(F.col("y"), factor).alias("y"), div(F.col("x"), factor).alias("x")).agg(div(F.sum(F.col("v").cast("bigint")), factor * factor).cast("int").alias("v"))


def is_valid(vox: DataFrame) -> DataFrame:
    """One row, valid: there are voxels, all have coordinates and a value, and they fill their box once each."""
    sides = [F.max(c).cast("bigint") - F.min(c) + 1 for c in ("z", "y", "x")]
    whole = F.count(F.when(F.expr("z is not null and y is not null and x is not null and v is not null"), 1))
    full = (F.count("*") == sides[0] * sides[1] * sides[2]) & (whole == F.count("*"))
    # A voxel that is there twice is caught at its place; both sides are one row.
    twice = vox.groupBy("z", "y", "x").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("twice"))
    found = vox.agg(F.coalesce(full & (F.count("*") > 0), F.lit(False)).alias("full"))
    return found.join(F.broadcast(twice), F.lit(True)).select((F.col("full") & ~F.col("twice")).alias("valid"))


def snapped(rows: DataFrame, value: str, points: DataFrame, tolerance: int) -> DataFrame:
    """``rows`` with each integer ``value`` at the nearest of ``points`` (column p) within ``tolerance``, the lesser on ties.

    Values too far from all points, and nulls, stay. Values and points meet in buckets as wide as the
    tolerance, each distinct value once, so nothing is crossed.
    """
    wide = max(int(tolerance), 1)
    bucket = lambda c: F.floor(F.col(c) / wide)
    marks = points.select(F.col("p").cast("bigint").alias("__p")).filter("__p is not null").distinct().withColumn("__b", bucket("__p"))
    values = rows.select(F.col(value).cast("bigint").alias("__v")).filter("__v is not null").distinct()
    values = values.withColumn("__b", F.explode(F.array(*[bucket("__v") + d for d in (-1, 0, 1)])))
    near = F.abs(F.col("__p") - F.col("__v"))
    found = values.join(marks, "__b").filter(near <= tolerance).groupBy("__v").agg(F.min(F.struct(near.alias("d"), F.col("__p").alias("p"))).alias("__near"))
    met = rows.join(found, F.col(value) == F.col("__v"), "left")
    return met.withColumn(value, F.coalesce("__near.p", value)).drop("__v", "__near")


def statistics(vox: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """min, max, mean, population standard deviation, shape."""
    size = lambda c: (F.max(c) - F.min(c) + 1).cast("bigint")
    aggs = [F.min("v").cast("bigint").alias("v_min"), F.max("v").cast("bigint").alias("v_max"), F.avg("v").alias("v_mean"), F.stddev_pop("v").alias("v_std"), F.count("*").alias("n")]
    return vox.groupBy(*by).agg(*aggs, size("z").alias("depth"), size("y").alias("height"), size("x").alias("width"))


def histogram(vox: DataFrame, type_max: int = 255) -> DataFrame:
    """bin and cnt of all 256 bins, integers scaled by their type's range."""
    counts = vox.groupBy(histogram_scale(F.col("v"), type_max).cast("bigint").alias("bin")).agg(F.count("*").alias("cnt"))
    bins = vox.sparkSession.range(BINS).select(F.col("id").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def float_histogram(vox: DataFrame) -> DataFrame:
    """bin and cnt of a floating volume, by its own range; all 0 for a constant one."""
    ends = vox.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # One row.
    rows = vox.join(F.broadcast(ends), F.col("hi") > F.col("lo"))
    scaled = rows.select(F.floor((F.col("v") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo"))).alias("v"))
    return histogram(scaled)


def otsu(hist: DataFrame) -> DataFrame:
    """threshold and separability of a 256-bin histogram; no row where nothing splits.

    The bins are at most 256 rows, whatever the volume. Ties within 1e-8 + 1e-9 of the best go to
    their middle one.
    """
    w = Window.orderBy("bin")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c, b = F.col("cnt").cast("double"), F.col("bin").cast("double")
    rows = hist.select("bin", c.alias("c"), F.sum(c).over(w).alias("wb"), F.sum(b * c).over(w).alias("sb"), F.sum(c).over(whole).alias("total"), F.sum(b * c).over(whole).alias("st"))
    # An empty histogram has no mean.
    rows = rows.filter("total > 0").withColumn("tv", F.sum(F.col("c") * F.pow(F.col("bin") - F.col("st") / F.col("total"), F.lit(2))).over(whole) * F.col("total"))
    rows = rows.filter("wb > 0 and total - wb > 0")
    between = F.col("wb") * (F.col("total") - F.col("wb")) * F.pow(F.col("sb") / F.col("wb") - (F.col("st") - F.col("sb")) / (F.col("total") - F.col("wb")), F.lit(2))
    rows = rows.withColumn("bv", between)
    rows = rows.withColumn("best", F.max("bv").over(whole)).filter(F.abs(F.col("bv") - F.col("best")) <= 1e-8 + 1e-9 * F.abs("best"))
    rows = rows.withColumn("place", F.row_number().over(w) - 1).withColumn("ties", F.count("*").over(whole))
    chosen = rows.filter(F.col("place") == div(F.col("ties"), 2))
    return chosen.select(F.col("bin").alias("threshold"), F.when(F.col("tv") > 0, F.col("bv") / F.col("tv")).otherwise(F.lit(0.0)).alias("separability"))


def foreground(vox: DataFrame, threshold: DataFrame, type_max: int = 255) -> DataFrame:
    """``vox`` with fg (1 above the threshold); ``threshold`` has one row at most."""
    cut = threshold.select("threshold", "separability", threshold_on_type(F.col("threshold"), type_max).alias("cut"))
    # One row.
    return vox.join(F.broadcast(cut), F.col("cut").isNotNull()).withColumn("fg", (F.col("v") > F.col("cut")).cast("bigint"))


def marginals(vox: DataFrame, value: Column) -> DataFrame:
    """axis (z, y, x), position and the sum of ``value`` there, by one pass over grouping sets."""
    rows = vox.select("z", "y", "x", value.alias("value"))
    sets = rows.groupingSets([["z"], ["y"], ["x"]], "z", "y", "x").agg(F.sum("value").alias("cnt"), F.count("*").alias("n"), F.grouping_id().alias("g"))
    axis = F.when(F.col("g") == 3, "z").when(F.col("g") == 5, "y").otherwise("x")
    return sets.select(axis.alias("axis"), F.coalesce("z", "y", "x").cast("bigint").alias("position"), "cnt", "n")


def occupied_spans(counts: DataFrame, margin: float = 0.05) -> DataFrame:
    """axis, low, high: occupied part of each axis as padded fractions.

    A position counts where its sum reaches a thousandth of its cross-section, and one voxel at least.
    """
    length = F.max("position").over(Window.partitionBy("axis")) + 1
    rows = counts.withColumn("length", length)
    rows = rows.filter(F.col("cnt") >= F.greatest(F.lit(1), F.floor(F.col("n") * OCCUPANCY)))
    span = rows.groupBy("axis").agg(F.min("position").alias("lo"), (F.max("position") + 1).alias("hi"), F.max("length").alias("length"))
    pad = (F.col("hi") - F.col("lo")) * margin
    return span.select("axis", F.greatest(F.lit(0.0), (F.col("lo") - pad) / F.col("length")).alias("low"), F.least(F.lit(1.0), (F.col("hi") + pad) / F.col("length")).alias("high"))


def joint_histogram(vox: DataFrame, type_max: int = 255) -> DataFrame:
    """axis (z, y, x), position, bin, above, cnt: the volume's histogram at each position of each axis.

    ``above`` tells values over the threshold that their own bin stands for, so that any threshold can be
    applied to the counts. Counts of parts add up, so one volume's tables merge; their size is that of the
    sides by 512 at most. Everything that the automatic set-up needs follows from it.
    """
    scaled = histogram_scale(F.col("v"), type_max).cast("bigint")
    rows = vox.select("z", "y", "x", scaled.alias("bin"), (F.col("v") > threshold_on_type(scaled, type_max)).alias("above"))
    sets = rows.groupingSets([["z", "bin", "above"], ["y", "bin", "above"], ["x", "bin", "above"]], "z", "y", "x", "bin", "above").agg(F.count("*").alias("cnt"), F.grouping_id().alias("g"))
    # The bits of the id are z, y, x, bin, above from the highest.
    axis = F.when(F.col("g") == 12, "z").when(F.col("g") == 20, "y").otherwise("x")
    return sets.select(axis.alias("axis"), F.when(F.col("g") == 12, F.col("z")).when(F.col("g") == 20, F.col("y")).otherwise(F.col("x")).cast("bigint").alias("position"), "bin", "above", "cnt")


def merged(*joints: DataFrame) -> DataFrame:
    """One joint histogram of volumes whose positions are those of one whole volume."""
    rows = joints[0]
    for other in joints[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("axis", "position", "bin", "above").agg(F.sum("cnt").alias("cnt"))


def histogram_of(joint: DataFrame) -> DataFrame:
    """bin and cnt of all 256 bins, from a joint histogram."""
    own = F.sum(F.when(F.col("axis") == "z", F.col("cnt")).otherwise(0))
    # No filter gets below the aggregate this way, so all that is derived from one histogram shares its shuffle.
    counts = joint.groupBy(F.coalesce("bin", F.lit(-1)).alias("bin")).agg(own.alias("cnt"))
    bins = joint.sparkSession.range(BINS).select(F.col("id").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))


def marginals_of(joint: DataFrame, threshold: DataFrame) -> DataFrame:
    """axis, position, cnt (voxels above the one row of ``threshold``) and n (voxels) there; no rows without a threshold."""
    # One row.
    rows = joint.join(F.broadcast(threshold.select("threshold")), F.col("threshold").isNotNull())
    over = (F.col("bin") > F.col("threshold")) | ((F.col("bin") == F.col("threshold")) & F.col("above"))
    return rows.groupBy("axis", "position").agg(F.sum(F.when(over, F.col("cnt")).otherwise(0)).alias("cnt"), F.sum("cnt").alias("n"))


def auto_setup(vox: DataFrame, margin: float = 0.05, type_max: int = 255) -> DataFrame:
    """One row with threshold, separability, foreground and the spans of x, y, z; none without a proposal.

    No proposal: nothing splits, the split explains too little, the foreground is too small or too
    large, or the spans cover everything. The volume is read once, for its joint histogram.
    """
    return setup_of(joint_histogram(vox, type_max), margin)


def setup_of(joint: DataFrame, margin: float = 0.05) -> DataFrame:
    """``auto_setup`` from a joint histogram."""
    split = otsu(histogram_of(joint)).filter(F.col("separability") >= MIN_SEPARABILITY)
    counts = marginals_of(joint, split)
    spans = occupied_spans(counts, margin)
    at = lambda a, c: F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{a}_{c}")
    wide = spans.groupBy().agg(*[at(a, c) for a in ("x", "y", "z") for c in ("low", "high")], F.count("*").alias("axes")).filter("axes = 3")
    own = lambda c: F.sum(F.when(F.col("axis") == "z", F.col(c)))
    total = counts.agg((own("cnt") / own("n")).alias("foreground"))
    # One row on each side.
    rows = wide.join(F.broadcast(total), F.col("foreground").between(MIN_FOREGROUND, MAX_FOREGROUND)).join(F.broadcast(split), F.lit(True))
    cover = (F.col("x_high") - F.col("x_low")) * (F.col("y_high") - F.col("y_low"))
    rows = rows.filter(~((cover >= TRIVIAL_COVERAGE) & (F.col("z_high") - F.col("z_low") >= TRIVIAL_COVERAGE)))
    return rows.select("threshold", "separability", "foreground", "x_low", "y_low", "x_high", "y_high", "z_low", "z_high")
