"""The pyramid in slice form: whole images as rows, halved by vectorised kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div

SCHEMA = "stack_id string, level int, z int, width int, height int, bit_depth int, pixels binary"


def reduce_square(a: np.ndarray, variant: str = "round") -> np.ndarray:
    """2 by 2 means of an image, halves up or floored; odd ends dropped."""
    h, w = a.shape[0] // 2 * 2, a.shape[1] // 2 * 2
    b = a[:h, :w].astype(np.uint32)
    total = b[::2, ::2] + b[1::2, ::2] + b[::2, 1::2] + b[1::2, 1::2]
    return ((total + (2 if variant == "round" else 0)) >> 2).astype(a.dtype)


#: Bits of a filter's whole-number weights, and the slope of its cubic at the first neighbours.
FILTER_BITS, CUBIC = 22, -0.5


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel: 1 at 0, 0 at the other whole numbers, of support 2."""
    x = np.abs(x)
    near = ((CUBIC + 2) * x - (CUBIC + 3)) * x * x + 1
    far = CUBIC * (((x - 5) * x + 8) * x - 4)
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def filter_weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``m`` places from ``n``: the first source place, and the weights from there in 2^-22.

    The kernel is stretched by the scale, so that it averages where the image shrinks; weights are
    normalised, rounded halves away from 0, and 0 beyond the ends.
    """
    scale = n / m
    stretch = max(1.0, scale)
    middle = (np.arange(m) + 0.5) * scale
    low = np.maximum(np.floor(middle - 2 * stretch + 0.5), 0).astype(int)
    high = np.minimum(np.floor(middle + 2 * stretch + 0.5), n).astype(int)
    at = low[:, None] + np.arange((high - low).max())
    w = np.where(at < high[:, None], _cubic((at - middle[:, None] + 0.5) / stretch), 0.0)
    w = w / w.sum(1, keepdims=True) * (1 << FILTER_BITS)
    return low, (np.sign(w) * np.floor(np.abs(w) + 0.5)).astype(np.int64)


def resize_filtered(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """An 8-bit image resized by ``filter_weights``: rows first, then columns, each pass rounded and clipped to 8 bits."""
    for m in (width, height):
        low, w = filter_weights(a.shape[1], m)
        at = np.minimum(low[:, None] + np.arange(w.shape[1]), a.shape[1] - 1)
        total = sum(a[:, at[:, k]].astype(np.int64) * w[:, k] for k in range(w.shape[1]))
        # The passes turn the image, so that each works along its rows.
        a = np.clip((total + (1 << FILTER_BITS - 1)) >> FILTER_BITS, 0, 255).astype(np.uint8).T
    return a


def halve_pair(a: np.ndarray, b: np.ndarray | None, variant: str = "round") -> np.ndarray:
    """One slice of the next level from two slices, or from a last one alone.

    ``round`` and ``floor`` are means of 2 by 2; ``filter`` halves 8-bit images by a resampling filter,
    and 16-bit ones as ``floor`` does.
    """
    if variant == "filter" and a.dtype == np.uint8 and min(a.shape) > 1:
        mean = a if b is None else ((a.astype(np.uint16) + b) >> 1).astype(np.uint8)
        return resize_filtered(mean, a.shape[0] // 2, a.shape[1] // 2)
    if b is None:
        return reduce_square(a, variant)
    if variant == "round":
        p, q = reduce_square(a).astype(np.uint32), reduce_square(b).astype(np.uint32)
        return ((p + q + 1) >> 1).astype(a.dtype)
    return reduce_square(((a.astype(np.uint32) + b) >> 1).astype(a.dtype), "floor")


def _image(r) -> np.ndarray:
    return np.frombuffer(r.pixels, f"<u{int(r.bit_depth) // 8}").reshape(int(r.height), int(r.width))


def _wide(a: np.ndarray, depth: int) -> np.ndarray:
    return a.astype(np.uint16) << 8 if depth == 16 and a.dtype.itemsize == 1 else a


def _widened(rows: list) -> list[np.ndarray]:
    """Images of one group in a common depth: 16 bits if any has them."""
    depth = max(int(r.bit_depth) for r in rows)
    return [_wide(_image(r), depth) for r in rows]


def _row(stack: str, level: int, z: int, a: np.ndarray) -> tuple:
    return stack, level, z, a.shape[1], a.shape[0], a.dtype.itemsize * 8, a.astype(a.dtype.newbyteorder("<")).tobytes()


#: Bytes of made images that are handed on at once.
OUT_BYTES = 8 << 20


def _by_group(rows: DataFrame, order: list[str], run: Callable[[list], Iterator[tuple]]) -> DataFrame:
    """``run`` over the rows of each (stack_id, __group), sorted by ``order``: rows of ``SCHEMA``.

    Groups lie in order within their tasks and are read one after the other, so a task holds a group and
    a batch, and small groups share the cost of a batch. The number of tasks is given: small images are
    few bytes and much work, so their tasks aren't to be merged by size.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, made, size = None, [], [], 0
        for batch in batches:
            for r in batch.itertuples(index=False, name="Row"):
                if (r.stack_id, r.group_of) != key:
                    for row in run(group) if group else ():
                        made.append(row)
                        size += len(row[-1])
                    key, group = (r.stack_id, r.group_of), []
                    if size >= OUT_BYTES:
                        yield pd.DataFrame(made, columns=names)
                        made, size = [], 0
                group.append(r)
        made += run(group) if group else ()
        if made:
            yield pd.DataFrame(made, columns=names)

    rows = rows.withColumnRenamed("__group", "group_of")
    return rows.repartition(tasks, "stack_id", "group_of").sortWithinPartitions("stack_id", "group_of", *order).mapInPandas(each, SCHEMA)


def pyramid(slices: DataFrame, levels: int, variant: str = "round", odd: str = "keep", group_levels: int = 3) -> DataFrame:
    """Levels 1 to ``levels`` of slices at level 0, as slices.

    A task gets the 2^k slices (k at most ``group_levels``) that make one slice k levels up, and
    emits all levels between, so nothing is shuffled between those; higher levels go on from there.
    One group of images is what a task holds.
    """
    out, base, done = None, slices, 0
    while done < levels:
        k = min(group_levels, levels - done)
        made = _fused(base, k, variant, odd)
        out = made if out is None else out.unionByName(made)
        base, done = made.filter(F.col("level") == done + k), done + k
    return out


def _fused(slices: DataFrame, k: int, variant: str, odd: str) -> DataFrame:
    if variant not in ("round", "floor", "filter"):
        raise ValueError(f"unknown variant: {variant}")

    def run(rows: list) -> Iterator[tuple]:
        stack, level = rows[0].stack_id, int(rows[0].level)
        images = dict(zip((int(r.z) for r in rows), _widened(rows), strict=True))
        for step in range(1, k + 1):
            following = {}
            for z in sorted({z // 2 for z in images}):
                a, b = images.get(2 * z), images.get(2 * z + 1)
                if a is None or (b is None and odd == "drop"):
                    continue
                following[z] = halve_pair(a, b, variant)
            images = following
            yield from (_row(stack, level + step, z, a) for z, a in images.items())

    rows = slices.filter("pixels is not null").select("stack_id", "level", "z", "width", "height", "bit_depth", "pixels")
    return _by_group(rows.withColumn("__group", div(F.col("z"), 1 << k)), ["z"], run)


def build(slices: DataFrame, path: str, levels: int, *, variant: str = "round", odd: str = "keep", group_levels: int = 3, report: Callable[[int, int], bool | None] | None = None) -> DataFrame:
    """Levels 1 to ``levels``, written below ``path`` group by group and read back.

    A group of levels is made from the written last level of the one before, so no level is computed
    twice. Groups whose commit marker exists are left as they are, so a second call goes on where the
    first ended; delete the folder when the slices or options change. ``report`` gets the levels done
    and in all after each group; when it returns False the work ends there. No level: no row.
    """
    spark = slices.sparkSession
    base, parts, done = slices, [], 0
    while done < levels:
        k = min(group_levels, levels - done)
        part = f"{path}/levels_{done + 1}_{done + k}"
        marker = spark._jvm.org.apache.hadoop.fs.Path(f"{part}/_SUCCESS")
        if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            _fused(base, k, variant, odd).write.mode("overwrite").parquet(part)
        parts.append(part)
        done += k
        base = spark.read.schema(SCHEMA).parquet(part).filter(F.col("level") == done)
        if report is not None and report(done, levels) is False:
            break
    return spark.read.schema(SCHEMA).parquet(*parts) if parts else slices.limit(0).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def wanted_levels(slices: DataFrame, levels: int, odd: str = "keep") -> DataFrame:
    """stack_id, level, z of every image of levels 1 to ``levels``; only names of ``slices`` are read."""
    names, out = slices.select("stack_id", F.col("z").cast("int").alias("z")), None
    for level in range(1, levels + 1):
        up = names.groupBy("stack_id", div(F.col("z"), 2).cast("int").alias("z")).agg(F.count("*").alias("n"), F.min("z").alias("first"))
        # An image needs its even slice; without its odd one it is a last slice.
        names = up.filter((F.col("first") % 2 == 0) & ((F.col("n") > 1) | F.lit(odd == "keep"))).select("stack_id", "z")
        rows = names.select("stack_id", F.lit(level).alias("level"), "z")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else slices.limit(0).select("stack_id", F.lit(0).alias("level"), "z")


def closure(slices: DataFrame, existing: DataFrame, levels: int, odd: str = "keep") -> DataFrame:
    """What a resumed pyramid has to do: stack_id, level, z and make (else read) of images, each once.

    Made are the wanted images that ``existing`` (stack_id, level, z) lacks; read are the inputs of
    those that are there, of level 0 or written before. Everything else is left alone.
    """
    key = ["stack_id", "level", "z"]
    todo = wanted_levels(slices, levels, odd).join(existing.select(*key), key, "left_anti")
    inputs = todo.select("stack_id", (F.col("level") - 1).alias("level"), F.explode(F.array(2 * F.col("z"), 2 * F.col("z") + 1)).alias("z"))
    there = slices.select("stack_id", F.lit(0).alias("level"), "z").unionByName(existing.filter("level > 0").select(*key)).distinct()
    read = there.join(inputs, key, "left_semi")
    return todo.select(*key, F.lit(True).alias("make")).unionByName(read.select(*key, F.lit(False).alias("make")))


#: Levels that a resumed pyramid makes in one pass over its groups of slices.
GROUP_LEVELS = 3


def _missing_at_once(source: DataFrame, existing: DataFrame, levels: int, variant: str, odd: str) -> DataFrame:
    """``missing_levels`` of few levels: names and images of a group of slices meet in one task, so that each input is read once."""
    names = source.columns
    have = existing.filter(F.col("level").between(1, levels))
    pixels = {"width": "int", "height": "int", "bit_depth": "int", "pixels": "binary"}
    if "stack_id" not in have.columns:
        have = have.join(source.select("stack_id").distinct(), F.lit(True))
    if "pixels" not in have.columns:
        have = have.select("stack_id", "level", "z", *[F.lit(None).cast(t).alias(c) for c, t in pixels.items()])
    rows = source.withColumn("level", F.lit(0)).unionByName(have.select(*names))
    group = F.expr(f"shiftright(z, {levels} - level)").cast("long")

    def run(rows: list) -> Iterator[tuple]:
        stack = rows[0].stack_id
        there: list[dict[int, object]] = [{} for _ in range(levels + 1)]
        for r in rows:
            if r.pixels is not None or int(r.z) not in there[int(r.level)]:
                there[int(r.level)][int(r.z)] = r
        full = [{z: r for z, r in found.items() if r.pixels is not None} for found in there]
        # An image needs its even slice; without its odd one it is a last slice.
        wanted = [set(there[0])]
        for _ in range(levels):
            below = wanted[-1]
            wanted.append({z // 2 for z in below if z % 2 == 0 and (odd == "keep" or z + 1 in below)})
        asked = [wanted[k] - there[k].keys() for k in range(levels + 1)]
        # From the top down: what is asked for, or needed by what has to be made.
        make, need = [set() for _ in range(levels + 1)], set()
        for k in range(levels, 0, -1):
            make[k] = asked[k] | ((need & wanted[k]) - full[k].keys())
            need = {2 * z + i for z in make[k] for i in (0, 1)}
        made: dict[int, np.ndarray] = {}
        for k in range(1, levels + 1):
            following = {}
            for z in sorted(make[k]):
                pair = [made[i] if i in made else _image(full[k - 1][i]) if i in full[k - 1] else None for i in (2 * z, 2 * z + 1)]
                if pair[0] is None or (pair[1] is None and odd == "drop"):
                    continue
                depth = 8 * max(a.dtype.itemsize for a in pair if a is not None)
                following[z] = halve_pair(*[None if a is None else _wide(a, depth) for a in pair], variant)
                if z in asked[k]:
                    yield _row(stack, k, z, following[z])
            made = following

    if variant not in ("round", "floor", "filter"):
        raise ValueError(f"unknown variant: {variant}")
    return _by_group(rows.withColumn("__group", group), ["level", "z"], run)


def missing_levels(slices: DataFrame, existing: DataFrame, levels: int, variant: str = "round", odd: str = "keep") -> DataFrame:
    """The images of levels 1 to ``levels`` that ``existing`` lacks.

    ``existing`` has the columns of ``SCHEMA`` or only stack_id, level, z. Up to ``GROUP_LEVELS`` levels are made
    in one pass, by groups of slices; more of them level by level. Going up, only
    the images that are missing are made, each from its two inputs: those of the level below that are
    there with pixels are read, by a semi-join, and those that were missing too have just been made. An
    input that exists without pixels is made again from what it needs.
    """
    key = ["stack_id", "level", "z"]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    source = slices.select(*names)
    if 0 < levels <= GROUP_LEVELS:
        return _missing_at_once(source, existing, levels, variant, odd)
    have = existing
    if "stack_id" not in have.columns:
        have = have.join(source.select("stack_id").distinct(), F.lit(True))
    full = have.select(*names).filter("pixels is not null") if "pixels" in have.columns else source.limit(0)
    wanted = wanted_levels(source, levels, odd)
    # From the top down: what is asked for, or needed by what has to be made.
    make = {levels + 1: None}
    asked = wanted.join(have.select(*key), key, "left_anti")
    for level in range(levels, 0, -1):
        need = asked.filter(F.col("level") == level).select("stack_id", "z")
        if make[level + 1] is not None:
            below = make[level + 1].select("stack_id", F.explode(F.array(2 * F.col("z"), 2 * F.col("z") + 1)).alias("z"))
            below = below.join(wanted.filter(F.col("level") == level), ["stack_id", "z"], "left_semi")
            need = need.unionByName(below.join(full.filter(F.col("level") == level).select("stack_id", "z"), ["stack_id", "z"], "left_anti")).distinct()
        make[level] = need
    out, made = None, source.limit(0)
    for level in range(1, levels + 1):
        inputs = make[level].select("stack_id", F.explode(F.array(2 * F.col("z"), 2 * F.col("z") + 1)).alias("z"))
        base = source if level == 1 else full.filter(F.col("level") == level - 1)
        made = _fused(base.join(inputs, ["stack_id", "z"], "left_semi").unionByName(made.join(inputs, ["stack_id", "z"], "left_semi")), 1, variant, odd)
        rows = made.join(asked, key, "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else source.limit(0)


def resume(slices: DataFrame, path: str, levels: int, *, variant: str = "round", odd: str = "keep") -> DataFrame:
    """Complete the pyramid below ``path`` (one folder a level), and read it back.

    A level is made after the one below it is whole, from the two inputs of each of its missing images
    alone: names are compared first, by an anti-join, and only the inputs' pixels are read, by a
    semi-join. What is there stays as it is, so nothing that was committed is computed again, and
    levels without a missing image cost a comparison of names. Delete the folder when the options change.
    """
    spark = slices.sparkSession
    key, names = ["stack_id", "level", "z"], [c.split()[0] for c in SCHEMA.split(", ")]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def written() -> DataFrame:
        if not system.exists(where):
            return slices.limit(0).select(*names)
        return spark.read.schema(SCHEMA).parquet(path).select(*names)

    wanted = wanted_levels(slices, levels, odd)
    for level in range(1, levels + 1):
        have = written()
        todo = wanted.filter(F.col("level") == level).join(have.select(*key), key, "left_anti")
        base = slices.select(*names) if level == 1 else have.filter(F.col("level") == level - 1)
        inputs = todo.select("stack_id", F.explode(F.array(2 * F.col("z"), 2 * F.col("z") + 1)).alias("z"))
        made = _fused(base.join(inputs, ["stack_id", "z"], "left_semi").select(*names), 1, variant, odd)
        if not todo.isEmpty():
            made.write.mode("append").partitionBy("level").parquet(path)
    return written().filter(F.col("level").between(1, levels))


def display_slices(slices: DataFrame) -> DataFrame:
    """Slices for display: 16-bit pixels lose their low byte."""

    @F.pandas_udf("binary")
    def high(pixels: pd.Series, depth: pd.Series) -> pd.Series:
        make = lambda p, d: None if p is None else p if d == 8 else (np.frombuffer(p, "<u2") >> 8).astype(np.uint8).tobytes()
        return pd.Series([make(p, d) for p, d in zip(pixels, depth, strict=True)], dtype=object)

    return slices.withColumn("pixels", high("pixels", "bit_depth")).withColumn("bit_depth", F.lit(8))
