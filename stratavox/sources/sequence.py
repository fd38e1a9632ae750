"""Stacks as directories of numbered files: listing, sequence detection, expected files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import name_parts, sequence_name
from .safety import EXTENSIONS, UnsafePathError, has_image_extension


class NoImagesError(ValueError):
    """A folder without images, or without a sequence of them."""


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, name, length of the files in a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def parsed(files: DataFrame) -> DataFrame:
    """``files`` (name, ...) that have the form of a sequence, with prefix, digits, number, ext."""
    return files.withColumns(name_parts(F.col("name"))).filter("number is not null")


def mode_of(rows: DataFrame, column: str) -> DataFrame:
    """The most frequent value; among equals the one whose first name comes first."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"), F.min("name").alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select(column)


def detect(files: DataFrame) -> DataFrame:
    """One row: prefix, file_type, index_length, seq_begin, seq_end, n_files; none if there is no sequence.

    Prefix and (supported) extension are chosen independently, so a folder may hold no file with
    both. The index length is that of the first file in numeric order.
    """
    rows = parsed(files)
    prefix = mode_of(rows, "prefix")
    ext = mode_of(rows.filter(F.col("ext").isin(*EXTENSIONS)), "ext")
    # One row each.
    chosen = rows.join(F.broadcast(prefix), "prefix").join(F.broadcast(ext), "ext")
    first = F.min(F.struct("number", "name", F.length("digits").alias("width")))
    out = chosen.groupBy("prefix", "ext").agg(first.alias("first"), F.max("number").alias("seq_end"), F.count("*").alias("n_files"))
    return out.select("prefix", F.col("ext").alias("file_type"), F.col("first.width").alias("index_length"), F.col("first.number").alias("seq_begin"), "seq_end", "n_files")


def expected(sequence: DataFrame) -> DataFrame:
    """name and index of every file that a sequence row stands for."""
    rows = sequence.withColumn("index", F.explode(F.sequence("seq_begin", "seq_end")))
    return rows.select("index", sequence_name(F.col("prefix"), F.col("index"), F.col("index_length"), F.col("file_type")).alias("name"))


#: Numbers of a block in which neighbours are found, and names that one row of a run expands to at most.
RUN_BLOCK = 1 << 16


def _block(name: str) -> Column:
    """The block of a number, in whole numbers, so that large ones stay exact."""
    number = F.col(name)
    return F.call_function("div", number - F.pmod(number, F.lit(RUN_BLOCK)), F.lit(RUN_BLOCK))


def numbered(sequence: DataFrame, files: DataFrame, fixed: bool = False) -> DataFrame:
    """lo and hi of the runs of numbers that each of ``files`` names, each once, with the columns of the sequence row.

    A file counts if its name is the expected one for its number; extensions compare without case. It
    names that number alone, unless names have a ``fixed`` width: then numbers that are wider by k digits
    share the name of their first digits, so a name of w digits that begins with no zero also stands for
    10^k numbers at every k. No two runs have a number in common.
    """
    rows = parsed(files).select(F.col("prefix").alias("__prefix"), F.col("ext").alias("__ext"), "digits", "number")
    # A row for each stack.
    met = rows.join(F.broadcast(sequence), (F.col("__prefix") == F.col("prefix")) & (F.col("__ext") == F.lower("file_type")))
    begin, end, number = F.col("seq_begin"), F.col("seq_end"), F.col("number")
    named = sequence_name(F.lit(""), number, F.col("index_length"), F.lit(""), fixed)
    met = met.filter(F.concat("digits", F.lit(".")) == named)
    if not fixed:
        met = met.filter(number.between(begin, end)).withColumns({"lo": number, "hi": number})
        return met.select(*sequence.columns, "lo", "hi").distinct()
    wider = F.greatest(F.length(end.cast("string")) - F.col("index_length"), F.lit(0))
    met = met.filter(F.length(number.cast("string")) <= F.col("index_length")).select(*sequence.columns, "number").distinct()
    met = met.withColumn("__power", F.explode(F.sequence(F.lit(0), F.when(F.length(number.cast("string")) == F.col("index_length"), wider).otherwise(0))))
    scale = F.pow(F.lit(10.0), F.col("__power")).cast("bigint")
    # What is beyond 64 bits is beyond the end.
    low = F.try_multiply(number, scale)
    met = met.withColumns({"lo": F.greatest(low, begin), "hi": F.least(F.try_add(low, scale - 1), end)})
    return met.filter(low.isNotNull() & (F.col("lo") <= F.col("hi"))).select(*sequence.columns, "lo", "hi")


def missing_runs(sequence: DataFrame, files: DataFrame, fixed: bool = False) -> DataFrame:
    """first, last and the sequence's columns of each maximal run of expected files that do not exist.

    The gaps between neighbouring runs of ``numbered``. Neighbours meet in blocks of ``RUN_BLOCK`` numbers, and
    the ends of the blocks once more among themselves, so no task sorts a whole stack; no number that
    is missing is ever made a row.
    """
    columns = sequence.columns
    begin, end = (F.col(c) for c in ("seq_begin", "seq_end"))
    have = numbered(sequence, files, fixed).withColumn("__block", _block("lo"))
    inside = have.withColumn("__after", F.lead("lo").over(Window.partitionBy(*columns, "__block").orderBy("lo")))
    inside = inside.filter("__after > hi + 1").select(*columns, (F.col("hi") + 1).alias("first"), (F.col("__after") - 1).alias("last"))
    # Before the first number, after the last one and between blocks; a stack without a file is one run.
    ends = have.groupBy(*columns, "__block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    edges = ends.select(*columns, "lo", "hi").unionByName(sequence.select(*columns, (begin - 1).alias("lo"), (begin - 1).alias("hi"))).unionByName(sequence.select(*columns, (end + 1).alias("lo"), (end + 1).alias("hi")))
    edges = edges.withColumn("__next", F.lead("lo").over(Window.partitionBy(*columns).orderBy("lo", "hi")))
    between = edges.filter("__next > hi + 1").select(*columns, (F.col("hi") + 1).alias("first"), (F.col("__next") - 1).alias("last"))
    return inside.unionByName(between)


def _expanded(runs: DataFrame, first: str, last: str, fixed: bool) -> DataFrame:
    """index and name of every number of runs, expanded in pieces."""
    piece = F.explode(F.sequence(_block(first), _block(last)))
    rows = runs.withColumn("__piece", piece)
    start = F.col("__piece") * RUN_BLOCK
    low, high = F.greatest(F.col(first), start), F.least(F.col(last), start + (RUN_BLOCK - 1))
    rows = rows.withColumn("index", F.explode(F.sequence(low, high)))
    return rows.select("index", sequence_name(F.col("prefix"), F.col("index"), F.col("index_length"), F.col("file_type"), fixed).alias("name"))


def present(sequence: DataFrame, files: DataFrame, fixed: bool = False) -> DataFrame:
    """index and name of the expected files that exist; extensions compare without case."""
    return _expanded(numbered(sequence, files, fixed), "lo", "hi", fixed)


def missing(sequence: DataFrame, files: DataFrame, fixed: bool = False) -> DataFrame:
    """index and name of the expected files that do not exist: the missing runs, expanded in pieces."""
    return _expanded(missing_runs(sequence, files, fixed), "first", "last", fixed)


def ranked(files: DataFrame) -> DataFrame:
    """Sequence files with z, their place in numeric order within their stack (prefix)."""
    order = Window.partitionBy("prefix").orderBy("number", "name")
    return parsed(files).withColumn("z", F.row_number().over(order) - 1)


def natural_key(path):
    """Texts and numbers of a path in turn, each number padded so that it sorts by value."""
    tokens = F.regexp_extract_all(path, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), F.lpad(t, 20, "0")).otherwise(t))


#: Ranges into which a ranking deals its rows, and rows of the sample that sets their borders, for each of them.
RANK_RANGES, RANK_SAMPLE = 256, 20


def placed(rows: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``rows`` with their place (0, 1, ...) in the order of the columns ``order`` over the whole table.

    Borders come from a bounded sample by hash (``RANK_RANGES`` by ``RANK_SAMPLE`` rows); rows are counted
    by range, and a place is what the ranges before hold and the rank within the range. Rows that are
    equal in all of ``order`` take any of their places; add columns that tell them apart where that matters.
    """
    keyed = rows.withColumn("__key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    share = RANK_RANGES * RANK_SAMPLE / max(1, rows.count())
    picked = keyed.filter(F.pmod(F.xxhash64("__key"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).select("__key").distinct()
    # RANK_RANGES * RANK_SAMPLE rows or so; every RANK_SAMPLE-th is a border.
    many = picked.select(F.array_sort(F.collect_list("__key")).alias("all"))
    borders = many.select(F.expr(f"filter(all, (x, i) -> i % {RANK_SAMPLE} = {RANK_SAMPLE - 1})").alias("__borders"))
    keyed = keyed.join(F.broadcast(borders), F.lit(True))
    # Two looks at few borders instead of one at all of them.
    step = int(RANK_RANGES**0.5)
    under = lambda borders: F.size(F.filter(borders, lambda b: b <= F.col("__key")))
    keyed = keyed.withColumn("__far", under(F.filter("__borders", lambda b, i: i % step == step - 1)))
    keyed = keyed.withColumn("__range", F.col("__far") * step + under(F.slice("__borders", F.col("__far") * step + 1, step - 1)))
    counts = keyed.groupBy("__range").agg(F.count("*").alias("n"))
    # A row for each range.
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", before.alias("__start"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__key")) - 1
    found = keyed.withColumn("__own", own).join(F.broadcast(starts), "__range")
    return found.select(*rows.columns, (F.col("__start") + F.col("__own")).alias(name))


def open_directory(spark: SparkSession, path: str) -> DataFrame:
    """The sequence row of a folder that any of Spark's file systems can open.

    Raises ``UnsafePathError`` for a path that climbs or holds a null character, ``FileNotFoundError``,
    ``NotADirectoryError``, and ``NoImagesError`` where no sequence of images is found.
    """
    if not path.strip() or "\0" in path or ".." in path.split("/"):
        raise UnsafePathError(f"forbidden path: {path!r}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        raise FileNotFoundError(path)
    if not system.getFileStatus(where).isDirectory():
        raise NotADirectoryError(path)
    found = detect(list_files(spark, path))
    if found.isEmpty():
        raise NoImagesError(path)
    return found


def slices_in_order(files: DataFrame) -> DataFrame:
    """Files with an image extension in natural order of their paths; ``NoImagesError`` where there are none."""
    rows = files.filter(has_image_extension(F.col("name")))
    if rows.isEmpty():
        raise NoImagesError("no image files")
    return rows.orderBy(natural_key(F.col("path")), "path")


def image_files(files: DataFrame) -> DataFrame:
    """Files with an image extension, by name."""
    return files.filter(has_image_extension(F.col("name"))).orderBy("name")


def is_image_directory(files: DataFrame) -> bool:
    return not files.filter(has_image_extension(F.col("name"))).isEmpty()


def first_log(files: DataFrame) -> DataFrame:
    return files.filter(F.lower("name").endswith(".log")).orderBy("name").limit(1)


def count_files(files: DataFrame, suffix: str | None = None) -> int:
    return (files if suffix is None else files.filter(F.lower("name").endswith(suffix.lower()))).count()


def folder_summary(files: DataFrame) -> DataFrame:
    """One row: logs and the first of them, n (files), bytes, images (whether there is one), by one aggregate."""
    log = F.lower("name").endswith(".log")
    image = F.coalesce(F.bool_or(has_image_extension(F.col("name"))), F.lit(False))
    return files.agg(F.count_if(log).alias("logs"), F.min(F.when(log, F.col("name"))).alias("first"), F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), image.alias("images"))


def total_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def contiguous_levels(levels: DataFrame) -> DataFrame:
    """``levels`` (level, from 1) up to the first gap, 19 at most."""
    few = levels.filter(F.col("level").between(1, 19)).select("level").distinct()
    return few.withColumn("place", F.row_number().over(Window.orderBy("level"))).filter("level = place").select("level")


def level_catalog(slices: DataFrame) -> DataFrame:
    """name, width, height, seq_begin, seq_end of each (stack_id, level); width and height of its first slice."""
    first = F.min(F.struct("z", "width", "height"))
    rows = slices.groupBy("stack_id", "level").agg(first.alias("first"), F.min("z").alias("seq_begin"), F.max("z").alias("seq_end"))
    name = F.when(F.col("level") == 0, "Original").otherwise(F.concat(F.lit("Level "), F.col("level").cast("string")))
    return rows.select("stack_id", "level", name.alias("name"), F.col("first.width").alias("width"), F.col("first.height").alias("height"), "seq_begin", "seq_end")


def with_new_levels(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """``catalog`` and those rows of ``found`` whose (stack_id, name) it lacks, each name once, its least level."""
    first = F.row_number().over(Window.partitionBy("stack_id", "name").orderBy("level"))
    fresh = found.join(catalog.select("stack_id", "name"), ["stack_id", "name"], "left_anti").withColumn("__n", first).filter("__n = 1")
    return catalog.unionByName(fresh.select(*catalog.columns))


def pending(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Outputs (level, z) still to be made."""
    return wanted.join(existing.select("level", "z"), ["level", "z"], "left_anti")
