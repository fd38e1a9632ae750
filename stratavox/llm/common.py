"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of what is neither a space nor one of the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

_own_dir: str | None = None
Made = TypeVar("Made")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where the setting is absent in a
    single-JVM session, as in tests, a temporary folder stands in for it; a cluster without the
    setting is an error, as its executors could not read a local folder of the driver.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        global _own_dir
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="stratavox-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        base = f"file://{os.path.abspath(_own_dir)}"
    return f"{base}/{uuid.uuid4().hex}/{name}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting ``key`` is ``value`` for the actions inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of shared files, never a recomputation.
    The shuffle files of the write go when it is done, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_parts(part: Callable[[int], DataFrame], parts: int, name: str) -> DataFrame:
    """The rows of ``part(0)`` to ``part(parts - 1)``, each written on its own: only the shuffle of one is on disk at a time."""
    return reduce(DataFrame.unionByName, [materialise(part(k), f"{name}_{k}") for k in range(parts)])


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions inside: whole texts are large rows.

    JVM and Python worker hold a batch each, several times over while it is written and read.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    with setting(spark, key, str(min(rows, now) if now > 0 else rows)):
        yield


def giving_back(made: Iterator[Made]) -> Iterator[Made]:
    """The Arrow data that a task makes; after each, memory that is free again goes back to the system.

    Arrow's allocator would keep it, and workers stay, idle, through the steps that need it in the JVM.
    """
    pool = pa.default_memory_pool()
    for one in made:
        yield one
        del one
        pool.release_unused()
    pool.release_unused()


def remove(spark: SparkSession, table: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` gave and nothing needs any more."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, evaluated once: lambdas would evaluate a plain expression per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, BLANK), "")


def id_remainder(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus``; the folds are defined by it."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % modulus


def hash_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """``rows``, or where they are more than ``most``, about 95 % of ``most`` of them chosen by the hash of ``key``.

    A filter, so no task and not the driver sorts or gathers the rows; the same keys are chosen in
    every run.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(0.95 * most / n * (1 << 30)))


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest ``count``, ``most`` at most: those above a bound that a histogram gives.

    Counts fall in sixteen bins an octave, about a thousand in all, and only those come to the
    driver. Rows of the bin at the bound are left out together, so nothing depends on ties.
    """
    bin_ = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    total, bound = 0, None
    for b, n in sorted(rows.groupBy(bin_.alias("bin")).agg(F.count("*")).collect(), reverse=True):
        total += n
        if total > most:
            break
        bound = b
    return rows.filter(bin_ >= bound) if bound is not None else rows.limit(0)
