"""The stack sink's commit, folds with state, and the resampling filter."""

import os
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import pyramid, volume
from stratavox.sources import codec, stack_sink
from stratavox.streaming import folds, progress

START = datetime(2024, 1, 1)


def slices(spark, a, bits=8):
    return spark.createDataFrame([("s", 0, z, p.shape[1], p.shape[0], bits, p.astype(f"<u{bits // 8}").tobytes()) for z, p in enumerate(a)], pyramid.SCHEMA)


def files(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file())


# Sink


@pytest.mark.parametrize("bits", [8, 16])
def test_stack_is_written_whole(spark, tmp_path, bits):
    a = np.random.default_rng(1).integers(0, 1 << bits, (9, 6, 5))
    path = str(tmp_path / "stack")
    stack_sink.write_stack(slices(spark, a, bits).repartition(3), path, F.format_string("ct_%04d.tif", F.col("z")), deflate=True)
    assert files(path) == [f"ct_{z:04d}.tif" for z in range(9)]
    for z in range(9):
        assert np.array_equal(codec.decode((tmp_path / "stack" / f"ct_{z:04d}.tif").read_bytes()), a[z])


def test_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "stack")
    rows = slices(spark, np.zeros((8, 4, 4))).repartition(4).withColumn("pixels", F.when(F.col("z") != 5, F.col("pixels")))
    with pytest.raises(Exception, match="not an image"):
        stack_sink.write_stack(rows, path, F.format_string("%d.tif", F.col("z")))
    assert not os.path.exists(path) or files(path) == []
    with pytest.raises(Exception, match="one name"):
        stack_sink.write_stack(slices(spark, np.zeros((4, 4, 4))), path, F.lit("same.tif"))
    assert not os.path.exists(path) or files(path) == []


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    """A task that failed half way and was retried, and one that ran twice: only the attempts that count are moved."""
    path = str(tmp_path / "stack")
    writer = stack_sink.StackWriter(path, False, False)
    row = lambda i, ok=True: {"name": f"{i}.tif", "width": 2, "height": 2, "bit_depth": 8, "pixels": bytes(4) if ok else None}
    with pytest.raises(ValueError, match="not an image"):
        writer.write(iter([row(1), row(2, ok=False)]))
    counted, twice = writer.write(iter([row(1), row(2)])), writer.write(iter([row(1), row(2)]))
    assert counted.folder != twice.folder
    writer.commit([counted, None, writer.write(iter([]))])
    assert files(path) == ["1.tif", "2.tif"]
    other = stack_sink.StackWriter(path, False, False)
    other.write(iter([row(3)]))
    other.abort([None])
    assert files(path) == ["1.tif", "2.tif"]
    last = stack_sink.StackWriter(path, False, True)
    last.commit([last.write(iter([row(9)]))])
    assert files(path) == ["9.tif"]


def test_names_must_be_plain(spark, tmp_path):
    with pytest.raises(Exception, match="plain name"):
        stack_sink.write_stack(slices(spark, np.zeros((1, 2, 2))), str(tmp_path / "s"), F.lit("../x.tif"))
    with pytest.raises(ValueError, match="missing"):
        stack_sink.StackSource({"path": "x"}).writer(spark.range(1).schema, False)


# Folds


def log(spark, runs, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for run, n in runs.items():
        t = START
        for i in range(n):
            t += timedelta(milliseconds=int(rng.integers(100, 2000)) * (40 if rng.random() < 0.1 else 1))
            rows.append((run, t, i, 1, float(rng.random() * 100)))
    return spark.createDataFrame(rows, "run int, ts timestamp, seq int, weight long, value double")


def test_last_median_is_that_of_the_last_values():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 20, 500).astype(float).tolist()
    buffer = folds.LastMedian([], 7)
    assert buffer.median() is None
    for i, v in enumerate(values):
        buffer.add(v)
        assert buffer.median() == np.median(values[max(0, i - 6) : i + 1]) and len(buffer.sorted) <= 7


def test_kept_steps_of_a_batch(spark):
    rows = log(spark, {1: 300, 2: 40, 3: 2})
    want = sorted((r["run"], r["i"], round(r["gap"], 6)) for r in progress.without_outliers(rows).collect())
    assert sorted((r["run"], r["i"], round(r["gap"], 6)) for r in folds.kept_steps(rows).collect()) == want
    assert folds.kept_steps(rows.limit(0)).isEmpty()


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def replay(spark, parts, folder, make):
    """Rows of ``parts``, each a run of the stream of its own from one checkpoint."""
    source, sink, marks = f"{folder}/in", f"{folder}/out", f"{folder}/marks"
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        q = make(stream).writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    return spark.read.parquet(sink)


def test_streamed_steps_equal_the_batch_after_a_restart(stateful, tmp_path):
    spark = stateful
    rows = log(spark, {1: 160, 2: 30})
    cut = START + timedelta(seconds=120)
    late = rows.filter(F.col("seq") % 17 == 5).filter(F.col("ts") < F.lit(cut))
    first = rows.filter(F.col("ts") < F.lit(cut)).join(late.select("run", "seq"), ["run", "seq"], "left_anti").select(*rows.columns)
    end = spark.createDataFrame([(9, START + timedelta(days=1), 0, 1, 0.0)], rows.schema)
    # Some rows of the first part arrive in the second one; the last part lets the watermark pass.
    parts = [first, late.unionByName(rows.filter(F.col("ts") >= F.lit(cut))), end, end]
    got = replay(spark, parts, str(tmp_path), lambda s: folds.kept_steps_stream(s, "1 hour"))
    want = sorted((r["run"], r["i"], round(r["gap"], 6)) for r in progress.without_outliers(rows).collect())
    assert sorted((r["run"], r["i"], round(r["gap"], 6)) for r in got.filter("run <> '9'").collect()) == want


def test_streamed_means_equal_the_fold(stateful, tmp_path):
    spark = stateful
    rows = log(spark, {1: 50, 2: 9}).withColumn("value", F.col("value") + 1)
    end = spark.createDataFrame([(9, START + timedelta(days=1), 0, 1, 0.0)], rows.schema)
    got = replay(spark, [rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"), end, end], str(tmp_path), lambda s: folds.smoothed_steps_stream(s, "value", "1 hour"))
    for run in (1, 2):
        values = [r["value"] for r in rows.filter(F.col("run") == run).orderBy("ts", "seq").collect()]
        fold = folds.MeanFold()
        want = [(i + 1, round(fold.add(v), 9)) for i, v in enumerate(values)]
        assert sorted((r["n"], round(r["smoothed"], 9)) for r in got.filter(F.col("run") == str(run)).collect()) == want
        last = spark.range(1).select(progress.smoothed(F.array(*[F.lit(v) for v in values]))).first()[0]
        assert abs(want[-1][1] - last) < 1e-6


# The filter


def plain_resize(a, height, width):
    """The filter, pixel by pixel."""
    def weight(d):
        d = abs(d)
        return (1.5 * d - 2.5) * d * d + 1 if d < 1 else -0.5 * (((d - 5) * d + 8) * d - 4) if d < 2 else 0.0

    def line(values, m):
        n, out = len(values), []
        for o in range(m):
            s = max(n / m, 1.0)
            middle = (o + 0.5) * n / m
            at = range(max(0, int(np.floor(middle - 2 * s + 0.5))), min(n, int(np.floor(middle + 2 * s + 0.5))))
            w = [weight((i - middle + 0.5) / s) for i in at]
            fixed = [int(np.sign(k) * np.floor(abs(k / sum(w) * 2**22) + 0.5)) for k in w]
            out.append(min(255, max(0, (sum(k * int(values[i]) for i, k in zip(at, fixed, strict=True)) + 2**21) >> 22)))
        return out

    rows = np.array([line(r, width) for r in a])
    return np.array([line(c, height) for c in rows.T]).T


@pytest.mark.parametrize(("shape", "size"), [((8, 8), (4, 4)), ((9, 7), (4, 3)), ((16, 31), (8, 15)), ((5, 5), (5, 5)), ((4, 6), (9, 7)), ((2, 3), (1, 1))])
def test_filter_is_that_of_single_pixels(shape, size):
    for seed in range(3):
        a = np.random.default_rng(seed).integers(0, 256, shape).astype(np.uint8)
        assert np.array_equal(pyramid.resize_filtered(a, *size), plain_resize(a, *size))
    assert (pyramid.resize_filtered(np.full(shape, 77, np.uint8), *size) == 77).all()


def test_filtered_pyramid(spark):
    a = np.random.default_rng(4).integers(0, 256, (5, 12, 10))
    got = {(r["level"], r["z"]): np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(r["height"], r["width"]) for r in pyramid.pyramid(slices(spark, a), 2, "filter").collect()}
    first = [pyramid.resize_filtered(((a[2 * z] + a[min(2 * z + 1, 4)]) // 2 if 2 * z + 1 < 5 else a[4]).astype(np.uint8), 6, 5) for z in range(3)]
    assert all(np.array_equal(got[1, z], first[z]) for z in range(3))
    assert np.array_equal(got[2, 1], pyramid.resize_filtered(first[2], 3, 2))
    wide = slices(spark, a * 200, 16)
    assert sorted(map(tuple, volume.voxels(pyramid.pyramid(wide, 1, "filter")).collect())) == sorted(map(tuple, volume.voxels(pyramid.pyramid(wide, 1, "floor")).collect()))
    with pytest.raises(ValueError, match="variant"):
        pyramid.pyramid(wide, 1, "best")
