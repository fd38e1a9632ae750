from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stratavox.streaming import events, progress

START = datetime(2024, 1, 1)


def log(spark, gaps, run=1):
    t, rows = START, []
    for i, g in enumerate(gaps):
        t += timedelta(seconds=g)
        rows.append((run, t, i, 1))
    return spark.createDataFrame(rows, "run int, ts timestamp, seq int, weight long")


def replay(spark, df, path, make, mode):
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.outputMode(mode).format("memory").queryName("replayed").start()
    q.processAllAvailable()
    q.stop()
    return spark.table("replayed")


def test_bursts(spark):
    rows = log(spark, [0, 1, 1, 100, 1])
    got = events.debounced(rows, "run", "seq", ("ts", "seq"), "10 seconds").orderBy("first_ts").collect()
    assert [(r["n"], r["seq"]) for r in got] == [(3, 2), (2, 4)]


def test_first_results_of_a_stream(spark, tmp_path):
    rows = log(spark, [0, 1, 1, 1]).unionByName(log(spark, [0, 1, 1, 1]))
    got = replay(spark, rows, str(tmp_path / "a"), lambda s: events.first_results(s, ["run", "seq"]), "append")
    assert got.count() == 4


def test_smoothing_of_a_stream_equals_the_fold(spark, tmp_path):
    rows = log(spark, [0, 5, 1, 9, 2]).withColumn("value", F.col("seq") * 10.0 + 10).coalesce(1)
    got = replay(spark, rows, str(tmp_path / "b"), lambda s: events.smoothed_stream(s, "run", "value"), "update").collect()[-1]
    values = F.array(*[F.lit(i * 10.0 + 10) for i in range(5)])
    assert got["n"] == 5 and abs(got["smoothed"] - spark.range(1).select(progress.smoothed(values)).first()[0]) < 1e-9


def test_outliers_and_stalls(spark):
    rows = log(spark, [0, 1, 1, 1, 1, 1, 50, 1, 70])
    kept = progress.without_outliers(rows)
    assert kept.count() == 4 and kept.agg(F.max("gap")).first()[0] == 1
    assert progress.stalls(rows).count() == 1


def test_running_progress(spark):
    last = progress.running(log(spark, [0, 1, 1, 1])).filter("i = 2").first()
    assert last["percent"] == 50 and last["eta"] == 1.0
    assert progress.reported(progress.running(log(spark, [0, 1, 1, 1])), 30).count() == 1


def test_empty_log(spark):
    empty = log(spark, [0]).filter("run > 9")
    assert progress.running(empty).isEmpty() and progress.blended(empty, F.lit(1)).isEmpty()
