import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import regions, scalars
from stratavox.sources import codec, safety, sequence, sinks


def names(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "name string")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([f"slice_{i:04d}.tif" for i in range(1, 11)], ("slice_", "tif", 4, 1, 10)),
        ([f"scan_{i:03d}.tif" for i in range(1, 6)] + ["README.txt", "scan.log"], ("scan_", "tif", 3, 1, 5)),
        ([f"main_{i:03d}.tif" for i in range(10)] + [f"other_{i:03d}.tif" for i in range(3)], ("main_", "tif", 3, 0, 9)),
        ([f"gap_{i:03d}.tif" for i in (1, 5, 10, 15)], ("gap_", "tif", 3, 1, 15)),
        ([f"img_{i:04d}.TIF" for i in (1, 2, 10, 20, 100)], ("img_", "tif", 4, 1, 100)),
    ],
)
def test_detect(spark, rows, want):
    r = sequence.detect(names(spark, rows)).first()
    assert (r["prefix"], r["file_type"], r["index_length"], r["seq_begin"], r["seq_end"]) == want


def test_no_supported_format(spark):
    assert sequence.detect(names(spark, [f"data_{i:03d}.dat" for i in range(5)])).isEmpty()


def test_present_and_missing(spark):
    files = names(spark, [f"gap_{i:03d}.TIF" for i in (1, 5, 10, 15)])
    s = sequence.detect(files)
    assert sequence.present(s, files).count() == 4 and sequence.missing(s, files).count() == 11


def test_listing_helpers(spark, tmp_path):
    for n in ("a2.tif", "a10.tif", "x.log", "b.txt"):
        (tmp_path / n).write_bytes(b"12345")
    files = sequence.list_files(spark, str(tmp_path))
    assert [r["name"] for r in sequence.image_files(files).collect()] == ["a10.tif", "a2.tif"]
    assert [r["name"] for r in files.filter("name like 'a%'").orderBy(sequence.natural_key(F.col("name"))).collect()] == ["a2.tif", "a10.tif"]
    assert sequence.first_log(files).first()["name"] == "x.log" and sequence.count_files(files, ".TIF") == 2
    assert sequence.total_bytes(files).first()["bytes"] == 20 and sequence.is_image_directory(files)
    levels = spark.createDataFrame([(1,), (2,), (4,)], "level int")
    assert sequence.contiguous_levels(levels).count() == 2


def test_names(spark):
    r = spark.range(1).select(*[c.alias(k) for k, c in scalars.name_parts(F.lit("0001.tif"), scalars.STRICT_PATTERN).items()]).first()
    assert (r["prefix"], r["number"], r["ext"]) == ("0", 1, "tif")
    p = scalars.pair_names(F.lit("s_"), F.lit(9), F.lit(9), F.lit(3), F.lit("png"), F.lit(0))
    r = spark.range(1).select(p["first"].alias("a"), p["second"].alias("b"), scalars.level_file_name(F.lit(3)).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == ("s_009.png", None, "000003.tif")


@pytest.mark.parametrize("s, want", [(-1.0, "0s"), (45.5, "45.5s"), (90.0, "1.5m"), (3661.0, "1h 1m"), (7200.0, "2h"), (12.25, "12.2s"), (0.35, "0.3s"), (63.0, "1.1m"), (59.96, "60.0s")])
def test_duration(spark, s, want):
    assert spark.range(1).select(scalars.duration_text(F.lit(s))).first()[0] == want


def test_fixed_rounds_like_exact_decimals(spark):
    rng = np.random.default_rng(6)
    xs = np.concatenate([rng.random(2000) * 1000, np.arange(400) / 8, np.arange(400) / 40]).tolist()
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalars.fixed(F.col("x"), 1).alias("a"), scalars.fixed(F.col("x"), 2).alias("b")).collect()
    assert all(r["a"] == f"{r['x']:.1f}" and r["b"] == f"{r['x']:.2f}" for r in rows)


@pytest.mark.parametrize("n, want", [(0, "0.00 B"), (1536, "1.50 KB"), (5 * 1024**3, "5.00 GB"), (3 * 1024**5, "3.00 PB")])
def test_file_size(spark, n, want):
    assert spark.range(1).select(scalars.file_size_text(F.lit(n))).first()[0] == want


def test_regions(spark):
    lit = F.lit
    r = spark.range(1).select(
        F.array(*regions.from_corners(lit(5), lit(6), lit(1), lit(2))).alias("box"),
        regions.contains(lit(5), lit(6), lit(1), lit(2), lit(5), lit(6)).alias("on_edge"),
        regions.contains(lit(5), lit(6), lit(None).cast("int"), lit(2), lit(5), lit(6)).alias("unset"),
        regions.from_fractions(lit(0.5), lit(5)).alias("half_even"),
        F.array(*regions.clamp_indices(lit(9), lit(3), lit(10))).alias("clamped"),
        F.array(*regions.coerced_range(lit(10), lit(0), lit(7), lit(99), lit(3))).alias("range"),
        regions.switch_level(lit(7), lit(0), lit(1), lit(3)).alias("other"),
        F.array(*regions.moved(lit(1), lit(1), lit(4), lit(4), lit(9), lit(-9), lit(8), lit(8))).alias("moved"),
    ).first()
    assert (r["box"], r["on_edge"], r["unset"], r["half_even"], r["clamped"], r["range"], r["other"], r["moved"]) == ([1, 2, 5, 6], True, False, 2, [9, 10], [3, 10, 7], 2, [5, 0, 8, 3])
    assert len(regions.BOX_EDGES) == 12


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
@pytest.mark.parametrize("encode", [codec.encode_tiff, lambda a: codec.encode_tiff(a, True), codec.encode_png])
def test_codec_round_trip(dtype, encode):
    a = np.random.default_rng(7).integers(0, np.iinfo(dtype).max, (5, 7), dtype, endpoint=True)
    data = encode(a)
    assert np.array_equal(codec.decode(data), a)
    assert codec.header(data) == (7, 5, a.dtype.itemsize * 8)


def test_codec_errors_and_depths():
    with pytest.raises(codec.ImageError):
        codec.decode(b"no image")
    with pytest.raises(codec.ImageError):
        codec.decode(codec.encode_png(np.zeros((3, 3), np.uint8))[:40])
    assert codec.to_depth(np.array([[200]], np.uint8), 16)[0, 0] == 51200 and codec.to_depth(np.array([[25600]], np.uint16), 8)[0, 0] == 100


def test_bmp():
    import struct

    rows = b"".join(bytes([i, i, i, 0, 0, 0]) + b"\0\0" for i in (10, 20))
    data = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert codec.decode(data).tolist() == [[20, 0], [10, 0]]


def test_stack_from_files_to_files(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for i in range(4):
        a = (np.arange(48).reshape(6, 8) + i * 25).astype(np.uint8)
        (src / f"slice_{i + 1:04d}.{'tif' if i < 3 else 'tif'}").write_bytes(codec.encode_tiff(a))
    (src / "slice_0005.tif").write_bytes(b"broken")
    (src / "notes.txt").write_text("x")
    stack = codec.read_stack(spark, str(src), "s")
    rows = {r["z"]: r for r in stack.collect()}
    assert len(rows) == 5 and rows[4]["pixels"] is None and rows[4]["error"]
    cropped = sinks.cropped_slices(stack.filter("pixels is not null"), 1, 2, (2, 1, 5, 4))
    done = sinks.export_stack(cropped, f"file://{out}", scalars.level_file_name(F.col("z"))).collect()
    assert [r["error"] for r in done] == [None, None]
    got = codec.decode((out / "000001.tif").read_bytes())
    assert np.array_equal(got, (np.arange(48).reshape(6, 8) + 25)[1:4, 2:5])


def test_levels_as_parquet_and_obj(spark, tmp_path):
    s = spark.createDataFrame([("s", 1, 0, 1, 1, 8, bytearray(b"a")), ("s", 2, 0, 1, 1, 8, bytearray(b"b"))], "stack_id string, level int, z int, width int, height int, bit_depth int, pixels binary")
    sinks.write_levels(s, str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p")).filter("level = 2")
    assert read.count() == 1 and sequence.level_catalog(read).first()["name"] == "Level 2"
    v = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)], "vid long, v0 double, v1 double, v2 double")
    t = spark.createDataFrame([(0, 0, 1, 2)], "tid long, a long, b long, c long")
    sinks.write_obj(v, t, str(tmp_path / "o"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["v 3.0 1.0 2.0", "v 6.0 4.0 5.0", "f 1 2 3"]


def test_paths(tmp_path):
    assert safety.safe_join(str(tmp_path), "a.tif").endswith("a.tif")
    for bad in ("../x", "/etc", "a|b", "\\x", ""):
        with pytest.raises(safety.UnsafePathError):
            safety.safe_join(str(tmp_path), bad)
    (tmp_path / "l").symlink_to("/etc")
    with pytest.raises(safety.UnsafePathError):
        safety.safe_join(str(tmp_path), "l")
