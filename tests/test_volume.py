import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import levels, mesh, pyramid, volume
from stratavox.streaming import progress


def long_form(spark, a, **more):
    z, y, x = np.indices(a.shape)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"z": z.ravel(), "y": y.ravel(), "x": x.ravel(), "v": a.ravel().astype(float if a.dtype.kind == "f" else int)}))
    return df if a.dtype.kind == "f" else df.select("z", "y", "x", F.col("v").cast("int").alias("v"))


def dense(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r["v"]
    return out


def slices(spark, a, stack="s"):
    depth = a.dtype.itemsize * 8
    rows = [(stack, 0, z, a.shape[2], a.shape[1], depth, bytearray(a[z].astype(a.dtype.newbyteorder("<")).tobytes())) for z in range(len(a))]
    return spark.createDataFrame(rows, pyramid.SCHEMA)


def images(df):
    return {(r["level"], r["z"]): np.frombuffer(bytes(r["pixels"]), f"<u{r['bit_depth'] // 8}").reshape(r["height"], r["width"]) for r in df.collect()}


def test_two_roundings_do_not_merge(spark):
    a = np.zeros((2, 2, 2), np.uint8)
    a[0, 0] = 1
    v = long_form(spark, a)
    assert volume.halve(v, 2, 2, 2, "round").first()["v"] == 1
    assert volume.halve(v, 2, 2, 2, "floor").first()["v"] == 0


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
@pytest.mark.parametrize("variant", ["round", "floor"])
@pytest.mark.parametrize("odd", ["keep", "drop"])
def test_slice_form_equals_long_form(spark, dtype, variant, odd):
    a = np.random.default_rng(1).integers(0, np.iinfo(dtype).max, (7, 9, 10), dtype, endpoint=True)
    s = slices(spark, a)
    got = images(pyramid.pyramid(s, 3, variant, odd, group_levels=2))
    want = volume.pyramid(volume.voxels(s).select("z", "y", "x", "v"), 10, 9, 7, 3, variant, odd)
    for level, shape in ((1, (4 if odd == "keep" else 3, 4, 5)), (2, (2 if odd == "keep" else 1, 2, 2)), (3, (1, 1, 1))):
        rows = want.filter(F.col("level") == level)
        have = {k: v for k, v in got.items() if k[0] == level}
        if not have:
            assert rows.isEmpty()
            continue
        assert np.array_equal(np.stack([have[level, z] for z in range(shape[0])]), dense(rows, shape))


def test_partitions_do_not_matter(spark):
    a = np.random.default_rng(2).integers(0, 255, (6, 8, 8)).astype(np.uint8)
    want = dense(volume.halve(long_form(spark, a), 8, 8, 6), (3, 4, 4))
    for n in (1, 2, 7):
        assert np.array_equal(dense(volume.halve(long_form(spark, a).repartition(n), 8, 8, 6), (3, 4, 4)), want)


@pytest.mark.parametrize("pair, dtype, want", [((100, 200), np.uint8, 150), ((255, 255), np.uint8, 255), ((30000, 40000), np.uint16, 35000)])
def test_pair_mean(spark, pair, dtype, want):
    a = np.stack([np.full((2, 2), v, dtype) for v in pair])
    assert set(dense(volume.pair_average(long_form(spark, a)), (1, 2, 2)).ravel()) == {want}


def test_mixed_depth_widens():
    rows = __import__("pandas").DataFrame({"width": [1, 1], "height": [1, 1], "bit_depth": [8, 16], "pixels": [b"\x02", b"\x00\x04"]})
    a, b = pyramid._widened(rows)
    assert a[0, 0] == 512 and b[0, 0] == 1024


def test_missing_levels_are_those_not_there(spark):
    s = slices(spark, np.zeros((4, 4, 4), np.uint8))
    existing = spark.createDataFrame([(1, 0)], "level int, z int")
    assert {(r["level"], r["z"]) for r in pyramid.missing_levels(s, existing, 2).collect()} == {(1, 1), (2, 0)}


def test_crop_positions(spark):
    z, y, x = np.indices((10, 10, 10))
    v = long_form(spark, (z * 100 + y * 10 + x).astype(np.int32))
    row = {"level": 0, "width": 10, "height": 10, "seq_begin": 0, "seq_end": 9}
    c = volume.crop_bounds(row, row, 0, 5, (0, 0, 5, 5))
    got = dense(volume.crop(v, c), (5, 5, 5))
    assert (got[0, 0, 0], got[0, 0, 4], got[0, 4, 0], got[4, 4, 4]) == (0, 4, 40, 444)
    c = volume.crop_bounds(row, row, 1, 6, (2, 3, 7, 8))
    got = dense(volume.crop(v, c), (5, 5, 5))
    assert got[0, 0, 0] == 132 and got[4, 4, 4] == 576
    c = volume.crop_bounds(row, row, -1, -1, (0, 0, 10, 10))
    assert (c.z0, c.z_end) == (0, 9)
    small = {"level": 2, "width": 2, "height": 2, "seq_begin": 0, "seq_end": 2}
    assert volume.crop_bounds(row, small, 0, 9, (0, 0, 10, 10)).roi() == [0, 8, 0, 8, 0, 8]


def phantom(dtype):
    rng = np.random.default_rng(3)
    z, y, x = np.indices((60, 100, 100))
    inside = ((x - 50) ** 2 + (y - 50) ** 2 <= 22**2) & (z > 10) & (z < 45)
    a = np.clip(np.where(inside, rng.normal(200, 10, z.shape), rng.normal(30, 7.5, z.shape)), 0, 255)
    return a.astype(np.uint8) if dtype == np.uint8 else (a * 257).astype(np.uint16)


def test_auto_setup_of_a_phantom(spark):
    rows = {}
    for dtype, top in ((np.uint8, 255), (np.uint16, 65535)):
        # At full size, where a thousandth of a cross-section is more than one voxel.
        a = phantom(dtype)
        rows[dtype] = volume.auto_setup(long_form(spark, a), type_max=top).first()
        got = [rows[dtype][c] for c in ("x_low", "y_low", "x_high", "y_high", "z_low", "z_high")]
        assert np.allclose(got, [0.27, 0.27, 0.74, 0.74, 0.15, 0.78], atol=0.05)
    assert abs(rows[np.uint8]["threshold"] - rows[np.uint16]["threshold"]) <= 1
    a = phantom(np.uint8).copy()
    a[0, 0, 0] = 255
    assert volume.auto_setup(long_form(spark, a)).first()["x_low"] == rows[np.uint8]["x_low"]


@pytest.mark.parametrize("a", [np.full((6, 6, 6), 42, np.uint8), np.random.default_rng(4).normal(128, 20, (10, 12, 12)).clip(0, 255).astype(np.uint8)])
def test_no_proposal(spark, a):
    assert volume.auto_setup(long_form(spark, a)).isEmpty()


def test_otsu_between_two_spikes(spark):
    h = spark.range(256).select(F.col("id").alias("bin"), F.when(F.col("id").isin(20, 200), 1000).otherwise(0).cast("bigint").alias("cnt"))
    r = volume.otsu(h).first()
    assert abs(r["threshold"] - 110) <= 5 and abs(r["separability"] - 1) < 1e-9
    assert volume.otsu(h.withColumn("cnt", F.lit(0))).isEmpty()


def test_float_histogram(spark):
    a = np.linspace(-1, 1, 27).reshape(3, 3, 3)
    assert volume.float_histogram(long_form(spark, a)).agg(F.sum("cnt")).first()[0] == 27
    assert volume.float_histogram(long_form(spark, np.ones((2, 2, 2)))).agg(F.sum("cnt")).first()[0] == 0


def test_empty_volume(spark):
    v = spark.createDataFrame([], "z int, y int, x int, v int")
    assert volume.auto_setup(v).isEmpty() and volume.halve(v, 4, 4, 4).isEmpty()
    assert volume.histogram(v).count() == 256


def test_level_numbers(spark):
    assert levels.levels_needed(500, 500) == 0 and levels.levels_needed(2000, 501) == 2
    assert levels.output_count(9, 1) == 5 and levels.output_count(9, 1, "drop") == 4
    assert sum(r["images"] for r in levels.work_estimate(0, 99, 256, 256)) == 51
    cat = spark.createDataFrame([("s", 0, 200, 200), ("s", 1, 100, 100), ("s", 2, 66, 66)], "stack_id string, level int, width int, height int")
    assert levels.choose_level(cat, 150).first()["level"] == 1
    assert levels.choose_level(cat, 50).first()["level"] == 2


def test_case_table_is_watertight_and_oriented(spark):
    flat, starts = mesh.case_table()
    assert len(starts) == 257 and starts[1] == 0 and starts[256] == starts[255] and len(flat) > 800
    z, y, x = np.indices((20, 20, 20))
    a = (64 - ((z - 9.5) ** 2 + (y - 9.5) ** 2 + (x - 9.5) ** 2)).astype(int)
    corners = mesh.marching_cubes(long_form(spark, a), (20, 20, 20), 0.5, slab=6)
    v, t = mesh.indexed(corners)
    tri = np.array([[r["a"], r["b"], r["c"]] for r in t.collect()])
    edges = np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]])
    directed = {tuple(e) for e in edges.tolist()}
    assert len(directed) == len(edges) and all((b, a) in directed for a, b in directed)
    assert v.count() - len(edges) // 2 + len(tri) == 2
    centre = F.array(*[F.lit(9.5)] * 3)
    n = mesh.vertex_normals(mesh.triangle_normals(v, t)).join(v, "vid")
    out = sum(F.col(f"n{i}") * (F.col(f"v{i}") - F.get(centre, F.lit(i))) for i in range(3))
    assert n.select(F.min(out)).first()[0] > 0


def test_random_field_closes(spark):
    a = np.random.default_rng(5).integers(0, 2, (9, 9, 9))
    a[[0, -1]] = a[:, [0, -1]] = a[:, :, [0, -1]] = 0
    keys, *_ = mesh.march(a.astype(float), 0.5)
    count = {}
    for t in keys.tolist():
        for p, q in ((0, 1), (1, 2), (2, 0)):
            count[t[p], t[q]] = count.get((t[p], t[q]), 0) + 1
    assert all(count.get((b, a)) == n for (a, b), n in count.items())


def test_trilinear_keeps_linear_fields(spark):
    z, y, x = np.indices((5, 5, 5))
    a = (10 * z + 4 * y + 2 * x).astype(int)
    out = dense(mesh.trilinear(long_form(spark, a), (5, 5, 5), (9, 9, 9)), (9, 9, 9))
    z, y, x = np.indices((9, 9, 9))
    assert np.array_equal(out, np.floor(5 * z + 2 * y + x + 0.5).astype(int))
    _, shape = mesh.resampled(long_form(spark, a), (100, 50, 25))
    assert shape == (50, 25, 13)


def test_smoothing_and_trimming(spark):
    r = spark.sql("select array(10D, 100D, 11D) a, transform(sequence(1, 20), x -> double(x)) b").select(progress.smoothed(F.col("a")).alias("s"), progress.trimmed_mean(F.col("b")).alias("t")).first()
    mean = 10 + 0.1 * 2
    assert abs(r["s"] - (mean + 0.1 * (11 - mean))) < 1e-9 and r["t"] == 10.5
    assert progress.sample_size(10_000) == 30 and progress.sample_size(100) == 20 and progress.sample_size(5, 500) == 100
