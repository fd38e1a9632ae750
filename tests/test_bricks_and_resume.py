"""Surfaces by bricks, resampled stacks, crops of many stacks, resumed pyramids, runs of missing files, ranks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators import bricks, levels, mesh, pyramid, resample, volume
from stratavox.sources import sequence
from stratavox.streaming import events


def long_form(spark, a, skip=()):
    return spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(a) if i not in skip], "z int, y int, x int, v double")


def slices(spark, a, stack="s", bits=8):
    return spark.createDataFrame([(stack, 0, z, p.shape[1], p.shape[0], bits, p.astype(f"<u{bits // 8}").tobytes()) for z, p in enumerate(a)], pyramid.SCHEMA)


def field(shape=(9, 13, 11), seed=2):
    return np.random.default_rng(seed).integers(0, 256, shape)


def faces_of(rows):
    return sorted((r["tid"], r["a"], r["b"], r["c"], *(round(r[f"n{i}"], 9) + 0.0 for i in range(3))) for r in bricks.triangles(rows).collect())


def points_of(rows):
    return sorted((r["vid"], *(round(r[c], 9) + 0.0 for c in ("v0", "v1", "v2", "n0", "n1", "n2"))) for r in bricks.vertices(rows).collect())


# Surfaces


@pytest.mark.parametrize("brick", [(16, 64, 64), (4, 4, 4), (3, 5, 2), (1, 1, 1)])
def test_bricks_do_not_change_the_mesh(spark, brick):
    a = field()
    whole = bricks._surface(a.astype(float), None, 127.5, (0, 0, 0), (1 << 19,) * 3)
    got = bricks.surface(long_form(spark, a), 127.5, brick)
    t = whole[whole["kind"] == "t"]
    want = sorted((r.id, r.a, r.b, r.c, round(r.n0, 9) + 0.0, round(r.n1, 9) + 0.0, round(r.n2, 9) + 0.0) for r in t.itertuples())
    assert faces_of(got) == want
    found = {r[0]: r[1:] for r in points_of(got)}
    v = whole[whole["kind"] == "v"]
    assert sorted(found) == sorted(v["id"])
    for r in v.itertuples():
        n = np.array([r.n0, r.n1, r.n2])
        n = n / np.linalg.norm(n) if np.linalg.norm(n) > 0 else n
        assert np.allclose(found[r.id], [r.v0, r.v1, r.v2, *n], atol=1e-6) or np.linalg.norm([r.n0, r.n1, r.n2]) < 1e-6


def test_tiles_make_the_surface_that_voxels_make(spark):
    a = field()
    for bits, scale in ((8, 1), (16, 257)):
        got = bricks.surface_of_slices(slices(spark, a * scale, bits=bits), 127.5 * scale, (4, 4, 3))
        want = bricks.surface(long_form(spark, a * scale), 127.5 * scale)
        assert faces_of(got) == faces_of(want)
    many = slices(spark, a, "p").unionByName(slices(spark, 255 - a, "q"))
    both = bricks.surface_of_slices(many, 127.5, (4, 4, 4))
    assert faces_of(both.filter("stack_id = 'p'")) == faces_of(bricks.surface(long_form(spark, a), 127.5))
    assert {r["stack_id"] for r in bricks.vertices(both).select("stack_id").distinct().collect()} == {"p", "q"}


def test_a_ball_is_closed_and_its_normals_point_outward(spark):
    g = np.indices((20, 20, 20)) - 9.5
    got = bricks.surface(long_form(spark, 10 - np.sqrt((g**2).sum(0))), 3.0, (8, 8, 8))
    v, t = bricks.vertices(got).collect(), bricks.triangles(got).collect()
    assert len(v) - 3 * len(t) // 2 + len(t) == 2
    out = np.array([[r["v0"], r["v1"], r["v2"]] for r in v]) - 9.5
    n = np.array([[r["n0"], r["n1"], r["n2"]] for r in v])
    cos = (out * n).sum(1) / np.linalg.norm(out, axis=1)
    assert abs(cos).min() > 0.95 and len(set(np.sign(cos))) == 1
    assert bricks.vertices(got).count() == bricks.vertices(got).select("vid").distinct().count()


def test_absent_voxels_have_no_surface(spark):
    a = field((5, 5, 5))
    hole = (2, 2, 2)
    got = {r[0] >> 3 for r in faces_of(bricks.surface(long_form(spark, a, skip=(hole,)), 127.5, (2, 2, 2)))}
    want = {r[0] >> 3 for r in faces_of(bricks.surface(long_form(spark, a), 127.5))}
    near = {z << 40 | y << 20 | x for z in (1, 2) for y in (1, 2) for x in (1, 2)}
    assert got == want - near
    a = slices(spark, field((6, 5, 5)))
    part = bricks.surface_of_slices(a.filter("z <> 3"), 127.5, (2, 4, 4))
    assert {r[0] >> 43 for r in faces_of(part)} <= {0, 1, 4}
    assert bricks.surface(long_form(spark, a=np.zeros((1, 4, 4))), 0.5).isEmpty() and bricks.surface(long_form(spark, field((2, 2, 2))).limit(0), 1.0).isEmpty()


def test_a_task_holds_a_brick_whatever_the_slice(spark):
    rows = bricks.tiles(slices(spark, field((3, 40, 30))), (2, 8, 8))
    assert rows.agg(F.max(F.length("pixels"))).first()[0] == 81
    assert rows.select("bz", "by", "bx").distinct().count() == 2 * 5 * 4


def test_mesh_transform_turns_axes(spark):
    v = spark.createDataFrame([(1, 10.0, 20.0, 30.0, 0.0, 0.6, 0.8)], "vid long, v0 double, v1 double, v2 double, n0 double, n1 double, n2 double")
    r = mesh.adjusted(v, (0.5, 0.25, 1.0)).first()
    assert (r["v0"], r["v1"], r["v2"]) == (2.0, 0.5, 1.75) and (r["n0"], r["n1"], r["n2"]) == (0.8, 0.0, 0.6)


# Resampling


@pytest.mark.parametrize(("shape", "scale"), [((7, 9, 5), 0.6), ((4, 3, 6), 1.7), ((2, 5, 5), 0.2), ((1, 4, 4), 2.0)])
def test_slices_resample_as_voxels_do(spark, shape, scale):
    a = field(shape)
    out = tuple(mesh.zoom_size(n, scale) for n in shape)
    want = {(r["z"], r["y"], r["x"]): r["v"] for r in mesh.trilinear(long_form(spark, a), shape, out).collect()}
    assert len(want) == np.prod(out)
    for bits in (8, 16):
        got = volume.voxels(resample.zoom_slices(slices(spark, a, bits=bits), scale))
        assert {(r["z"], r["y"], r["x"]): r["v"] for r in got.collect()} == want


def test_resampling_joins_no_voxels(spark):
    plan = mesh.trilinear(long_form(spark, field()), (9, 13, 11), (5, 5, 5))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_resampling_edges(spark):
    rows = slices(spark, field((3, 4, 4))).withColumn("pixels", F.when(F.col("z") != 1, F.col("pixels")))
    assert resample.zoom_slices(rows, 1.0).count() == 2 and resample.zoom_slices(rows.limit(0), 2.0).isEmpty()
    two = slices(spark, field((3, 4, 4)), "a").unionByName(slices(spark, field((8, 6, 2)), "b"))
    got = {(r["stack_id"], r["n"], r["w"], r["h"]) for r in resample.zoom_slices(two, 0.5).groupBy("stack_id").agg(F.count("*").alias("n"), F.max("width").alias("w"), F.max("height").alias("h")).collect()}
    assert got == {("a", 2, 2, 2), ("b", 4, 1, 3)}


# One scan


def test_auto_setup_reads_the_volume_once(spark, tmp_path):
    a = np.full((12, 10, 10), 20)
    a[3:8, 2:7, 3:8] = 200
    long_form(spark, a).withColumn("v", F.col("v").cast("int")).write.parquet(str(tmp_path / "v"))
    rows = volume.auto_setup(spark.read.parquet(str(tmp_path / "v")))
    assert rows.count() == 1
    found = rows.collect()[0]
    plan = rows._jdf.queryExecution()
    rows.collect()
    text = rows._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert plan is not None and final.count("FileScan") == 1, final
    old = volume.otsu(volume.histogram(spark.read.parquet(str(tmp_path / "v")))).first()
    assert found["threshold"] == old["threshold"]


@pytest.mark.parametrize("type_max", [255, 65535])
def test_joint_histograms_merge_and_agree(spark, type_max):
    a = np.random.default_rng(4).integers(0, type_max + 1, (6, 7, 8))
    vox = long_form(spark, a).withColumn("v", F.col("v").cast("int"))
    whole = volume.joint_histogram(vox, type_max)
    parts = volume.merged(volume.joint_histogram(vox.filter("z < 2"), type_max), volume.joint_histogram(vox.filter("z >= 2"), type_max))
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, volume.histogram_of(whole).collect())) == sorted(map(tuple, volume.histogram(vox, type_max).collect()))
    for t in (0, 100, 254):
        cut = spark.createDataFrame([(t, 1.0)], "threshold long, separability double")
        want = volume.marginals(volume.foreground(vox, cut, type_max), F.col("fg"))
        assert sorted(map(tuple, volume.marginals_of(whole, cut).select("axis", "position", "cnt", "n").collect())) == sorted(map(tuple, want.collect()))


# Crops of many stacks


def test_crops_of_all_stacks_equal_crops_one_by_one(spark):
    rng = np.random.default_rng(1)
    sizes = {"a": (40, 8, 6), "b": (5, 12, 9)}
    volumes = {k: rng.integers(0, 99, s) for k, s in sizes.items()}
    vox, catalog = None, []
    for k, a in volumes.items():
        rows = long_form(spark, a).withColumns({"stack_id": F.lit(k), "level": F.lit(1)})
        vox = rows if vox is None else vox.unionByName(rows)
        d, h, w = a.shape
        catalog += [(k, 1, w, h, 0, d - 1), (k, 0, 2 * w + 1, 2 * h, 3, 3 + 2 * d)]
    asked = [(i, "ab"[i % 2], i % 2 if i < 20 else 0, *map(int, (rng.integers(-1, 30), rng.integers(-1, 60), rng.integers(-2, 4), rng.integers(-2, 4), rng.integers(1, 20), rng.integers(1, 20)))) for i in range(30)]
    asked.append((99, "a", 7, 0, 1, 0, 0, 1, 1))
    regions = spark.createDataFrame(asked, "region_id int, stack_id string, level int, bottom int, top int, x1 int, y1 int, x2 int, y2 int")
    table = spark.createDataFrame(catalog, "stack_id string, level int, width int, height int, seq_begin int, seq_end int")
    names = ("stack_id", "level", "width", "height", "seq_begin", "seq_end")
    rows = {(r[0], r[1]): dict(zip(names, r, strict=True)) for r in catalog}
    ranges = volume.crop_ranges(regions, table)
    got = {r["region_id"]: tuple(r[c] for c in ("z0", "z_end", "y0", "y_end", "x0", "x_end", "factor")) for r in ranges.collect()}
    want = {}
    for i, stack, level, bottom, top, x1, y1, x2, y2 in asked[:-1]:
        c = volume.crop_bounds(rows[stack, level], rows[stack, 1], bottom, top, (x1, y1, x2, y2))
        want[i] = (c.z0, c.z_end, c.y0, c.y_end, c.x0, c.x_end, c.factor)
    assert got == want
    cropped = {}
    for r in volume.crop_regions(vox, ranges).collect():
        cropped.setdefault(r["region_id"], set()).add((r["z"], r["y"], r["x"], int(r["v"])))
    for i, (z0, z1, y0, y1, x0, x1, _) in want.items():
        if x0 >= 0 and y0 >= 0:
            part = volumes["ab"[i % 2]][z0:z1, y0:y1, x0:x1]
            assert cropped.get(i, set()) == {(*map(int, k), int(v)) for k, v in np.ndenumerate(part)}


# Resumed pyramids


def images(df):
    return {(r["stack_id"], r["level"], r["z"]): bytes(r["pixels"]) for r in df.collect()}


def test_resume_makes_what_is_missing_alone(spark, tmp_path):
    path = str(tmp_path / "levels")
    rows = slices(spark, field((13, 16, 16))).unionByName(slices(spark, field((6, 16, 16), 5), "t"))
    want = images(pyramid.pyramid(rows, 3))
    assert images(pyramid.resume(rows, path, 3)) == want
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "levels").glob("level=*/*.parquet")}
    assert images(pyramid.resume(rows, path, 3)) == want
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "levels").glob("level=*/*.parquet")}
    # One image of a level is lost: its level is rewritten without it, and one image is made.
    left = spark.read.parquet(path).filter("not (level = 2 and z = 1 and stack_id = 's')")
    left.write.partitionBy("level").parquet(str(tmp_path / "left"))
    before = spark.read.parquet(str(tmp_path / "left")).count()
    names = {p.name for p in (tmp_path / "left").glob("level=*/*.parquet")}
    assert images(pyramid.resume(rows, str(tmp_path / "left"), 3)) == want
    made = [p for p in (tmp_path / "left").glob("level=*/*.parquet") if p.name not in names]
    assert sum(spark.read.parquet(str(p)).count() for p in made) == 1 and len(want) == before + 1
    plan = pyramid.closure(rows, left, 3).collect()
    assert sorted((r["stack_id"], r["level"], r["z"], r["make"]) for r in plan) == [("s", 1, 2, False), ("s", 1, 3, False), ("s", 2, 1, True)]


@pytest.mark.parametrize("odd", ["keep", "drop"])
def test_missing_images_equal_those_of_the_whole(spark, odd):
    rows = slices(spark, field((13, 16, 16)))
    whole = pyramid.pyramid(rows, 3, odd=odd)
    want = images(whole)
    lost = [k for k in want if (k[1] * 7 + k[2]) % 3 == 0]
    existing = whole.filter((F.col("level") * 7 + F.col("z")) % 3 != 0)
    for have in (existing, existing.select("stack_id", "level", "z"), existing.select("level", "z")):
        got = images(pyramid.missing_levels(rows, have, 3, odd=odd))
        assert got == {k: want[k] for k in lost}
    assert pyramid.missing_levels(rows, whole, 3, odd=odd).isEmpty()
    assert images(pyramid.missing_levels(rows, whole.limit(0), 3, odd=odd)) == want
    assert {(r["level"], r["z"]) for r in pyramid.wanted_levels(rows, 3, odd).collect()} == {k[1:] for k in want}


# Files


def names(spark, numbers, width=4, ext="tif"):
    return spark.createDataFrame([(f"s_{i:0{width}d}.{ext}",) for i in numbers], "name string")


def test_missing_runs_of_a_long_sequence_are_found_at_once(spark):
    row = spark.createDataFrame([("s_", "tif", 4, 1, 1_000_000_000)], "prefix string, file_type string, index_length int, seq_begin long, seq_end long")
    files = names(spark, [1, 700_000_000])
    got = sorted((r["first"], r["last"]) for r in sequence.missing_runs(row, files).collect())
    assert got == [(2, 699_999_999), (700_000_001, 1_000_000_000)]


def test_runs_across_blocks_and_ends(spark, monkeypatch):
    monkeypatch.setattr(sequence, "RUN_BLOCK", 8)
    rng = np.random.default_rng(6)
    row = spark.createDataFrame([("s_", "tif", 4, 3, 120), ("q_", "png", 2, 1, 9)], "prefix string, file_type string, index_length int, seq_begin long, seq_end long")
    have = sorted({*map(int, rng.integers(0, 125, 50)), 40, 41, 42})
    files = names(spark, have).unionByName(names(spark, [5, 6], 4, "TIF")).unionByName(names(spark, [7], 3)).unionByName(spark.createDataFrame([("note.txt",)], "name string"))
    there = {i for i in [*have, 5, 6] if 3 <= i <= 120}
    got = {(r["prefix"], i) for r in sequence.missing_runs(row, files).collect() for i in range(r["first"], r["last"] + 1)}
    assert got == {("s_", i) for i in range(3, 121) if i not in there} | {("q_", i) for i in range(1, 10)}
    runs = sorted((r["first"], r["last"]) for r in sequence.missing_runs(row, files).filter("prefix = 's_'").collect())
    assert all(a[1] + 1 < b[0] for a, b in zip(runs, runs[1:], strict=False))
    one = row.filter("prefix = 's_'")
    assert sorted(r["index"] for r in sequence.missing(one, files).collect()) == [i for i in range(3, 121) if i not in there]
    assert sorted(r["index"] for r in sequence.present(one, files).collect()) == sorted(there)
    assert sequence.missing(one, names(spark, range(3, 121))).isEmpty()


def test_places_need_no_single_task(spark):
    rng = np.random.default_rng(3)
    data = [(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 9000), rng.permutation(9000), strict=True)]
    rows = spark.createDataFrame(data, "a int, b int")
    got = sequence.placed(rows, [F.col("a"), F.col("b")])
    assert [(r["a"], r["b"]) for r in sorted(got.collect(), key=lambda r: r["place"])] == sorted(data)
    assert got.agg(F.count_distinct("place"), F.max("place")).first()[:] == (9000, 8999)
    assert sequence.placed(rows.limit(0), [F.col("a")]).isEmpty()
    assert sequence.placed(spark.createDataFrame([(1,)] * 5, "a int"), [F.col("a")]).agg(F.sum("place")).first()[0] == 10


# Small ones


def test_work_of_many_stacks(spark):
    data = [("a", 1, 100, 256), ("b", 0, 999, 4000), ("c", 5, 5, 100)]
    got = {}
    for r in levels.work_estimates(spark.createDataFrame(data, "stack_id string, seq_begin int, seq_end int, size int"), 256).collect():
        got.setdefault(r["stack_id"], []).append({c: r[c] for c in ("level", "images", "size", "weight")})
    for name, begin, end, size in data:
        assert sorted(got.get(name, []), key=lambda r: r["level"]) == levels.work_estimate(begin, end, size, 256)


def test_results_in_order(spark):
    rows = spark.createDataFrame([("r", 3, 1.0), ("r", 1, None), ("r", 2, 5.0), ("q", 9, 2.0)], "run string, i int, v double")
    assert sorted((r["run"], r["i"], r["place"]) for r in events.in_order(rows, "run", "i", "v").collect()) == [("q", 9, 0), ("r", 2, 0), ("r", 3, 1)]


def test_vertices_make_their_surface_once_and_small_bricks_together(spark):
    side = 6
    image = lambda z: bytes((37 * z + 11 * i) % 256 for i in range(side * side))
    rows = spark.createDataFrame([("s", 0, z, side, side, 8, image(z)) for z in range(70)], pyramid.SCHEMA)
    small, large = (bricks.vertices(bricks.surface_of_slices(rows, 127.5, size, "v")) for size in ((4, 2, 2), (80, 64, 64)))
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "REPARTITION_BY_NUM" in plan
    own = lambda df: {r["vid"]: tuple(round(r[c], 9) for c in df.columns if c != "stack_id") for r in df.collect()}
    assert own(small) == own(large) and len(own(large)) == large.count() > 0
    kinds = lambda k: {r["kind"] for r in bricks.surface_of_slices(rows, 127.5, (4, 2, 2), k).select("kind").distinct().collect()}
    assert kinds("v") == {"v"} and kinds("t") == {"t"} and kinds("vt") == {"v", "t"}


@pytest.mark.parametrize("odd", ["keep", "drop"])
def test_few_missing_levels_are_made_in_one_pass(spark, monkeypatch, odd):
    rows = spark.createDataFrame([("pq"[z % 2], 0, z // 2, 8, 8, 8 if z % 3 else 16, bytes((z * 7 + i) % 256 for i in range(64 if z % 3 else 128))) for z in range(43) if z not in (10, 25)], pyramid.SCHEMA)
    there = pyramid.pyramid(rows, 3, odd=odd).filter("(level + z) % 3 <> 0")
    there = spark.createDataFrame([(*r[:-1], None if r["z"] % 2 else r["pixels"]) for r in there.collect()], pyramid.SCHEMA)
    own = lambda df: sorted((r["stack_id"], r["level"], r["z"], r["bit_depth"], bytes(r["pixels"])) for r in df.collect())
    once = pyramid.missing_levels(rows, there, 3, odd=odd)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan and "REPARTITION_BY_NUM" in plan
    got = own(once)
    monkeypatch.setattr(pyramid, "GROUP_LEVELS", 0)
    assert got == own(pyramid.missing_levels(rows, there, 3, odd=odd)) and got
