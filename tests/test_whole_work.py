"""Folders, pyramids and meshes from end to end, and edge cases of small operators."""

import numpy as np
import pytest

from stratavox.operators import mesh, pyramid, volume
from stratavox.sources import safety, sequence, sinks


def slices(spark, n=8, side=16):
    a = np.arange(n * side * side).reshape(n, side, side) % 251
    rows = [("s", 0, z, side, side, 8, a[z].astype(np.uint8).tobytes()) for z in range(n)]
    return spark.createDataFrame(rows, pyramid.SCHEMA)


def found(df):
    return sorted((r["level"], r["z"], r["width"], bytes(r["pixels"])) for r in df.collect())


def test_open_directory_and_its_errors(spark, tmp_path):
    for i in (1, 2, 10):
        (tmp_path / f"ct_{i:04d}.tif").write_bytes(b"x")
    (tmp_path / "empty").mkdir()
    row = sequence.open_directory(spark, str(tmp_path)).first()
    assert (row["prefix"], row["seq_begin"], row["seq_end"], row["index_length"]) == ("ct_", 1, 10, 4)
    with pytest.raises(FileNotFoundError):
        sequence.open_directory(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        sequence.open_directory(spark, str(tmp_path / "ct_0001.tif"))
    with pytest.raises(sequence.NoImagesError):
        sequence.open_directory(spark, str(tmp_path / "empty"))
    for path in ("", "a/../b", "a\0b"):
        with pytest.raises(safety.UnsafePathError):
            sequence.open_directory(spark, path)


def test_slices_in_order_needs_images(spark):
    rows = spark.createDataFrame([("/a/s2.TIF", "s2.TIF"), ("/a/s10.png", "s10.png"), ("/a/n.txt", "n.txt")], "path string, name string")
    assert [r["name"] for r in sequence.slices_in_order(rows).collect()] == ["s2.TIF", "s10.png"]
    with pytest.raises(sequence.NoImagesError):
        sequence.slices_in_order(rows.filter("name = 'n.txt'"))


def test_built_pyramid_goes_on_where_it_ended(spark, tmp_path):
    path, rows, seen = str(tmp_path / "levels"), slices(spark), []
    part = pyramid.build(rows, path, 3, group_levels=1, report=lambda done, n: seen.append((done, n)) or done < 2)
    assert {r["level"] for r in part.select("level").distinct().collect()} == {1, 2} and seen == [(1, 3), (2, 3)]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "levels").glob("levels_[12]_*/_SUCCESS")}
    whole = pyramid.build(rows, path, 3, group_levels=1)
    assert len(before) == 2 and before == {p: p.stat().st_mtime_ns for p in before}
    assert found(whole) == found(pyramid.pyramid(rows, 3))
    assert sinks.delete_levels(spark, path) and not sinks.delete_levels(spark, path)
    assert pyramid.build(rows, path, 0).isEmpty()


def test_exported_mesh_has_dense_faces(spark, tmp_path):
    g = np.indices((12, 12, 12)) - 5.5
    ball = (np.sqrt((g**2).sum(0)) < 4).astype(int) * 200
    vox = spark.createDataFrame([(*map(int, i), int(v)) for i, v in np.ndenumerate(ball)], "z int, y int, x int, v int")
    corners = mesh.marching_cubes(vox, ball.shape, 100.0, slab=4)
    v, t = mesh.dense(*mesh.indexed(corners))
    ids = sorted(r["vid"] for r in v.collect())
    assert ids == list(range(len(ids)))
    faces = t.collect()
    assert {i for r in faces for i in (r["a"], r["b"], r["c"])} == set(ids)
    # A closed surface of genus 0.
    assert len(ids) - 3 * len(faces) // 2 + len(faces) == 2
    sinks.export_mesh(corners, str(tmp_path / "obj"))
    lines = next((tmp_path / "obj").glob("part-*")).read_text().split("\n")
    assert sum(x.startswith("v ") for x in lines) == len(ids) and sum(x.startswith("f ") for x in lines) == len(faces)
    assert max(int(n) for x in lines if x.startswith("f ") for n in x.split()[1:]) == len(ids)


def test_dense_mesh_of_nothing(spark):
    v = spark.createDataFrame([], "vid long, v0 double, v1 double, v2 double")
    t = spark.createDataFrame([], "tid long, a long, b long, c long")
    assert all(df.isEmpty() for df in mesh.dense(v, t))


@pytest.mark.parametrize(
    ("rows", "valid"),
    [([], False), ([(0, 0, 0, 5)], True), ([(0, 0, 0, 5), (0, 0, 1, 6)], True), ([(0, 0, 0, 5), (0, 0, 0, 6)], False), ([(0, 0, 0, 5), (0, 1, 1, 6)], False), ([(0, 0, 0, None)], False), ([(0, 0, 0, 1), (0, 0, 0, 1), (0, 1, 0, 1), (0, 1, 1, 1)], False)],
)
def test_valid_volumes(spark, rows, valid):
    assert volume.is_valid(spark.createDataFrame(rows, "z int, y int, x int, v int")).first()["valid"] is valid


def test_snapping(spark):
    rows = spark.createDataFrame([(v,) for v in (-3, 0, 4, 5, 6, 40, None, 4)], "v int")
    points = spark.createDataFrame([(p,) for p in (0, 10, 2, 8, 8, None, -9)], "p int")
    got = sorted((r["v"] for r in volume.snapped(rows, "v", points, 3).collect()), key=repr)
    want = [0, 0, 2, 2, 2, 8, 40, None]
    assert got == sorted(want, key=repr)
    exact = [r["v"] for r in volume.snapped(rows, "v", points, 0).collect()]
    assert sorted(exact, key=repr) == sorted((-3, 0, 4, 5, 6, 40, None, 4), key=repr)


def test_new_levels_once(spark):
    have = spark.createDataFrame([("s", 0, "Original")], "stack_id string, level int, name string")
    more = spark.createDataFrame([("s", 5, "Original"), ("s", 1, "Level 1"), ("s", 2, "Level 1")], "stack_id string, level int, name string")
    assert sorted(map(tuple, sequence.with_new_levels(have, more).collect())) == [("s", 0, "Original"), ("s", 1, "Level 1")]
