"""Iso-surfaces over bricks: what a task holds depends on the brick alone, not on the size of a slice.

A brick has its own voxels and, at its upper faces, one more layer of its neighbours. The cells of all
bricks are those of the volume, each in one brick. Vertices are keyed by the grid edge they lie on, so
bricks that share a face agree on them; only those are merged by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mesh import _unit, march_cells

#: Slices, rows and columns of a brick.
BRICK = (16, 64, 64)
#: Voxels up to which small bricks that lie along z are worked on as one.
TOGETHER = 1 << 14
SURFACE = "kind string, border boolean, id long, a long, b long, c long, v0 double, v1 double, v2 double, n0 double, n1 double, n2 double"
TILE = "stack_id string, bz int, by int, bx int, z int, y0 int, x0 int, height int, width int, bit_depth int, pixels binary"


def _homes(name: str, side: int) -> Column:
    """The bricks along an axis that hold a coordinate: its own, and the one before it whose last layer it is."""
    own = F.floor(F.col(name) / side).cast("int")
    return F.when((F.col(name) % side == 0) & (F.col(name) > 0), F.array(own, own - 1)).otherwise(F.array(own))


def _joined(brick: tuple[int, int, int]) -> tuple[int, int, int]:
    """``brick``, or as many of it along z as have ``TOGETHER`` voxels: a call for each small brick would cost more than its work."""
    return brick[0] * max(1, TOGETHER // int(np.prod(brick))), brick[1], brick[2]


def _spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to tasks by their group. Bricks are few bytes and much work, so their tasks aren't to be merged by size."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def _surface(a: np.ndarray, present: np.ndarray | None, iso: float, origin: tuple[int, int, int], brick: tuple[int, int, int], kinds: str = "vt") -> pd.DataFrame:
    """Rows of ``SURFACE`` of a dense block: its triangles (t) with unit normals, its vertices (v) with the sum of those, as ``kinds`` asks."""
    keys, cells, p = march_cells(a, iso, origin, present)
    u, w = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    n = np.stack([u[:, 1] * w[:, 2] - u[:, 2] * w[:, 1], u[:, 2] * w[:, 0] - u[:, 0] * w[:, 2], u[:, 0] * w[:, 1] - u[:, 1] * w[:, 0]], 1)
    length = np.sqrt(n[:, 0] * n[:, 0] + n[:, 1] * n[:, 1] + n[:, 2] * n[:, 2])
    n = np.where(length[:, None] > 0, n / np.where(length > 0, length, 1)[:, None], 0.0)
    ids, first, place = np.unique(keys.ravel(), return_index=True, return_inverse=True)
    at = p.reshape(-1, 3)[first]
    sums = np.stack([np.bincount(place, np.repeat(n[:, i], 3), len(ids)) for i in range(3)], 1) if len(ids) else np.zeros((0, 3))
    # The edge lies in a face of the brick where a coordinate across it is a brick's first or last.
    axis = ids & 3
    corner = np.stack([ids >> 42, ids >> 22 & 0xFFFFF, ids >> 2 & 0xFFFFF], 1)
    border = np.any([(corner[:, k] % brick[k] == 0) & (axis != k) for k in range(3)], axis=0)
    none = np.zeros(len(ids), np.int64)
    vertices = {"kind": "v", "border": border, "id": ids, "a": none, "b": none, "c": none, **{f"v{i}": at[:, i] for i in range(3)}, **{f"n{i}": sums[:, i] for i in range(3)}}
    triangles = {"kind": "t", "border": False, "id": cells, **{k: keys[:, i] for i, k in enumerate("abc")}, **{f"v{i}": 0.0 for i in range(3)}, **{f"n{i}": n[:, i] for i in range(3)}}
    found = [pd.DataFrame(rows) for rows in (vertices, triangles) if rows["kind"] in kinds]
    return pd.concat(found, ignore_index=True)


def surface(vox: DataFrame, iso: float, brick: tuple[int, int, int] = BRICK, kinds: str = "vt") -> DataFrame:
    """The iso-surface of a volume in long form (z, y, x, v) as rows of ``SURFACE``; see ``vertices`` and ``triangles``.

    A cell with an absent voxel has no triangles. Coordinates are below 2 ** 20. A volume thinner than
    two voxels has no surface. Only rows of ``kinds`` are made.
    """
    brick = _joined(brick)
    rows = vox.select("z", "y", "x", "v")
    for name, home, side in zip("zyx", ("bz", "by", "bx"), brick, strict=True):
        rows = rows.withColumn(home, F.explode(_homes(name, side)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        origin = tuple(int(k) * s for k, s in zip(key, brick, strict=True))
        at = [part[c].to_numpy() - o for c, o in zip("zyx", origin, strict=True)]
        shape = [int(k.max()) + 1 for k in at]
        a, present = np.zeros(shape), np.zeros(shape, bool)
        a[*at], present[*at] = part["v"], True
        return _surface(a, None if present.all() else present, iso, origin, brick, kinds)

    return _spread(rows, "bz", "by", "bx").groupBy("bz", "by", "bx").applyInPandas(run, SURFACE)


def tiles(slices: DataFrame, brick: tuple[int, int, int] = BRICK) -> DataFrame:
    """Images cut into the parts that bricks hold: rows of ``TILE``, a part's bytes instead of its voxels.

    Slices without pixels give none.
    """
    _, tall, wide = brick

    def cut(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                image = np.frombuffer(r.pixels, f"<u{int(r.bit_depth) // 8}").reshape(int(r.height), int(r.width))
                for y0 in range(0, max(1, image.shape[0] - 1), tall):
                    for x0 in range(0, max(1, image.shape[1] - 1), wide):
                        part = image[y0 : y0 + tall + 1, x0 : x0 + wide + 1]
                        out.append((r.stack_id, int(r.bz), y0 // tall, x0 // wide, int(r.z), y0, x0, *part.shape, int(r.bit_depth), part.tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TILE.split(", ")])

    rows = slices.filter("pixels is not null").select("stack_id", "z", "width", "height", "bit_depth", "pixels", F.explode(_homes("z", brick[0])).alias("bz"))
    return rows.mapInPandas(cut, TILE)


def surface_of_slices(slices: DataFrame, iso: float, brick: tuple[int, int, int] = BRICK, kinds: str = "vt") -> DataFrame:
    """The iso-surfaces of stacks in slice form: stack_id and the columns of ``SURFACE``.

    Only tiles are shuffled, as bytes. Slices that are absent leave the cells beside them empty, as do
    rows and columns that a smaller image lacks. Only rows of ``kinds`` are made.
    """
    brick = _joined(brick)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        origin = tuple(int(k) * s for k, s in zip(key[1:], brick, strict=True))
        shape = (int(part["z"].max()) - origin[0] + 1, int(part["height"].max()), int(part["width"].max()))
        a, present = np.zeros(shape), np.zeros(shape, bool)
        for r in part.itertuples():
            place = (int(r.z) - origin[0], slice(int(r.height)), slice(int(r.width)))
            a[place] = np.frombuffer(r.pixels, f"<u{int(r.bit_depth) // 8}").reshape(int(r.height), int(r.width))
            present[place] = True
        found = _surface(a, None if present.all() else present, iso, origin, brick, kinds)
        found.insert(0, "stack_id", key[0])
        return found

    by = ["stack_id", "bz", "by", "bx"]
    return _spread(tiles(slices, brick), *by).groupBy(*by).applyInPandas(run, f"stack_id string, {SURFACE}")


def vertices(rows: DataFrame) -> DataFrame:
    """vid, v0, v1, v2 and the unit normal n0, n1, n2 of each vertex (z, y, x); by stack where there are stacks.

    Vertices inside a brick are complete there; those on faces add up what their bricks know. All go
    through one aggregate: two ways for the two kinds would make the surface twice.
    """
    by = [c for c in rows.columns if c == "stack_id"]
    found = rows.filter("kind = 'v'").withColumnRenamed("id", "vid")
    merged = found.groupBy(*by, "vid").agg(*[F.min(f"v{i}").alias(f"v{i}") for i in range(3)], *[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)])
    return merged.select(*by, "vid", *[f"v{i}" for i in range(3)], *_unit([F.col(f"n{i}") for i in range(3)]))


def triangles(rows: DataFrame) -> DataFrame:
    """tid, a, b, c (the vids of its corners) and the unit normal of each triangle; by stack where there are stacks.

    A tid packs the place of the triangle's cell and its number there, so it does not depend on bricks.
    """
    by = [c for c in rows.columns if c == "stack_id"]
    return rows.filter("kind = 't'").select(*by, F.col("id").alias("tid"), "a", "b", "c", "n0", "n1", "n2")
