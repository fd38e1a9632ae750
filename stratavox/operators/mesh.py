"""Iso-surfaces: resampling, marching cubes, normals."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Longest side of the resampled volume.
LONGEST = 50


def zoom_size(n: int, scale: float) -> int:
    return max(1, int(np.floor(n * scale + 0.5)))


def contributions(place: Column, n: Column | int, m: Column | int) -> Column:
    """The places o of ``m`` that a ``place`` of ``n`` takes part in, with its weight w there: an array of structs.

    Place o lies at o (n - 1) / (m - 1); its two neighbours weigh 1 less their distance.
    """
    n, m = (k if isinstance(k, Column) else F.lit(k) for k in (n, m))
    step = F.when(m > 1, (n - 1) / F.greatest(m - 1, F.lit(1))).otherwise(F.lit(0.0))
    low = F.when(step > 0, F.greatest(F.floor((place - 1) / step), F.lit(0))).otherwise(F.lit(0))
    high = F.when(step > 0, F.least(F.ceil((place + 1) / step), m - 1)).otherwise(m - 1)
    near = F.transform(F.sequence(low.cast("int"), F.greatest(high, low).cast("int")), lambda o: F.struct(o.alias("o"), (1 - F.abs(o * step - place)).alias("w")))
    return F.filter(near, lambda x: (x["w"] > 0) & (x["o"] < m))


def trilinear(vox: DataFrame, shape: tuple[int, int, int], out: tuple[int, int, int]) -> DataFrame:
    """The volume resampled to ``out`` (depth, height, width): z, y, x, v, halves up.

    Each voxel goes to the places that it takes part in, and their weighted sum is one aggregate, begun
    before the shuffle; nothing is joined. ``resample.zoom_slices`` does the same on whole images.
    """
    rows = vox.select("z", "y", "x", "v")
    for name, n, m in zip("zyx", shape, out, strict=True):
        rows = rows.withColumn(f"o{name}", F.explode(contributions(F.col(name), n, m)))
    weight = F.col("oz.w") * F.col("oy.w") * F.col("ox.w")
    value = F.floor(F.round(F.sum(weight * F.col("v")), 9) + 0.5).cast("int")
    return rows.groupBy(F.col("oz.o").alias("z"), F.col("oy.o").alias("y"), F.col("ox.o").alias("x")).agg(value.alias("v"))


def resampled(vox: DataFrame, shape: tuple[int, int, int], longest: int = LONGEST) -> tuple[DataFrame, tuple[int, int, int]]:
    """The volume scaled so that its longest side is ``longest``, and its shape."""
    scale = longest / max(shape)
    out = tuple(zoom_size(n, scale) for n in shape)
    return trilinear(vox, shape, out), out


@cache
def case_table() -> tuple[np.ndarray, np.ndarray]:
    """Edges of the triangles of all 256 sign cases, flat in threes, and the start of each case.

    Corner c lies at (z, y, x) = (c >> 2, c >> 1 & 1, c & 1). An edge is 3 * corner + axis, from the
    corner with the lower coordinate along the axis (0 z, 1 y, 2 x). The table is made by rule: on
    each face, walking around it, every entry into the inside is joined to the next exit, which
    keeps inside corners apart on ambiguous faces in the same way from both sides. The segments
    chain to loops, and a loop is a fan of triangles with the inside behind it.
    """
    bit = {0: 4, 1: 2, 2: 1}

    def edge(a: int, b: int) -> int:
        axis = next(k for k in bit if a ^ b == bit[k])
        return 3 * min(a, b) + axis

    faces = []
    for axis in range(3):
        u, v = [bit[k] for k in range(3) if k != axis]
        for side in (0, 1):
            base = bit[axis] * side
            ring = [base, base + u, base + u + v, base + v]
            # Corners turn the same way as seen from outside on every face.
            flip = (side == 0) ^ (axis == 1)
            faces.append(ring[::-1] if flip else ring)
    flat, starts = [], [0]
    for case in range(256):
        inside = [bool(case >> c & 1) for c in range(8)]
        step = {}
        for ring in faces:
            for i in range(4):
                a, b = ring[i], ring[(i + 1) % 4]
                if inside[a] and not inside[b]:
                    # An exit; the entry that led in lies before it.
                    j = i
                    while inside[ring[j % 4]]:
                        j -= 1
                    step[edge(a, b)] = edge(ring[j % 4], ring[(j + 1) % 4])
        while step:
            start, at = next(iter(step.items()))
            loop = [start]
            del step[start]
            while at != start:
                loop.append(at)
                at = step.pop(at)
            for i in range(1, len(loop) - 1):
                flat += [loop[0], loop[i + 1], loop[i]]
        starts.append(len(flat) // 3)
    return np.array(flat, np.int64).reshape(-1, 3), np.array(starts, np.int64)


def march_cells(a: np.ndarray, iso: float, origin: tuple[int, int, int] = (0, 0, 0), present: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triangles of a dense block at ``iso``: edge keys (n, 3) of their corners, ids (n) and positions (n, 3, zyx).

    A key packs the (z, y, x, axis) of an edge in the volume by 20 bits a coordinate and an id that of
    its cell and its number there, so blocks that share voxels agree on them. ``present`` marks the
    voxels that there are; a cell that lacks one has no triangles.
    """
    table, starts = case_table()
    d, h, w = (n - 1 for n in a.shape)
    if min(d, h, w) < 1:
        return np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros((0, 3, 3))
    inside = a > iso
    case, whole = np.zeros((d, h, w), np.int64), np.ones((d, h, w), bool)
    for c in range(8):
        corner = np.s_[c >> 2 : (c >> 2) + d, c >> 1 & 1 : (c >> 1 & 1) + h, c & 1 : (c & 1) + w]
        case |= inside[corner].astype(np.int64) << c
        if present is not None:
            whole &= present[corner]
    cells = np.flatnonzero((case > 0) & (case < 255) & whole)
    n = starts[case.ravel()[cells] + 1] - starts[case.ravel()[cells]]
    cell = np.repeat(cells, n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    edges = table[number + np.repeat(starts[case.ravel()[cells]], n)]
    at = np.unravel_index(cell, case.shape)
    corner, axis = edges // 3, edges % 3
    z, y, x = (k[:, None] + (corner >> s & 1) for k, s in zip(at, (2, 1, 0), strict=True))
    v0 = a[z, y, x].astype(float)
    v1 = a[z + (axis == 0), y + (axis == 1), x + (axis == 2)].astype(float)
    t = (iso - v0) / (v1 - v0)
    z, y, x = z + origin[0], y + origin[1], x + origin[2]
    keys = ((z << 40 | y << 20 | x) << 2) | axis
    ids = ((at[0] + origin[0]) << 40 | (at[1] + origin[1]) << 20 | (at[2] + origin[2])) << 3 | number
    return keys, ids, np.stack([z + t * (axis == 0), y + t * (axis == 1), x + t * (axis == 2)], 2)


def march(a: np.ndarray, iso: float, z0: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triangles of a dense block whose first slice is ``z0``: keys (n, 3) and z, y, x positions (n, 3) each."""
    keys, _, p = march_cells(a, iso, (z0, 0, 0))
    return keys, p[..., 0], p[..., 1], p[..., 2]


def marching_cubes(vox: DataFrame, shape: tuple[int, int, int], iso: float, slab: int = 16, side: int = 64) -> DataFrame:
    """Corners (tid, corner, key, v0, v1, v2) of the triangles of the iso-surface; v0, v1, v2 are z, y, x.

    Bricks of ``slab`` slices and ``side`` rows and columns are independent tasks. Equal keys are one
    vertex. ``shape`` is not needed any more and not looked at: voxels that are absent have no surface.
    """
    from . import bricks

    rows = bricks.surface(vox, iso, (slab, side, side))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("corner"), F.col(k).alias("key")) for i, k in enumerate("abc")]))
    faces = bricks.triangles(rows).select("tid", at.alias("at")).select("tid", "at.corner", "at.key")
    return faces.join(bricks.vertices(rows).select(F.col("vid").alias("key"), "v0", "v1", "v2"), "key").select("tid", "corner", "key", "v0", "v1", "v2")


def indexed(corners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vertices (vid, v0, v1, v2) and triangles (tid, a, b, c) of ``marching_cubes``; vids are edge keys."""
    vertices = corners.groupBy(F.col("key").alias("vid")).agg(*[F.min(c).alias(c) for c in ("v0", "v1", "v2")])
    pick = lambda k: F.max(F.when(F.col("corner") == k, F.col("key")))
    triangles = corners.groupBy("tid").agg(pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("c"))
    return vertices, triangles


def dense(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same mesh with vertices numbered from 0 without gaps, in order of their keys.

    Keys hold the slice and row of their edge. A vertex's number is the vertices of the slices
    before, those of the rows before and its rank in its row, so a task orders one row of voxels,
    the rows of a slice, or the slices of the volume. Triangles whose corners are unknown go.
    """
    line, z = F.shiftright("vid", 22), F.shiftright("vid", 42)
    lines = vertices.groupBy(line.alias("__line"), z.alias("__z")).agg(F.count("*").alias("__n"))
    slices = lines.groupBy("__z").agg(F.sum("__n").alias("__m"))
    slices = slices.withColumn("__from", F.sum("__m").over(Window.orderBy("__z")) - F.col("__m"))
    lines = lines.withColumn("__n", F.sum("__n").over(Window.partitionBy("__z").orderBy("__line")) - F.col("__n"))
    starts = lines.join(slices, "__z").select("__line", (F.col("__from") + F.col("__n")).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("__line").orderBy("vid")) - 1
    found = vertices.withColumn("__line", line).withColumn("__rank", rank).join(starts, "__line").withColumn("__id", F.col("__start") + F.col("__rank"))
    numbers = found.select("vid", "__id")
    for k in "abc":
        triangles = triangles.join(numbers.withColumnRenamed("vid", k), k).drop(k).withColumnRenamed("__id", k)
    return found.select(F.col("__id").alias("vid"), "v0", "v1", "v2"), triangles.select("tid", "a", "b", "c")


def triangle_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """tid, a, b, c and the unit normal n0, n1, n2 of each triangle; 0 where it has no area."""
    rows = triangles
    for k in "abc":
        own = vertices.select(F.col("vid").alias(k), *[F.col(f"v{i}").cast("double").alias(f"{k}{i}") for i in range(3)])
        rows = rows.join(own, k)
    side = lambda p, i: F.col(f"{p}{i}") - F.col(f"a{i}")
    cross = [side("b", (i + 1) % 3) * side("c", (i + 2) % 3) - side("b", (i + 2) % 3) * side("c", (i + 1) % 3) for i in range(3)]
    rows = rows.select("tid", "a", "b", "c", *[c.alias(f"c{i}") for i, c in enumerate(cross)])
    return rows.select("tid", "a", "b", "c", *_unit([F.col(f"c{i}") for i in range(3)]))


def _unit(v: list) -> list:
    length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return [F.when(length > 0, c / length).otherwise(F.lit(0.0)).alias(f"n{i}") for i, c in enumerate(v)]


def vertex_normals(normals: DataFrame) -> DataFrame:
    """vid and unit normal: the sum of the unit normals of its triangles."""
    rows = normals.select(F.explode(F.array("a", "b", "c")).alias("vid"), "n0", "n1", "n2")
    rows = rows.groupBy("vid").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(3)])
    return rows.select("vid", *_unit([F.col(f"s{i}") for i in range(3)]))


def adjusted(vertices: DataFrame, displacement: tuple[float, float, float], factor: float = 10.0) -> DataFrame:
    """``vertices`` for display: divided by ``factor``, moved by -``displacement``, axes turned (v0, v1, v2) to (v2, v0, v1), normals too."""
    turn = (2, 0, 1)
    out = {f"v{i}": F.col(f"v{k}") / factor - displacement[k] for i, k in enumerate(turn)}
    out |= {f"n{i}": F.col(f"n{k}") for i, k in enumerate(turn) if f"n{k}" in vertices.columns}
    return vertices.withColumns(out)
