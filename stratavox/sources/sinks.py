"""Writing slices, stacks and meshes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import encode_tiff


def write_levels(slices: DataFrame, path: str, mode: str = "append") -> None:
    """Slices as Parquet, one folder per level; within it by z, so that z ranges prune."""
    slices.repartitionByRange("level", "z").sortWithinPartitions("level", "z").write.mode(mode).partitionBy("level").parquet(path)


def level_path(base: str, level: int, index: int) -> str:
    return f"{base}/.thumbnail/{level}/{index:06d}.tif"


def encoded(slices: DataFrame, deflate: bool = False) -> DataFrame:
    """``slices`` with the TIFF bytes of each image as ``content``; null where the pixels are null."""

    @F.pandas_udf("binary")
    def run(pixels: pd.Series, width: pd.Series, height: pd.Series, depth: pd.Series) -> pd.Series:
        make = lambda p, w, h, d: None if p is None else encode_tiff(np.frombuffer(p, f"<u{int(d) // 8}").reshape(int(h), int(w)), deflate)
        return pd.Series([make(*r) for r in zip(pixels, width, height, depth, strict=True)], dtype=object)

    return slices.withColumn("content", run("pixels", "width", "height", "bit_depth"))


def cropped_slices(slices: DataFrame, z_first: int, z_last: int, box: tuple[int, int, int, int] | None) -> DataFrame:
    """Slices z_first to z_last, both included, cropped to the half-open box (x1, y1, x2, y2), or whole."""
    rows = slices.filter(F.col("z").between(z_first, z_last))
    if box is None:
        return rows
    x1, y1, x2, y2 = box
    size = F.col("bit_depth") / 8
    lines = F.transform(F.sequence(F.lit(y1), F.lit(y2 - 1)), lambda y: F.substring("pixels", ((y * F.col("width") + x1) * size).cast("int") + 1, (F.lit(x2 - x1) * size).cast("int")))
    joined = F.aggregate(lines, F.lit(b""), lambda a, b: F.concat(a, b))
    # The pixels need the old width, so they come first.
    return rows.withColumn("pixels", joined).withColumns({"width": F.lit(x2 - x1), "height": F.lit(y2 - y1)})


def export_stack(slices: DataFrame, path: str, name: Column, deflate: bool = False) -> DataFrame:
    """Write each slice as a TIFF file ``name`` below ``path``; one row per slice: name, error.

    Tasks write through pyarrow's file systems, so ``path`` may be any URI that these open. A slice
    that fails gets its error, and the others go on. Run it by an action on the result.
    """
    rows = encoded(slices.withColumn("name", name), deflate).select("name", "content")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        system.create_dir(base)
        for batch in batches:
            errors = []
            for file, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    if content is None:
                        raise ValueError("no pixels")
                    temporary = f"{base}/.{file}.part"
                    with system.open_output_stream(temporary) as out:
                        out.write(bytes(content))
                    system.move(temporary, f"{base}/{file}")
                    errors.append(None)
                except (OSError, ValueError) as failed:
                    errors.append(str(failed))
            yield pd.DataFrame({"name": batch["name"], "error": pd.Series(errors, dtype=object)})

    return rows.mapInPandas(write, "name string, error string")


def obj_lines(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """ord and line of an OBJ text: vertices with axes turned (v0, v1, v2) to (v2, v0, v1), then faces from 1.

    ``vertices``: vid, v0, v1, v2, numbered from 0 without gaps; ``triangles``: tid, a, b, c.
    """
    v = vertices.select(F.struct(F.lit(0).alias("part"), F.col("vid").alias("at")).alias("ord"), F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in ("v2", "v0", "v1")]).alias("line"))
    f = triangles.select(F.struct(F.lit(1).alias("part"), F.col("tid").alias("at")).alias("ord"), F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in ("a", "b", "c")]).alias("line"))
    return v.unionByName(f)


def export_mesh(corners: DataFrame, path: str) -> None:
    """The triangles of ``mesh.marching_cubes`` as an OBJ text in folder ``path``."""
    from ..operators import mesh

    write_obj(*mesh.dense(*mesh.indexed(corners)), path)


def delete_levels(spark: SparkSession, path: str) -> bool:
    """Delete a written pyramid; false where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_obj(vertices: DataFrame, triangles: DataFrame, path: str) -> None:
    """The OBJ text as one file in folder ``path``; the commit protocol makes it appear whole."""
    obj_lines(vertices, triangles).orderBy("ord").coalesce(1).select("line").write.mode("overwrite").text(path)
