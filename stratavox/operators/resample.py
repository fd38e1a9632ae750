"""Linear resampling of stacks in slice form: rows and columns inside an image, then pairs of images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mesh import contributions
from .pyramid import SCHEMA


def _resized(image: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """An image at ``size`` (rows, columns) as doubles; ends stay at ends, places between are linear."""
    out = image.astype(float)
    for axis, m in enumerate(size):
        n = out.shape[axis]
        at = np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0)
        low = np.clip(at.astype(int), 0, max(n - 2, 0))
        f = (at - low).reshape([-1 if k == axis else 1 for k in range(2)])
        out = out.take(low, axis) * (1 - f) + out.take(np.minimum(low + 1, n - 1), axis) * f
    return out


def zoom_slices(slices: DataFrame, scale: float) -> DataFrame:
    """Stacks resampled by ``scale`` along all axes, as slices with the columns of ``pyramid.SCHEMA``.

    A side of n becomes floor(n ``scale`` + 1/2), 1 at least; place i lies at i (n - 1) / (out - 1). An
    image is resized once, by a vectorised kernel and without a shuffle, and goes to the images that it
    takes part in; those add up two images at most. Values are rounded halves up at the end only. Images
    that no place needs, and slices without pixels, are left out before they are resized.
    """
    size = lambda n: F.greatest(F.floor(n * scale + 0.5), F.lit(1)).cast("int")
    depth = slices.groupBy("stack_id", "level").agg((F.max("z") + 1).alias("__n"))
    rows = slices.filter("pixels is not null").join(depth, ["stack_id", "level"])
    rows = rows.withColumn("__to", contributions(F.col("z"), F.col("__n"), size(F.col("__n")))).filter(F.size("__to") > 0)

    @F.pandas_udf("binary")
    def resized(pixels: pd.Series, width: pd.Series, height: pd.Series, depth: pd.Series, out_width: pd.Series, out_height: pd.Series) -> pd.Series:
        make = lambda p, w, h, d, ow, oh: _resized(np.frombuffer(p, f"<u{int(d) // 8}").reshape(int(h), int(w)), (int(oh), int(ow))).tobytes()
        return pd.Series([make(*r) for r in zip(pixels, width, height, depth, out_width, out_height, strict=True)], dtype=object)

    rows = rows.withColumns({"__w": size(F.col("width")), "__h": size(F.col("height"))})
    rows = rows.withColumn("__image", resized("pixels", "width", "height", "bit_depth", "__w", "__h"))
    rows = rows.select("stack_id", "level", "bit_depth", "__w", "__h", "__image", F.explode("__to").alias("to"))
    rows = rows.select("stack_id", "level", "bit_depth", "__w", "__h", "__image", F.col("to.o").alias("z"), F.col("to.w").alias("weight"))

    def mixed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        total = sum(r.weight * np.frombuffer(r.image, float) for r in part.rename(columns={"__image": "image"}).sort_values("weight").itertuples())
        depth = int(part["bit_depth"].max())
        pixels = np.floor(np.round(total, 9) + 0.5).astype(f"<u{depth // 8}").tobytes()
        return pd.DataFrame({"stack_id": [key[0]], "level": [key[1]], "z": [key[2]], "width": [part["__w"].iloc[0]], "height": [part["__h"].iloc[0]], "bit_depth": [depth], "pixels": [pixels]})

    return rows.groupBy("stack_id", "level", "z").applyInPandas(mixed, SCHEMA)
