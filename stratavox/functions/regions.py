"""Regions of interest, slice ranges and coordinates, as column arithmetic.

Half-open bounds carry ``end`` in their names, inclusive ones ``last``. An unset region is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: Column | int, high: Column | int) -> Column:
    as_col = lambda c: F.lit(c) if isinstance(c, int) else c
    return F.greatest(as_col(low), F.least(v, as_col(high)))


def clamp_indices(bottom: Column, top: Column, n: Column) -> tuple[Column, Column]:
    """bottom within 0 to n-1, top within 0 to n and above bottom."""
    b = clamp(bottom, 0, n - 1)
    t = clamp(top, 0, n)
    return b, F.when(t <= b, F.least(b + 1, n)).otherwise(t)


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Column, ...]:
    a, b = clamp(x1, 0, width - 1), clamp(y1, 0, height - 1)
    return a, b, F.greatest(a + 1, F.least(x2, width)), F.greatest(b + 1, F.least(y2, height))


def cropped_dimensions(bottom: Column, top_last: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """depth (both ends count), height, width."""
    return top_last - bottom + 1, y2 - y1, x2 - x1


def contains(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Within the region, ends included; false where it is unset."""
    return F.coalesce(x.between(x1, x2) & y.between(y1, y2), F.lit(False))


def is_full_or_unset(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    return x1.isNull() | ((x1 == 0) & (y1 == 0) & (x2 == width) & (y2 == height))


def from_corners(ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, ...]:
    """x1, y1, x2, y2 of a box dragged in any direction."""
    return F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)


def from_fractions(f: Column, extent: Column) -> Column:
    """A position from its fraction of the extent, halves to even."""
    return F.bround(f * extent, 0).cast("int")


def or_full(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """The region, or the whole image where it is unset."""
    return F.coalesce(x1, F.lit(0)), F.coalesce(y1, F.lit(0)), F.coalesce(x2, width), F.coalesce(y2, height)


def hit_edges(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column, reach: int) -> dict[str, Column]:
    """Which edges a point is near to, and whether it is inside and near to none."""
    near = lambda a, b: F.abs(a - b) <= reach
    in_y, in_x = y.between(y1 - reach, y2 + reach), x.between(x1 - reach, x2 + reach)
    edges = {"left": near(x, x1) & in_y, "right": near(x, x2) & in_y, "top": near(y, y1) & in_x, "bottom": near(y, y2) & in_x}
    none = ~(edges["left"] | edges["right"] | edges["top"] | edges["bottom"])
    return edges | {"inside": none & contains(x, y, x1, y1, x2, y2)}


def moved(x1: Column, y1: Column, x2: Column, y2: Column, dx: Column, dy: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """The box moved as a whole, kept within the image."""
    sx = clamp(dx, -x1, width - x2)
    sy = clamp(dy, -y1, height - y2)
    return x1 + sx, y1 + sy, x2 + sx, y2 + sy


def edge_moved(x1: Column, y1: Column, x2: Column, y2: Column, edges: dict[str, Column], dx: Column, dy: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """The box with the held edges (left, right, top, bottom) moved, within the image and its corners in order."""
    by = lambda v, edge, d, last: clamp(v + F.when(edges[edge], d).otherwise(0), 0, last)
    return from_corners(by(x1, "left", dx, width), by(y1, "top", dy, height), by(x2, "right", dx, width), by(y2, "bottom", dy, height))


def image_to_canvas(v: Column, scale: Column) -> Column:
    return F.bround(v / scale, 0).cast("int")


def canvas_to_image(v: Column, scale: Column) -> Column:
    return F.bround(v * scale, 0).cast("int")


def fit_ratio(w: Column, h: Column, view_w: Column, view_h: Column) -> Column:
    """Image pixels per view pixel when the image is made to fit."""
    return F.when(w / h > view_w / view_h, w / view_w).otherwise(h / view_h)


def coerced_range(low: Column, high: Column, lower: Column, current: Column, upper: Column) -> tuple[Column, Column, Column]:
    """lower, current, upper within the (swapped if need be) range, lower not above upper."""
    lo, hi = F.least(low, high), F.greatest(low, high)
    a, b = clamp(lower, lo, hi), clamp(upper, lo, hi)
    return F.least(a, b), clamp(current, lo, hi), F.greatest(a, b)


def shifted_range(lower: Column, upper: Column, by: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Both bounds moved, their distance kept, within the range."""
    s = clamp(by, low - lower, high - upper)
    return lower + s, upper + s


def switch_level(index: Column, from_level: Column, to_level: Column, count: Column) -> Column:
    """A slice index on another level: scaled, truncated, clamped."""
    return clamp(F.floor(index * F.pow(F.lit(2.0), from_level - to_level)).cast("int"), 0, count - 1)


def scale_between_levels(c: Column, from_level: Column, to_level: Column) -> Column:
    return c * F.pow(F.lit(2.0), from_level - to_level)


def normalised(c: Column, extent: Column) -> Column:
    return F.when(extent > 0, c / extent).otherwise(F.lit(0.0))


def denormalised(f: Column, extent: Column) -> Column:
    """Truncated towards zero."""
    return (f * extent).cast("bigint")


def coverage(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def value_to_track(v: Column, low: Column, high: Column, length: Column) -> Column:
    """Place on a track whose top is the highest value."""
    return F.bround((high - v) * length / (high - low), 0).cast("int")


def track_to_value(p: Column, low: Column, high: Column, length: Column) -> Column:
    return clamp(F.bround(high - p * (high - low) / length, 0).cast("int"), low, high)


def slice_stack_megabytes(bottom: Column, top_last: Column, w: Column, h: Column) -> Column:
    """Size of a range of slices at one byte a pixel, two decimals, halves to even."""
    return F.bround((top_last - bottom + 1).cast("double") * w * h / 1048576.0, 2)


def level_bounding_box(depth: Column, height: Column, width: Column, levels: Column) -> list[Column]:
    s = F.pow(F.lit(2.0), levels)
    last = lambda d: (d * s - 1).cast("bigint")
    return [F.lit(0), last(depth), F.lit(0), last(height), F.lit(0), last(width)]


def slice_plane(current: Column, last: Column, depth: Column) -> Column:
    """Height of the plane of a slice in a volume of that depth; 0 where there is one slice only."""
    return F.when(last > 0, current / last * depth).otherwise(F.lit(0.0))


def middle(low: Column, high: Column) -> Column:
    """What a box is displaced by along an axis: its middle."""
    return (low + high) / 2.0


def recentred(c: Column, low: Column, high: Column, longest: Column) -> Column:
    """A box coordinate scaled to 50 units of the longest side, a tenth of that, around the middle."""
    s = 50.0 / longest / 10.0
    return (c - (low + high) / 2.0) * s


def box_corners(z0: Column, z1: Column, y0: Column, y1: Column, x0: Column, x1: Column) -> Column:
    """array of the eight corners (z, y, x), x fastest."""
    return F.array(*[F.struct(z.alias("z"), y.alias("y"), x.alias("x")) for z in (z0, z1) for y in (y0, y1) for x in (x0, x1)])


#: The twelve edges of a box as pairs of corners that differ in one coordinate.
BOX_EDGES = tuple((a, a | 1 << k) for k in range(3) for a in range(8) if not a >> k & 1)
