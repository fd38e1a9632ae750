"""Scalar column functions: names, texts of sizes and times, pixel arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern of a numbered file name: prefix, digits, extension (ASCII digits and letters).
SEQUENCE_PATTERN = r"^(.*?)([0-9]+)\.([A-Za-z0-9_]+)$"
#: The stricter form: the prefix has at least one character, the extension letters only.
STRICT_PATTERN = r"^(.+?)([0-9]+)\.([A-Za-z]+)$"


def name_parts(name: Column, pattern: str = SEQUENCE_PATTERN) -> dict[str, Column]:
    """prefix, digits, number and lower-case extension of a file name; null where it has another form."""
    ok = name.rlike(pattern)
    part = lambda i: F.when(ok, F.regexp_extract(name, pattern, i))
    return {"prefix": part(1), "digits": part(2), "number": part(2).try_cast("bigint"), "ext": F.lower(part(3))}


def sequence_name(prefix: Column, index: Column, width: Column, ext: Column, fixed: bool = False) -> Column:
    """prefix, index padded with zeros to ``width``, dot, extension.

    Wider numbers are not cut; names of ``fixed`` width keep their first digits only.
    """
    digits = index.cast("string")
    padded = F.lpad(digits, width, F.lit("0"))
    return F.concat(prefix, padded if fixed else F.when(F.length(digits) < width, padded).otherwise(digits), F.lit("."), ext)


def level_file_name(index: Column, fixed: bool = False) -> Column:
    """Name of a pyramid slice: six digits; wider numbers as in ``sequence_name``."""
    return sequence_name(F.lit(""), index, F.lit(6), F.lit("tif"), fixed)


def pair_names(prefix: Column, index: Column, end: Column, width: Column, ext: Column, level: Column, fixed: bool = False) -> dict[str, Column]:
    """Source names of a slice and the one after it; null past the end. Levels above 0 use pyramid names."""
    make = lambda i: F.when(level >= 1, level_file_name(i, fixed)).otherwise(sequence_name(prefix, i, width, ext, fixed))
    return {"first": make(index), "second": F.when(index + 1 <= end, make(index + 1))}


def fixed(x: Column, places: int) -> Column:
    """Text of a non-negative double below 2^40 with ``places`` decimals, halves of the exact value to even.

    Formatters of the JVM round the shortest decimal form, halves up. Here the product with 10^places
    is taken in two exact parts, so that what lies on either side of a half is told apart.
    """
    ten = float(10**places)
    high = x.cast("float").cast("double")
    product = x * ten
    whole = F.floor(product)
    rest = product - whole
    error = (high * ten - product) + (x - high) * ten
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(n / ten).cast("string"), F.lit("."), F.lpad((n % int(ten)).cast("string"), places, "0"))


def file_size_text(n: Column) -> Column:
    """Two decimals and a unit, base 1024, from B to PB."""
    x = n.cast("double")
    out = F.concat(fixed(x / float(1024**5), 2), F.lit(" PB"))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(x < float(1024 ** (power + 1)), F.concat(fixed(x / float(1024**power), 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    """0s below zero; one decimal of seconds or minutes; whole hours and minutes."""
    s = seconds.cast("double")
    hours, minutes = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600.0)) / 60)
    long_ = F.when(minutes > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(F.format_string("%dh", hours))
    tenths = lambda x, unit: F.concat(fixed(x, 1), F.lit(unit))
    return F.when(s < 0, F.lit("0s")).when(s < 60, tenths(s, "s")).when(s < 3600, tenths(s / 60, "m")).otherwise(long_)


def eta_text(seconds: Column) -> Column:
    """Whole units, truncated; null reads as still being calculated."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = lambda x: F.floor(x)
    minutes = F.format_string("%dm %ds", whole(s / 60), whole(F.pmod(s, F.lit(60.0))))
    hours = F.format_string("%dh %dm", whole(s / 3600), whole(F.pmod(s, F.lit(3600.0)) / 60))
    return F.when(seconds.isNull(), F.lit("Calculating...")).when(s < 60, F.format_string("%ds", whole(s))).when(s < 3600, minutes).otherwise(hours)


def detail_text(level: Column, done: Column, total: Column) -> Column:
    return F.format_string("Level %d: %d/%d", level, done, total)


def is_true(text: Column) -> Column:
    """True for the word true in any case, false for every other text, null for null."""
    return F.lower(text) == "true"


def storage_class(speed: Column) -> Column:
    """Class of a storage by images a second."""
    return F.when(speed.isNull(), "Unknown").when(speed > 10, "SSD").when(speed > 2, "HDD").otherwise("Network/Slow")


def mean_of_two(a: Column, b: Column, floating: bool = False) -> Column:
    """Floor of the mean; for floating values the same floor, kept as a double."""
    if floating:
        return F.floor((a.cast("double") + b.cast("double")) / 2).cast("double")
    return F.call_function("div", a.cast("bigint") + b.cast("bigint"), F.lit(2)).cast("int")


def div(a: Column, b: int | Column) -> Column:
    """Integer quotient of non-negative integers."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def widen(v: Column) -> Column:
    return F.shiftleft(v, 8)


def narrow(v: Column) -> Column:
    return F.shiftright(v, 8)


def histogram_scale(v: Column, type_max: int) -> Column:
    """An integer intensity on 0 to 255 by its type's range, truncated."""
    return v if type_max == 255 else F.floor(v * 255.0 / float(type_max)).cast("int")


def display_scale(v: Column, type_max: int) -> Column:
    """An integer intensity on 0 to 255 for display: 16-bit values lose their low byte."""
    return v if type_max == 255 else div(v, 256).cast("int")


def stretch_to_8bit(v: Column, low: Column, high: Column) -> Column:
    """Floating values by their range, truncated; 0 where the range is empty."""
    return F.when(high > low, F.floor((v - low) * 255.0 / (high - low)).cast("int")).otherwise(F.lit(0))


def threshold_on_type(t: Column, type_max: int) -> Column:
    """An 8-bit threshold on the scale of the volume's type."""
    return t.cast("double") if type_max == 255 else t * float(type_max) / 255.0


def inverted(v: Column) -> Column:
    return F.lit(255) - v


def threshold_paint(v: Column, x: Column, y: Column, t: int, color: int, region: tuple[int, int, int, int] | None = None, inverse: bool = False) -> Column:
    """``color`` where a pixel passes the threshold within the region (inclusive); the pixel elsewhere."""
    if not 0 <= t <= 255:
        raise ValueError("a threshold lies in 0 to 255")
    hit = v <= t if inverse else v > t
    if region is not None:
        x1, y1, x2, y2 = region
        hit = hit & x.between(x1, x2) & y.between(y1, y2)
    return F.when(hit, F.lit(color)).otherwise(v)
