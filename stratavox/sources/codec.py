"""Decoding and encoding of grey images with the standard library and numpy.

PNG (8 and 16 bits, grey, RGB, with or without alpha, palette), baseline TIFF (uncompressed and deflate, any number of
strips) and BMP (8, 24, 32 bits). Colour becomes luma in the depth of the file. 8-bit JPEG is read
by Spark's own ``image`` source (``read_jpeg``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_SCHEMA = "width int, height int, bit_depth int, pixels binary, error string"
#: Fixed luma weights, in ten-thousandths.
LUMA = (2126, 7152, 722)


class ImageError(ValueError):
    """Bytes that are no image of a supported kind."""


def _luma(a: np.ndarray) -> np.ndarray:
    """Grey of an array of pixels with 1 to 4 samples, in its own depth."""
    if a.ndim == 2:
        return a
    if a.shape[2] < 3:
        return a[:, :, 0]
    c = a[:, :, :3].astype(np.uint32)
    return ((c[:, :, 0] * LUMA[0] + c[:, :, 1] * LUMA[1] + c[:, :, 2] * LUMA[2]) // 10_000).astype(a.dtype)


def _png(data: bytes) -> np.ndarray:
    at, body, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    if head is None:
        raise ImageError("PNG without header")
    w, h, depth, colour, _, _, interlace = head
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if samples is None or interlace or depth not in (8, 16):
        raise ImageError("unsupported kind of PNG")
    step = samples * depth // 8
    stride = w * step
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 1:
            line = line.reshape(w, step).cumsum(0).reshape(-1) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            for i in range(stride):
                a = line[i - step] if i >= step else 0
                b, c = above[i], above[i - step] if i >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda q: abs(p - q))
                line[i] = (line[i] + guess) & 255
        above = line
        out[y] = line
    if depth == 16:
        pixels = out.reshape(-1).view(">u2").astype(np.uint16).reshape(h, w, samples)
    else:
        pixels = out.reshape(h, w, samples)
    if colour == 3:
        return _luma(palette[pixels[:, :, 0]])
    return pixels[:, :, 0] if samples < 3 else _luma(pixels)


def _tiff_tags(data: bytes) -> tuple[str, dict[int, list]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ImageError("no TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code is None:
            continue
        size = n * struct.calcsize(code)
        place = at + 10 + 12 * i
        start = place if size <= 4 else struct.unpack(order + "I", data[place : place + 4])[0]
        tags[tag] = list(struct.unpack(f"{order}{n}{code}", data[start : start + size]))
    return order, tags


def _tiff(data: bytes) -> np.ndarray:
    order, tags = _tiff_tags(data)
    w, h, depth = tags[256][0], tags[257][0], tags.get(258, [1])[0]
    packing, samples, predictor = tags.get(259, [1])[0], tags.get(277, [1])[0], tags.get(317, [1])[0]
    if packing not in (1, 8, 32946) or depth not in (8, 16) or predictor != 1 or tags.get(284, [1])[0] != 1:
        raise ImageError("unsupported kind of TIFF")
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    raw = b"".join(s if packing == 1 else zlib.decompress(s) for s in strips)
    pixels = np.frombuffer(raw, np.dtype(f"{order}u{depth // 8}"), w * h * samples).astype(f"u{depth // 8}").reshape(h, w, samples)
    grey = _luma(pixels) if samples >= 3 else pixels[:, :, 0]
    return (np.iinfo(grey.dtype).max - grey) if tags.get(262, [1])[0] == 0 else grey


def _bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
    w, h, _, bits, packing = struct.unpack("<iiHHI", data[18:34])
    if packing or bits not in (8, 24, 32):
        raise ImageError("unsupported kind of BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, count=(start - 14 - head) // 4 * 4, offset=14 + head).reshape(-1, 4)
        return _luma(palette[rows][:, :, 2::-1])
    return _luma(rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    """The grey pixels of an image, uint8 or uint16; ``ImageError`` if it is none."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (KeyError, IndexError, struct.error, zlib.error, TypeError) as broken:
        raise ImageError(f"broken image: {broken}") from broken
    except ValueError as broken:
        raise ImageError(str(broken)) from broken
    raise ImageError("unknown image format")


def header(data: bytes) -> tuple[int, int, int]:
    """width, height, bit depth (8 or 16) from the start of a file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, depth = struct.unpack(">IIB", data[16:25])
    elif data[:4] in (b"II*\0", b"MM\0*"):
        _, tags = _tiff_tags(data)
        w, h, depth = tags[256][0], tags[257][0], tags.get(258, [1])[0]
    elif data[:2] == b"BM":
        w, h, depth = *struct.unpack("<ii", data[18:26]), 8
    else:
        raise ImageError("unknown image format")
    return w, abs(h), 16 if depth > 8 else 8


def encode_tiff(a: np.ndarray, deflate: bool = False) -> bytes:
    """A grey image as a single-strip little-endian TIFF; other types than 8 and 16 bits are cast to 8."""
    if a.dtype not in (np.uint8, np.uint16):
        a = a.astype(np.uint8)
    body = a.astype(a.dtype.newbyteorder("<")).tobytes()
    body = zlib.compress(body) if deflate else body
    h, w = a.shape
    entries = [(256, 4, w), (257, 4, h), (258, 3, a.dtype.itemsize * 8), (259, 3, 8 if deflate else 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(body))]
    out = b"II*\0" + struct.pack("<I", 8 + len(body) + len(body) % 2) + body + b"\0" * (len(body) % 2)
    out += struct.pack("<H", len(entries))
    for tag, kind, value in entries:
        out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    return out + struct.pack("<I", 0)


def encode_png(a: np.ndarray) -> bytes:
    """A grey image as PNG, unfiltered."""
    h, w = a.shape
    lines = a.astype(f">u{a.dtype.itemsize}").tobytes()
    stride = w * a.dtype.itemsize
    raw = b"".join(b"\0" + lines[y * stride : (y + 1) * stride] for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, a.dtype.itemsize * 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def to_depth(a: np.ndarray, depth: int) -> np.ndarray:
    """8 bits shifted up, or 16 bits shifted down, to the depth asked for."""
    if a.dtype == np.uint8 and depth == 16:
        return a.astype(np.uint16) << 8
    if a.dtype == np.uint16 and depth == 8:
        return (a >> 8).astype(np.uint8)
    return a


def decoded(files: DataFrame, depth: int | None = None) -> DataFrame:
    """``files`` (content and others) with width, height, bit_depth, pixels, error.

    Pixels are row-major, little-endian. A file that is no image gets an error text and nulls, and
    the rest goes on. Content is dropped from the result.
    """
    keep = [c for c in files.columns if c != "content"]

    @F.pandas_udf(SLICE_SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch:
                try:
                    a = decode(bytes(data))
                    a = a if depth is None else to_depth(a, depth)
                    rows.append((a.shape[1], a.shape[0], a.dtype.itemsize * 8, a.astype(a.dtype.newbyteorder("<")).tobytes(), None))
                except (ImageError, TypeError) as broken:
                    rows.append((None, None, None, None, str(broken)))
            yield pd.DataFrame(rows, columns=["width", "height", "bit_depth", "pixels", "error"]).astype({k: "Int32" for k in ("width", "height", "bit_depth")})

    return files.withColumn("__image", run(F.col("content"))).select(*keep, "__image.*")


def header_columns(content: Column) -> Column:
    """struct(width, height, bit_depth) from the head of a file; nulls where it is no image."""

    @F.pandas_udf("width int, height int, bit_depth int")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for data in batch:
            try:
                rows.append(header(bytes(data)))
            except (ImageError, KeyError, IndexError, struct.error, TypeError):
                rows.append((None, None, None))
        return pd.DataFrame(rows, columns=["width", "height", "bit_depth"]).astype("Int32")

    return run(content)


def read_stack(spark: SparkSession, path: str, stack_id: str, depth: int | None = None) -> DataFrame:
    """Slices of a folder of numbered images: stack_id, level 0, z, width, height, bit_depth, pixels.

    The folder's dominant sequence is read, in numeric order, with z from 0; files that cannot be
    decoded keep their z and have null pixels. One image is one row, so the largest image bounds a
    task's memory; a small Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch``) suits large ones.
    """
    from .sequence import detect, parsed

    files = spark.read.format("binaryFile").load(path)
    files = parsed(files.withColumn("name", F.element_at(F.split("path", "/"), -1)))
    chosen = detect(files.select("name")).select("prefix", F.col("file_type").alias("ext"))
    names = files.select("name", "prefix", "ext", "number").join(F.broadcast(chosen), ["prefix", "ext"], "left_semi")
    from pyspark.sql.window import Window

    order = names.withColumn("z", F.row_number().over(Window.partitionBy("prefix").orderBy("number", "name")) - 1)
    rows = decoded(files.select("name", "content").join(order.select("name", "z"), "name"), depth)
    return rows.select(F.lit(stack_id).alias("stack_id"), F.lit(0).alias("level"), "z", "width", "height", "bit_depth", "pixels", "error")


def read_jpeg(spark: SparkSession, path: str) -> DataFrame:
    """8-bit grey slices of JPEG files by Spark's image source: name, width, height, bit_depth, pixels."""
    rows = spark.read.format("image").load(path).select("image.*")
    rows = rows.filter("nChannels = 1")
    return rows.select(F.element_at(F.split("origin", "/"), -1).alias("name"), "width", "height", F.lit(8).alias("bit_depth"), F.col("data").alias("pixels"))
