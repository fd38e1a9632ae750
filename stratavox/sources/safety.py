"""Checks of names and paths before readers and writers are built."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What no name may hold, and the extensions of images.
FORBIDDEN = r'\.\.|^/|^\\|[<>:"|?*]|\x00'
EXTENSIONS = ("bmp", "jpg", "jpeg", "png", "tif", "tiff")


class UnsafePathError(ValueError):
    """A name or path that leaves its base folder or holds what is forbidden."""


def is_safe(name: Column) -> Column:
    """The predicate form of ``safe_name``, null for null."""
    return ~name.rlike(FORBIDDEN) & (F.length(F.trim(name)) > 0)


def safe_name(name: str) -> str:
    import re

    if not name or not name.strip() or re.search(FORBIDDEN, name):
        raise UnsafePathError(f"forbidden name: {name!r}")
    return name


def has_image_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9_]+)$", 1)).isin(*EXTENSIONS)


def safe_join(base: str, *parts: str) -> str:
    """``base`` with ``parts``, provided the result stays within ``base`` and is no link."""
    root = Path(base).resolve()
    path = root.joinpath(*[safe_name(p) for p in parts])
    if os.path.islink(path):
        raise UnsafePathError(f"a link: {path}")
    if not path.resolve().is_relative_to(root):
        raise UnsafePathError(f"outside {root}: {path}")
    return str(path)
