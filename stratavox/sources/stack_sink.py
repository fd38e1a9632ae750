"""A data source that writes slices as TIFF files, all or none of them.

Each attempt of a task writes into a folder of its own. When all tasks are done the driver moves the
files of the attempts that count; attempts that failed, were retried or ran twice leave nothing behind.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .codec import encode_tiff

STAGING = "_staging"
#: Files that the driver moves at a time.
MOVES = 16


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder and the names of its files."""

    folder: str
    names: list[str]


class StackWriter(DataSourceWriter):
    """One job. Its staging folder is there from the start and gone at the end, so a task that is still running then can write nothing."""

    def __init__(self, path: str, deflate: bool, overwrite: bool):
        self.path, self.deflate, self.overwrite = path, deflate, overwrite
        self.job = uuid.uuid4().hex
        system, base = _opened(path)
        system.create_dir(f"{base}/{STAGING}/{self.job}")

    def write(self, iterator: Iterator) -> Written:
        system, base = _opened(self.path)
        folder, names = f"{base}/{STAGING}/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=False)
        for row in iterator:
            if not row["name"] or "/" in row["name"] or row["pixels"] is None:
                raise ValueError(f"not an image with a plain name: {row['name']!r}")
            image = np.frombuffer(row["pixels"], f"<u{int(row['bit_depth']) // 8}").reshape(int(row["height"]), int(row["width"]))
            with system.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write(encode_tiff(image, self.deflate))
            names.append(row["name"])
        return Written(folder, names)

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        top = f"{base}/{STAGING}"
        if system.get_file_info(f"{top}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.job}")
        if system.get_file_info(top).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(top)):
            system.delete_dir(top)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = _opened(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self._clear(system, base)
            raise ValueError("two slices have one name")
        system.create_dir(base)
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(base)):
                if info.type == fs.FileType.File:
                    system.delete_file(info.path)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda f: system.move(*f), [(f"{m.folder}/{n}", f"{base}/{n}") for m in done for n in m.names]))
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))


class StackSource(DataSource):
    """``df.write.format("tiff_stack")`` for rows with name, width, height, bit_depth and pixels; options path and deflate."""

    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def writer(self, schema: StructType, overwrite: bool) -> StackWriter:
        lacking = {"name", "width", "height", "bit_depth", "pixels"} - set(schema.fieldNames())
        if lacking:
            raise ValueError(f"columns are missing: {sorted(lacking)}")
        return StackWriter(self.options["path"], self.options.get("deflate", "false").lower() == "true", overwrite)


def write_stack(slices: DataFrame, path: str, name: Column, deflate: bool = False, mode: str = "append") -> None:
    """Write each slice as TIFF file ``name`` below ``path``: every file, or an error and none.

    ``sinks.export_stack`` writes what it can and reports the rest instead. Names must differ; a file
    of the same name is replaced, and ``mode='overwrite'`` removes all other files of the folder.
    """
    slices.sparkSession.dataSource.register(StackSource)
    rows = slices.select(name.alias("name"), "width", "height", "bit_depth", "pixels")
    rows.write.format("tiff_stack").option("path", path).option("deflate", str(deflate).lower()).mode(mode).save()
