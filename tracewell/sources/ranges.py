"""Files read in parts by many tasks, wherever Arrow's file systems reach: by place, not whole."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and length of the files of a folder, as Spark lists them; what they hold is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")


def opened(path: str) -> pa.NativeFile:
    """A file that can be read at any place."""
    system, place = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(place)


class Window:
    """Reads at places that mostly go forward, through a window of the file; what is skipped is not read."""

    def __init__(self, file: pa.NativeFile, size: int = 1 << 18):
        self.file, self.size, self.length = file, size, file.size()
        self.start, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place on; fewer at the end of the file."""
        if at < self.start or at + n > self.start + len(self.held):
            self.file.seek(min(at, self.length))
            self.start, self.held = at, self.file.read(max(n, self.size)) if at < self.length else b""
        return self.held[at - self.start : at - self.start + n]
