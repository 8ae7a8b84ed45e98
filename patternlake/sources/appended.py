"""A streaming source of lines that are appended to files: it goes on where it stopped in each file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PART = 64 << 20  # bytes of a file that a task reads
SCHEMA = "file string, at long, value string"


class Piece(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


class Reader(DataSourceStreamReader):
    """Offsets are places in files, after whole lines. The driver looks at files' lengths and their last bytes alone; tasks read."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, base = opened(self.folder)
        found = [x for x in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File and x.path.endswith(self.suffix)]
        depth = base.rstrip("/").count("/")
        return {x.path: end for x in found if x.path.count("/") - depth <= 2 and (end := self.after_last_line(system, x.path, x.size))}

    def after_last_line(self, system: fs.FileSystem, path: str, size: int) -> int:
        """Where the last whole line ends; what is still being written waits."""
        with system.open_input_file(path) as f:
            at = size
            while at > 0:
                begin = max(0, at - 65536)
                f.seek(begin)
                cut = f.read(at - begin).rfind(b"\n")
                if cut >= 0:
                    return begin + cut + 1
                at = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [Piece(f, b, min(b + PART, to)) for f, to in sorted(end.items()) for b in range(start.get(f, 0), to, PART)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The lines that begin in a piece; the one that its end cuts is read to its own end."""
        system, _ = opened(self.folder)
        with system.open_input_file(piece.file) as f:
            skip = False
            if piece.begin:
                f.seek(piece.begin - 1)
                skip = f.read(1) != b"\n"
            at, rest, rows = piece.begin, b"", []
            while at < piece.end and (block := f.read(1 << 20)):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if not skip and at < piece.end:
                        rows.append((piece.file, at, line.decode("utf-8", "replace")))
                    skip = False
                    at += len(line) + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["file", "at", "value"])
                    rows = []


class AppendedLines(DataSource):
    """Options: path, a folder that is read with those one level below; suffix, of its files (.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("suffix", ".jsonl"))


def appended_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """A stream of file, at (a line's first byte), value."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("suffix", suffix).load(folder)
