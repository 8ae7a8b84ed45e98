"""A batch source and sink of vector index files: a header (dimensions as unsigned 32 bits, count as unsigned 64), ids as 64-bit integers, then vectors as 32-bit floats, all little-endian."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .appended import opened

SCHEMA = "id long, vector array<float>"
HEADER = struct.Struct("<IQ")
FILE_BYTES = 64 << 20  # of vectors in a file that is written
PART_BYTES = 32 << 20  # of vectors that a task reads
STAGED = "_staged"


class Span(InputPartition):
    """Rows begin to end of a file of count vectors."""

    def __init__(self, file: str, dimensions: int, count: int, begin: int, end: int):
        self.file, self.dimensions, self.count, self.begin, self.end = file, dimensions, count, begin, end


class Reader(DataSourceReader):
    """The driver reads headers alone; a file is dealt over as many tasks as its size asks for."""

    def __init__(self, folder: str, part_bytes: int):
        self.folder, self.part_bytes = folder, part_bytes

    def partitions(self) -> list[Span]:
        system, base = opened(self.folder)
        found = system.get_file_info(base)
        files = [found] if found.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        out = []
        for x in sorted(files, key=lambda x: x.path):
            with system.open_input_file(x.path) as f:
                head = f.read(HEADER.size)
            dimensions, count = HEADER.unpack(head) if len(head) == HEADER.size else (0, -1)
            if x.size != HEADER.size + count * (8 + 4 * dimensions):
                raise ValueError(f"{x.path} is no index file: its header and its size differ")
            step = max(1, self.part_bytes // (4 * dimensions + 8))
            out += [Span(x.path, dimensions, count, b, min(b + step, count)) for b in range(0, count, step)]
        return out or [Span("", 0, 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.file:
            return
        system, _ = opened(self.folder)
        d, n = span.dimensions, span.end - span.begin
        with system.open_input_file(span.file) as f:
            f.seek(HEADER.size + 8 * span.begin)
            ids = np.frombuffer(f.read(8 * n), "<i8")
            f.seek(HEADER.size + 8 * span.count + 4 * d * span.begin)
            flat = np.frombuffer(f.read(4 * d * n), "<f4")
        for lo in range(0, n, 10_000):
            hi = min(n, lo + 10_000)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * d, pa.int32()), pa.array(flat[lo * d : hi * d]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), vectors], names=["id", "vector"])


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceArrowWriter):
    """Tasks write whole files aside; the commit moves those of the tasks that count in place."""

    def __init__(self, folder: str, dimensions: int, overwrite: bool):
        self.folder, self.dimensions, self.overwrite, self.job = folder, dimensions, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = opened(self.folder)
        system.create_dir(f"{base}/{STAGED}/{self.job}", recursive=True)
        names, ids, vectors, held = [], [], [], 0

        def close() -> None:
            name = f"part-{uuid.uuid4().hex}.idx"
            with system.open_output_stream(f"{base}/{STAGED}/{self.job}/{name}") as f:
                f.write(HEADER.pack(self.dimensions, sum(map(len, ids))))
                for x in (*ids, *vectors):
                    f.write(x.tobytes())
            names.append(name)

        for batch in iterator:
            column = batch.column(batch.schema.get_field_index("vector"))
            sizes = column.value_lengths()
            if column.null_count or any(n != self.dimensions for n in sizes.unique().to_pylist()) or batch.column(batch.schema.get_field_index("id")).null_count:
                raise ValueError(f"an index holds ids and vectors of {self.dimensions} dimensions, and no nulls")
            ids.append(np.asarray(batch.column(batch.schema.get_field_index("id"))).astype("<i8"))
            vectors.append(np.asarray(column.flatten().to_numpy(zero_copy_only=False)).astype("<f4"))
            held += vectors[-1].nbytes
            if held >= FILE_BYTES:
                close()
                ids, vectors, held = [], [], 0
        if ids:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = opened(self.folder)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if x.type == fs.FileType.File and x.base_name.endswith(".idx"):
                    system.delete_file(x.path)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{base}/{STAGED}/{self.job}/{name}", f"{base}/{name}")
        self._clear(system, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/{STAGED}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{STAGED}/{self.job}")


class VectorIndex(DataSource):
    """Options: path, a file or a folder of files; part_bytes, of vectors that a task reads; dimensions, of what is written."""

    @classmethod
    def name(cls) -> str:
        return "vector_index"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options["dimensions"]), overwrite)


def write_index(rows: DataFrame, folder: str, dimensions: int, mode: str = "overwrite") -> None:
    """rows (id, vector) as index files in a folder; nulls and vectors of other dimensions are an error, and then nothing is written. Order isn't kept."""
    rows.sparkSession.dataSource.register(VectorIndex)
    own = rows.selectExpr("cast(id as long) as id", "cast(vector as array<float>) as vector")
    own.write.format("vector_index").option("dimensions", dimensions).mode(mode).save(folder)


def read_index(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """id, vector of an index file or a folder of them; a file whose size isn't what its header says is an error."""
    spark.dataSource.register(VectorIndex)
    return spark.read.format("vector_index").option("part_bytes", part_bytes).load(path)
