"""``.npy`` files as a Spark data source: a long recording is read by several tasks, a range of its bytes each.

Partitions are planned from the listing alone (names and sizes): files are cut into ranges of ``split_bytes``, and small files
are packed into one partition. A task reads a file's header by itself and returns the frames that begin in its range, so no
file is ever held whole. ``only`` names the groups that are wanted; other files are not opened. (Filters are not pushed down by
Spark itself: version 4.1 keeps the pushed filters of a relation for its later queries, which then lack rows.)

Paths are URIs that pyarrow can open (local, hdfs, s3, gs). Where executors do not have this package, ship it with
the job; :func:`kindred.sources.arrays.read_arrays` reads through Spark's own file systems instead, a file per row.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kindred import schema as S

SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: a header is read whole with the first bytes of the file; longer ones are read again
HEADER_BYTES = 4096


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):  # as Hadoop writes them
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + posixpath.abspath(path))


class Pieces(InputPartition):
    """Byte ranges (path, start, end) of files."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        super().__init__(pieces)
        self.pieces = pieces


def planned(files: list[tuple[str, int]], split_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Partitions of about ``split_bytes`` from (path, size), in the order of the paths."""
    out, held, size = [], [], 0
    for path, total in sorted(files):
        for start in range(0, max(total, 1), split_bytes):
            end = min(start + split_bytes, total)
            if held and size + end - start > split_bytes:
                out.append(held)
                held, size = [], 0
            held.append((path, start, end))
            size += end - start
    return [*out, held] if held else out


def _header(file) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether in Fortran order, type, and where the data begin."""
    size = HEADER_BYTES
    while True:
        file.seek(0)
        head = io.BytesIO(file.read(size))
        try:
            version = np.lib.format.read_magic(head)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, dtype = read(head)
        except ValueError:
            if size >= file.size():
                raise
            size *= 16
            continue
        if dtype.hasobject:
            raise ValueError("an array of Python objects is not read")
        return shape, fortran, dtype, head.tell()


def frames_of(file, name: str, start: int, end: int, kind: type) -> Iterator[pa.RecordBatch]:
    """The frames of an open file that begin in the byte range; a file without frames has one row, in its first range."""
    shape, fortran, dtype, data = _header(file)
    count = shape[0] if shape else 0
    number = pa.float64() if kind is np.float64 else pa.float32()

    def batch(first: int, rows: np.ndarray | None) -> pa.RecordBatch:
        n = 1 if rows is None else len(rows)
        vec = pa.nulls(1, pa.list_(number)) if rows is None else pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows.ravel(), kind))
        )
        frame = pa.nulls(1, pa.int32()) if rows is None else pa.array(np.arange(first, first + n, dtype=np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * n), pa.array([len(shape)] * n, pa.int32()), pa.array([count] * n, pa.int64()), frame, vec],
            names=[S.GROUP, "ndim", "n_frames", "frame", "vec"],
        )

    if len(shape) < 2 or count == 0:
        if start == 0:
            yield batch(0, None)
        return
    width = int(np.prod(shape[1:]))
    if fortran or not width:  # frames are not contiguous: the first range has them all
        if start == 0:
            file.seek(0)
            whole = np.load(io.BytesIO(file.read()), allow_pickle=False).reshape(count, -1)
            for at in range(0, count, 1024):
                yield batch(at, whole[at : at + 1024])
        return
    row = width * dtype.itemsize
    at, last = (min(max(-(-(x - data) // row), 0), count) for x in (start, end))
    step = max(BATCH_BYTES // row, 1)
    while at < last:
        n = min(step, last - at)
        file.seek(data + at * row)
        yield batch(at, np.frombuffer(file.read(n * row), dtype).reshape(n, width))
        at += n


class NpyReader(DataSourceReader):
    def __init__(self, path: str, double: bool, split_bytes: int, only: list[str] | None):
        self.path, self.kind, self.split_bytes = path, np.float64 if double else np.float32, split_bytes
        self.wanted = None if only is None else frozenset(only)

    def partitions(self) -> list[Pieces]:
        system, inside = file_system(self.path)
        found = [
            (info.path, info.size) for info in system.get_file_info(fs.FileSelector(inside))
            if info.is_file and info.base_name.endswith(".npy")
            and (self.wanted is None or info.base_name.removesuffix(".npy") in self.wanted)
        ]
        return [Pieces(p) for p in planned(found, self.split_bytes)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = file_system(self.path)
        for path, start, end in partition.pieces:
            with system.open_input_file(path) as file:
                yield from frames_of(file, posixpath.basename(path).removesuffix(".npy"), start, end, self.kind)


class NpySource(DataSource):
    """Options: path, double (false), split_bytes, only (a JSON list of groups)."""

    @classmethod
    def name(cls) -> str:
        return "kindred_npy"

    def _double(self) -> bool:
        return str(self.options.get("double", "false")).lower() == "true"

    def schema(self) -> str:
        return S.frames("double" if self._double() else "float")

    def reader(self, schema) -> NpyReader:
        only = self.options.get("only")
        return NpyReader(
            self.options["path"], self._double(), int(self.options.get("split_bytes", SPLIT_BYTES)), None if only is None else json.loads(only)
        )


def scan_arrays(
    spark: SparkSession, path: str, double: bool = False, split_bytes: int = SPLIT_BYTES, only: Sequence[str] | None = None
) -> DataFrame:
    """``(motion_id, ndim, n_frames, frame, vec)`` as :func:`kindred.sources.arrays.read_arrays`, from byte ranges."""
    spark.dataSource.register(NpySource)
    reader = spark.read.format("kindred_npy").option("path", path).option("double", double).option("split_bytes", split_bytes)
    if only is not None:
        reader = reader.option("only", json.dumps(list(only)))
    return reader.load()
