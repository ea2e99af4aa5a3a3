"""A data source of raw number files: byte ranges of files of any size, read side by side, as cells.

spark.dataSource.register(RawArrays), then spark.read.format("raw_arrays").option("dims", "100,500,500").load(path):
field_id (the file's name), idx and v (as double). dims are slow to fast, dtype float32 or float64 unless named
otherwise; a file of another length is an error before anything is read. The option fields (names with a slash between)
leaves other files out, as does a filter on field_id where Spark pushes filters to Python and push_filters is true;
cells_per_task says how many cells a task reads. Paths are those that pyarrow.fs opens.
"""

from __future__ import annotations

import fnmatch
import math
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

CELLS_PER_TASK = 1 << 24
#: Cells of one batch of rows.
BATCH = 1 << 18
#: The dtypes of arrays in files.
DTYPES = ("float32", "float64", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64")


@dataclass
class Range(InputPartition):
    """Cells [start, stop) of a file."""

    path: str
    name: str
    start: int
    stop: int


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options.get("path", ""), options.get("glob", "*")
        self.dims = [int(d) for d in str(options.get("dims", "")).replace(" ", "").split(",") if d]
        self.dtype = options.get("dtype", "float32")
        self.per_task = int(options.get("cells_per_task", CELLS_PER_TASK))
        self.names: set[str] | None = {x for x in options["fields"].split("/") if x} if "fields" in options else None
        if not self.path:
            raise ValueError("raw_arrays needs a path")
        if not self.dims or min(self.dims) < 1:
            raise ValueError("raw_arrays needs dims, whole numbers above 0 with commas between")
        if self.dtype not in DTYPES:
            raise ValueError(f"no dtype {self.dtype!r}; there are {', '.join(DTYPES)}")

    def _files(self) -> list[fs.FileInfo]:
        system, path = located(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File]
        return sorted((x for x in found if fnmatch.fnmatch(x.base_name, self.glob) and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)

    def partitions(self) -> list[Range]:
        n, width, out = math.prod(self.dims), np.dtype(self.dtype).itemsize, []
        for f in self._files():
            if self.names is not None and f.base_name not in self.names:
                continue
            if f.size != n * width:
                raise ValueError(f"{f.path} has {f.size} bytes; {self.dtype} of {self.dims} has {n * width}")
            out += [Range(f.path, f.base_name, at, min(n, at + self.per_task)) for at in range(0, n, self.per_task)]
        return out or [Range("", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        system, _ = located(self.path)
        kind = np.dtype(self.dtype).newbyteorder("<")
        with system.open_input_file(partition.path) as file:
            for at in range(partition.start, partition.stop, BATCH):
                n = min(BATCH, partition.stop - at)
                v = np.frombuffer(file.read_at(n * kind.itemsize, at * kind.itemsize), kind).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([partition.name], pa.string()).take(pa.array(np.zeros(n, np.int64))), pa.array(np.arange(at, at + n)), pa.array(v)], ["field_id", "idx", "v"])


class PushingRawReader(RawReader):
    """With filters on field_id that leave files out; Spark takes such a reader only where it is told to push filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("field_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f


class RawArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_arrays"

    def schema(self) -> str:
        return "field_id string, idx bigint, v double"

    def reader(self, schema) -> RawReader:
        return (PushingRawReader if self.options.get("push_filters", "false") == "true" else RawReader)(self.options)


def read_raw_cells(spark: SparkSession, path: str, dims: list[int], dtype: str = "float32", glob: str = "*", fields: list[str] | None = None, cells_per_task: int = CELLS_PER_TASK) -> DataFrame:
    """Cells of all raw files at path, or of those named by fields; a file is as many tasks' work as its length needs."""
    spark.dataSource.register(RawArrays)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    reader = spark.read.format("raw_arrays").options(dims=",".join(map(str, dims)), dtype=dtype, glob=glob, cells_per_task=cells_per_task, push_filters=push)
    return (reader if fields is None else reader.option("fields", "/".join(fields))).load(path)
