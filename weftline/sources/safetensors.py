"""Safetensors files as a Spark data source.

``spark.read.format("safetensors")`` with option ``mode``:

* ``inventory`` reads only the headers: (file, tensor, dtype, shape, numel, bytes);
* ``chunks`` (the default) reads values: (file, tensor, dtype, shape, flat_offset, values), a row for each chunk of
  ``chunkElements`` values at most.  Chunks never share a tensor, partitions are byte ranges.

Half-precision types come as float32 values.  Files are found below ``path`` (several paths separated by commas), in name
order.  ``write.format("safetensors")`` of (tensor, shape, values) makes one file a task; files appear when the job commits.

A file is 8 bytes of header length, a JSON header of names, types, shapes and offsets, then the payload.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

# Storage types and their bytes.
WIDTHS = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E5M2": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8, "U64": 8, "F64": 8}
_NUMPY = {"BOOL": "?", "U8": "u1", "I8": "i1", "I16": "<i2", "U16": "<u2", "F16": "<f2", "I32": "<i4", "U32": "<u4", "F32": "<f4", "I64": "<i8", "U64": "<u8", "F64": "<f8", "BF16": "<u2"}
MAX_HEADER = 128 << 20


def is_float(dtype: str) -> bool:
    return dtype in ("F16", "BF16", "F32", "F64") or dtype.startswith("F8_")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow filesystem of a path or URI."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def resolve(paths: str) -> list[str]:
    """The safetensors files below the paths, sorted; a path without any is an error."""
    found = []
    for path in paths.split(","):
        system, at = filesystem(path.strip())
        info = system.get_file_info(at)
        scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
        if info.type == fs.FileType.File:
            files = [at]
        elif info.type == fs.FileType.Directory:
            files = sorted(i.path for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.path.endswith(".safetensors"))
        else:
            files = []
        if not files:
            raise FileNotFoundError(f"no safetensors file at {path}")
        found += [scheme + f for f in files]
    return found


def header(path: str) -> tuple[dict[str, dict], int]:
    """Entries by tensor name and where the payload begins; only 8 bytes and the header are read."""
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        size = struct.unpack("<Q", f.read(8))[0]
        if not 0 < size <= MAX_HEADER:
            raise ValueError(f"{path}: a header of {size} bytes")
        entries = json.loads(f.read(size))
    entries.pop("__metadata__", None)
    return entries, 8 + size


def decode_values(raw: bytes, dtype: str) -> np.ndarray:
    """Values of a payload as float64 (float32 for half precision types)."""
    if dtype not in _NUMPY:
        raise ValueError(f"values of {dtype} can't be read")
    x = np.frombuffer(raw, _NUMPY[dtype])
    if dtype == "BF16":
        return (x.astype(np.uint32) << 16).view(np.float32).astype(np.float64)
    return x.astype(np.float64)


@dataclass
class Range(InputPartition):
    file: str
    tensor: str
    dtype: str
    shape: list[int]
    at: int
    first: int
    count: int


@dataclass
class HeaderOf(InputPartition):
    file: str


class Reader(DataSourceReader):
    def __init__(self, options):
        self.mode = options.get("mode", "chunks")
        self.paths = options["path"]
        self.size = int(options.get("chunkElements", 1 << 20))
        self.wanted: str | None = options.get("tensor")

    def pushFilters(self, filters):  # noqa: N802
        """An equality on the tensor's name prunes partitions; it is still checked by Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("tensor",):
                self.wanted = f.value
            yield f

    def partitions(self):
        if self.mode == "inventory":
            return [HeaderOf(f) for f in resolve(self.paths)]
        out = []
        for f in resolve(self.paths):
            entries, base = header(f)
            for name, e in entries.items():
                if self.wanted not in (None, name):
                    continue
                numel = int(np.prod(e["shape"], dtype=np.int64))
                for first in range(0, numel, self.size):
                    n = min(self.size, numel - first)
                    out.append(Range(f, name, e["dtype"], e["shape"], base + e["data_offsets"][0] + first * WIDTHS[e["dtype"]], first, n))
        # one task may take many small chunks
        return [Bundle(out[i::k]) for i in range(k)] if (k := min(len(out), max(1, len(out) // 64 + 1))) else []

    def read(self, partition):
        if isinstance(partition, HeaderOf):
            entries, _ = header(partition.file)
            rows = [(partition.file, n, e["dtype"], e["shape"], int(np.prod(e["shape"], dtype=np.int64)), e["data_offsets"][1] - e["data_offsets"][0]) for n, e in entries.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "tensor", "dtype", "shape", "numel", "bytes"])
            return
        for r in partition.ranges:
            system, at = filesystem(r.file)
            with system.open_input_file(at) as f:
                f.seek(r.at)
                values = decode_values(f.read(r.count * WIDTHS[r.dtype]), r.dtype)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.file]), pa.array([r.tensor]), pa.array([r.dtype]), pa.array([r.shape], pa.list_(pa.int64())), pa.array([r.first], pa.int64()), pa.array([values], pa.list_(pa.float64()))],
                ["file", "tensor", "dtype", "shape", "flat_offset", "values"],
            )


@dataclass
class Bundle(InputPartition):
    ranges: list[Range]


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        self.overwrite = overwrite

    def write(self, iterator: Iterator) -> Written:
        """One hidden file a task, shown at commit."""
        entries, payload, at = {}, [], 0
        for row in iterator:
            values = np.asarray(row["values"], "<f4").tobytes()
            entries[row["tensor"]] = {"dtype": "F32", "shape": list(row["shape"]), "data_offsets": [at, at + len(values)]}
            payload.append(values)
            at += len(values)
        if not entries:
            return Written(None)
        head = json.dumps(entries).encode()
        head += b" " * (-len(head) % 8)
        system, base = filesystem(self.path)
        system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.safetensors"
        with system.open_output_stream(f"{base}/.{name}.partial") as f:
            f.write(struct.pack("<Q", len(head)) + head)
            for p in payload:
                f.write(p)
        return Written(name)

    def commit(self, messages) -> None:
        system, base = filesystem(self.path)
        if self.overwrite and system.get_file_info(base).type == fs.FileType.Directory:
            for i in system.get_file_info(fs.FileSelector(base)):
                if i.path.endswith(".safetensors"):
                    system.delete_file(i.path)
        for m in messages:
            if m and m.name:
                system.move(f"{base}/.{m.name}.partial", f"{base}/{m.name}")

    def abort(self, messages) -> None:
        system, base = filesystem(self.path)
        for m in messages:
            if m and m.name and system.get_file_info(f"{base}/.{m.name}.partial").type == fs.FileType.File:
                system.delete_file(f"{base}/.{m.name}.partial")


class Safetensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        if self.options.get("mode") == "inventory":
            return "file string, tensor string, dtype string, shape array<bigint>, numel bigint, bytes bigint"
        return "file string, tensor string, dtype string, shape array<bigint>, flat_offset bigint, values array<double>"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Safetensors)


def inventory(spark: SparkSession, path: str):
    register(spark)
    return spark.read.format("safetensors").option("mode", "inventory").load(path)


def read(spark: SparkSession, path: str, chunk_elements: int = 1 << 20):
    register(spark)
    return spark.read.format("safetensors").option("chunkElements", chunk_elements).load(path)
