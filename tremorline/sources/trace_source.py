"""Trace files as a Spark data source: headers are read when the scan is planned, payloads once, by ranges of traces."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tremorline.sources.traces import HEADER_LIMIT, PAYLOAD_START

FORMAT = "trace_files"
SCHEMA = "trace_no long, path string, trace long, samples array<int>"
RANGE_BYTES = 64 << 20  # payload of one task
READ_BYTES = 4 << 20  # payload decoded at a time
LISTERS = 32  # headers read at once


@dataclass
class TraceRange:
    """``count`` traces of a file from ``first`` on; ``trace_no`` is the number of its first trace among all files."""

    path: str
    first: int
    count: int
    width: int
    trace_no: int


@dataclass
class TraceRanges(InputPartition):
    ranges: list[TraceRange]


def open_folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


def parse_header(start: bytes, path: str) -> tuple[int, int]:
    """(traces, width) from the first bytes of a file."""
    end = start.find(b"}")
    if end < 0:
        raise ValueError(f"{path} has no header")
    header = json.loads(start[: end + 1])
    return int(header["numTraces"]), int(header["traceSize"])


def plan_ranges(files: list[tuple[str, int, int, int]], range_bytes: int) -> list[list[TraceRange]]:
    """Ranges for tasks of about ``range_bytes`` from (path, size, traces, width) of all files.

    Traces are numbered over folders and files in name order; a trace is as wide as those of the first file of its folder.
    A large file is cut into several ranges, small ones share a task.
    """
    widths: dict[str, int] = {}
    tasks: list[list[TraceRange]] = [[]]
    number = used = 0
    for path, size, traces, width in sorted(files, key=lambda f: (f[0].rpartition("/")[0], f[0])):
        width = widths.setdefault(path.rpartition("/")[0], width)
        if size < PAYLOAD_START + 2 * width * traces:
            raise ValueError(f"{path} is cut off: {size} bytes for {traces} traces of {width} values")
        first = 0
        while first < traces:
            room = (range_bytes - used) // max(2 * width, 1)
            if room < 1 and tasks[-1]:
                tasks.append([])
                used = 0
                continue
            count = min(max(room, 1), traces - first)
            tasks[-1].append(TraceRange(path, first, count, width, number + first))
            used += 2 * width * count
            first += count
        number += traces
    return [t for t in tasks if t]


class TraceReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        fs, root = open_folder(self.path)
        found = [f for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.type == pa.fs.FileType.File]
        found = [f for f in found if not f.base_name.startswith((".", "_"))]

        def header(info) -> tuple[str, int, int, int]:
            with fs.open_input_file(info.path) as file:
                return info.path, info.size, *parse_header(file.read(HEADER_LIMIT), info.path)

        with ThreadPoolExecutor(LISTERS) as pool:
            files = list(pool.map(header, found))
        return [TraceRanges(r) for r in plan_ranges(files, self.range_bytes)] or [TraceRanges([])]

    def read(self, partition: TraceRanges) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(self.path)
        kind = pa.list_(pa.int32())
        schema = pa.schema([("trace_no", pa.int64()), ("path", pa.string()), ("trace", pa.int64()), ("samples", kind)])
        for part in partition.ranges:
            step = max(1, READ_BYTES // max(2 * part.width, 1))
            with fs.open_input_file(part.path) as file:
                for a in range(0, part.count, step):
                    n = min(step, part.count - a)
                    raw = file.read_at(2 * part.width * n, PAYLOAD_START + 2 * part.width * (part.first + a))
                    values = pa.array(np.frombuffer(raw, "<u2").astype(np.int32))
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * part.width)
                    columns = [
                        pa.array(np.arange(n, dtype=np.int64) + part.trace_no + a),
                        pa.array([part.path] * n, pa.string()),
                        pa.array(np.arange(n, dtype=np.int64) + part.first + a),
                        pa.ListArray.from_arrays(ends, values),
                    ]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


class TraceFiles(DataSource):
    """``spark.read.format("trace_files")`` over a folder of trace files and its subfolders."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


def read_traces(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(trace_no, path, trace, samples) of all trace files below ``path``, numbered over folders and files in name order.

    Planning reads the first bytes of every file; a task reads the payload of its ranges and nothing else, and nothing is
    shuffled. A file may be of any size. Folders are reached through Arrow's file systems.
    """
    spark.dataSource.register(TraceFiles)
    return spark.read.format(FORMAT).option("rangeBytes", range_bytes).load(path)
