"""Interleaved buffers, framed trace messages, trace files and replayed recordings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.blocks import attach, block_of
from tremorline.schema import TRACE_HEADER
from tremorline.session import materialize

# Fixed values of the trace formats.
END_OF_MESSAGE = b"<<<EndOfData.>>>"
HEADER_LIMIT = 500  # the JSON header of a trace file ends within these bytes
PAYLOAD_START = 4096
WINDOW_TRACES = 1024
CHANNELS = (33, 44, 55)
BUFFER_CHANNELS, CENTRAL_CHANNEL, BUFFER_VALUES = 10, 5, 10000
REPLAY_STEP = 1000


def demux_channel(
    buffers: DataFrame,
    key: str,
    buf: str,
    stride: int = BUFFER_CHANNELS,
    offset: int = CENTRAL_CHANNEL,
    size: int = BUFFER_VALUES,
) -> DataFrame:
    """(key, tick, value): every ``stride``-th value of an interleaved buffer, from ``offset`` on, below ``size``."""
    ticks = F.posexplode(F.filter(buf, lambda v, i: (i % stride == offset) & (i < size))).alias("tick", "value")
    return buffers.select(key, ticks)


def encode_trace_message(traces: np.ndarray) -> bytes:
    """The message of a matrix of uint16 traces (one trace per row)."""
    header = json.dumps({"numTraces": traces.shape[0], "traceSize": traces.shape[1]}).encode()
    return header + b"\0" + traces.astype("<u2").tobytes() + END_OF_MESSAGE


def encode_trace_file(traces: np.ndarray) -> bytes:
    """The contents of a trace file."""
    header = json.dumps({"numTraces": traces.shape[0], "traceSize": traces.shape[1]}).encode()
    return header.ljust(PAYLOAD_START, b"\0") + traces.astype("<u2").tobytes()


def _matrix(payload: memoryview, traces: int, width: int) -> np.ndarray:
    return np.frombuffer(payload, "<u2", traces * width).reshape(traces, width)


def _decoded(key: pa.Array, parts: list[np.ndarray]) -> pa.RecordBatch:
    counts = [len(m) for m in parts]
    values = np.concatenate([m.ravel() for m in parts]) if parts else np.zeros(0, "u2")
    widths = np.concatenate([np.full(len(m), m.shape[1]) for m in parts]) if parts else np.zeros(0, int)
    ends = np.concatenate([[0], np.cumsum(widths)]).astype("int32")
    return pa.RecordBatch.from_arrays(
        [
            key.take(pa.array(np.repeat(np.arange(len(parts)), counts))),
            pa.array(np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, int), pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype("int32"))),
        ],
        names=["key", "trace", "samples"],
    )


def decode_trace_message(messages: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, trace, samples): the traces of each message (JSON header, NUL, uint16 values, end mark)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for raw in batch["payload"]:
                view = raw.as_buffer()
                data = view.to_pybytes()
                cut = data.index(b"\0")
                header = json.loads(data[:cut])
                parts.append(_matrix(memoryview(data)[cut + 1 :], header["numTraces"], header["traceSize"]))
            yield _decoded(batch["key"], parts)

    rows = messages.select(F.col(key).alias("key"), F.col(payload).alias("payload"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(decode, f"key {kind}, trace long, samples array<int>").withColumnRenamed("key", key)


def trace_headers(files: DataFrame) -> DataFrame:
    """(path, numTraces, traceSize) from the first bytes of each file (path, content)."""
    head = F.decode(F.substring("content", 1, HEADER_LIMIT), "ISO-8859-1")
    header = F.from_json(F.concat(F.substring_index(head, "}", 1), F.lit("}")), TRACE_HEADER)
    return files.select("path", header.alias("h")).select("path", "h.numTraces", "h.traceSize")


def decode_trace_files(files: DataFrame) -> DataFrame:
    """(trace_no, path, trace, samples): traces of all files, numbered over folders and files in name order.

    The numbering works on one small header row per file: files are summed inside their folder, folders among each
    other. The width of a trace is that of the first file of its folder.
    """
    heads = trace_headers(files).withColumn("folder", F.regexp_extract("path", "^(.*)/", 1))
    folders = heads.groupBy("folder").agg(
        F.sum("numTraces").alias("total"), F.min_by("traceSize", "path").alias("width")
    )
    above = Window.partitionBy(F.lit(0)).orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)
    folders = folders.select("folder", "width", F.coalesce(F.sum("total").over(above), F.lit(0)).alias("shift"))
    earlier = Window.partitionBy("folder").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        heads.withColumn("before", F.coalesce(F.sum("numTraces").over(earlier), F.lit(0)))
        .join(folders, "folder")
        .select("path", "numTraces", "width", (F.col("before") + F.col("shift")).alias("before"))
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for raw, count, width in zip(batch["content"], batch["numTraces"].to_pylist(), batch["width"].to_pylist()):
                parts.append(_matrix(memoryview(raw.as_buffer())[PAYLOAD_START:], count, width))
            out = _decoded(batch["path"], parts)
            shift = np.repeat(batch["before"].to_numpy(), [len(m) for m in parts])
            number = pa.array(out["trace"].to_numpy() + shift)
            yield pa.RecordBatch.from_arrays([number, *out.columns], names=["trace_no", "path", "trace", "samples"])

    # written, so that its measured size decides whether the payloads have to be shuffled to it
    numbered = materialize(numbered, "headers")
    rows = files.select("path", "content").join(numbered, "path")
    return rows.select("path", "content", "numTraces", "width", "before").mapInArrow(
        decode, "trace_no long, path string, trace long, samples array<int>"
    )


def read_trace_files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files as (path, content), for ``trace_headers`` and ``decode_trace_files``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def trace_inventory(files: DataFrame) -> DataFrame:
    """Number of files and traces, and the width of the first file's traces."""
    return trace_headers(files).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("numTraces").alias("traces"),
        F.min_by("traceSize", "path").alias("trace_size"),
    )


def fanout_zones(traces: DataFrame, channels: tuple[int, ...] = CHANNELS) -> DataFrame:
    """(zone, trace_no, value): chosen distance channels of each trace as series of their own."""
    picks = [F.struct(F.lit(c).alias("zone"), F.get("samples", F.lit(c)).alias("value")) for c in channels]
    return traces.select("trace_no", F.inline(F.array(*picks))).select("zone", "trace_no", "value")


def recent_trace_window(zones: DataFrame, keep: int = WINDOW_TRACES) -> DataFrame:
    """The last ``keep`` values of each zone; the limit is applied before the shuffle."""
    newest = Window.partitionBy("zone").orderBy(F.desc("trace_no"))
    return zones.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= keep).drop("__r")


def replay_frames(recording: DataFrame, step: int = REPLAY_STEP) -> DataFrame:
    """(zone, frame_no, samples): a recording (zone, sample_idx, value) cut into frames of ``step`` samples.

    The last sample of a recording is left out, as in a live replay.
    """
    sizes = recording.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    sized = attach(recording.withColumn("block", block_of("sample_idx")), sizes, "zone")
    kept = sized.filter(F.col("sample_idx") < F.col("n") - 1)
    frames = kept.groupBy("zone", F.floor(F.col("sample_idx") / step).alias("frame_no")).agg(
        F.sort_array(F.collect_list(F.struct("sample_idx", "value"))).alias("s")
    )
    return frames.select("zone", "frame_no", F.col("s.value").alias("samples"))
