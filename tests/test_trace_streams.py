"""The trace file source and the framer of streamed messages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.operators.crop import CropParams
from tremorline.session import scratch_path
from tremorline.sources import trace_source, traces
from tremorline.streaming.crop_stream import alarms_of, stream_events
from tremorline.streaming.framer import message_samples, stream_frames


@pytest.fixture
def folder(tmp_path):
    """Files of several folders, one without traces; widths differ between folders."""
    rng = np.random.default_rng(3)
    want, number = [], 0
    for name, width, sizes in (("b", 5, [7, 0, 300]), ("a", 8, [1, 40]), ("c/d", 3, [2])):
        (tmp_path / name).mkdir(parents=True)
        for i, n in enumerate(sizes):
            (tmp_path / name / f"{i:03d}.rtd").write_bytes(traces.encode_trace_file(rng.integers(0, 65536, (n, width))))
    for path in sorted(tmp_path.rglob("*.rtd"), key=lambda p: (str(p.parent), str(p))):
        data = path.read_bytes()
        n, width = trace_source.parse_header(data[: traces.HEADER_LIMIT], str(path))
        for k, row in enumerate(np.frombuffer(data, "<u2", n * width, traces.PAYLOAD_START).reshape(n, width)):
            want.append((number, str(path), k, row.tolist()))
            number += 1
    return tmp_path, want


@pytest.mark.parametrize("range_bytes", [1, 64, 1000, 1 << 26])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_every_trace_is_read_once(spark, folder, range_bytes, scheme):
    path, want = folder
    got = trace_source.read_traces(spark, f"{scheme}{path}", range_bytes)
    assert sorted((r.trace_no, r.path, r.trace, list(r.samples)) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_ranges_are_bounded_and_cut_large_files():
    # a file above 2 GB is planned like any other
    files = [("/x/big", 4096 + 2 * 1000 * 3_000_000, 3_000_000, 1000)] + [(f"/x/s{i:04d}", 6096, 1, 1000) for i in range(100)]
    tasks = trace_source.plan_ranges(files, 64 << 20)
    assert all(sum(2 * r.width * r.count for r in t) <= 64 << 20 for t in tasks)
    assert len(tasks) == 6_000_200_000 // (64 << 20) + 1
    numbers = [(r.trace_no, r.count) for t in tasks for r in t]
    at = 0
    for number, count in numbers:
        assert number == at
        at += count
    assert at == 3_000_100


def test_cut_off_file_is_refused(tmp_path):
    whole = traces.encode_trace_file(np.ones((5, 4), int))
    with pytest.raises(ValueError, match="cut off"):
        trace_source.plan_ranges([("/x/a", len(whole) - 1, 5, 4)], 100)
    with pytest.raises(ValueError, match="header"):
        trace_source.parse_header(b"nothing", "/x/a")


def test_empty_folder(spark, tmp_path):
    assert trace_source.read_traces(spark, str(tmp_path)).count() == 0


# --- streams -------------------------------------------------------------------------------------------------------


def messages(spark, matrix, seed):
    """Messages of 1 to 30 traces in files of random messages, some messages twice in one file."""
    rng = np.random.default_rng(seed)
    rows, at = [], 0
    while at < len(matrix):
        n = int(rng.integers(1, 31))
        rows.append((at, bytearray(traces.encode_trace_message(matrix[at : at + n]))))
        at += n
    rng.shuffle(rows)
    source = scratch_path(spark, "messages")
    for part in np.array_split(np.arange(len(rows)), 3):
        some = [(int(rows[i][0]), rows[i][1]) for i in part]
        spark.createDataFrame(some + some[:1], "first_trace long, payload binary").coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema("first_trace long, payload binary").option("maxFilesPerTrigger", 1).parquet(source)


def finish(spark, df, sink):
    query = (
        df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch_path(spark, "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(sink)


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_messages_of_any_size_give_the_batch_frames(spark, seed):
    matrix = np.random.default_rng(seed).integers(0, 1000, (207, 60))
    got = finish(spark, stream_frames(message_samples(messages(spark, matrix, seed), (3, 44)), 10), scratch_path(spark, "frames"))
    frames = {(r.zone, r.frame_no): list(r.samples) for r in got.collect()}
    assert got.count() == len(frames)
    assert frames == {(c, n): matrix[10 * n : 10 * n + 10, c].astype(float).tolist() for c in (3, 44) for n in range(20)}


def test_messages_to_alarms_in_one_stream(spark):
    rng = np.random.default_rng(9)
    matrix = rng.integers(480, 520, (400, 4))
    for at in (103, 151, 290):
        matrix[at, 2] += 5000
    params = CropParams(threshold=30.0, indent=3, cooling=10, max_time=30, frame_len=5)
    frames = stream_frames(message_samples(messages(spark, matrix, 4), (1, 2)), 5)
    found = finish(spark, alarms_of(stream_events(frames, params)), scratch_path(spark, "alarms")).orderBy("close_frame").collect()
    assert [r.zone for r in found] == [2] * len(found) and len(found) == 3
    # a peak exactly at the indent takes the whole frame before
    assert [int(np.argmax(r.samples)) for r in found] == [8, 3, 3]
