"""The alarm logic against a plain simulation on samples, in batch and as a stream."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorline.operators import crop
from tremorline.session import scratch_path
from tremorline.streaming.crop_stream import stream_events

P = crop.CropParams(threshold=2.0, indent=3, cooling=10, max_time=30, frame_len=5)


def simulate(frames, p):
    """Alarms of one zone as sample lists."""
    noise, open_alarm, recording, cooling, last, out = np.std(frames[0]), [], False, 0, frames[0], []
    for x in frames[1:]:
        loud = np.std(x) / noise > p.threshold
        if len(open_alarm) > p.max_time or (recording and not loud and cooling > p.cooling):
            out.append(open_alarm)
            open_alarm, recording, cooling = [], False, 0
            continue
        if loud and not recording:
            mid = np.median(x)
            top = x.argmin() if x.max() - mid < mid - x.min() else x.argmax()
            gap = p.indent - top
            head = [] if gap < 0 else list(last) if gap == 0 else list(last[-gap:])
            open_alarm, recording, cooling = head + list(x[max(-gap, 0):]), True, 0
        elif recording:
            cooling = 0 if loud else cooling + len(x)
            open_alarm = open_alarm + list(x)
        last = x
    return out


def recording(seed, frames=60, loud=0.25, longest=None):
    """Frames of one zone; of ``frame_len`` samples, or of 1 to ``longest``."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, longest + 1, frames) if longest else np.full(frames, P.frame_len)
    sizes[0] = 9
    out = [rng.normal(size=n) for n in sizes]
    state = False
    for i in range(1, frames):
        state = rng.random() < (0.6 if state else loud * 0.3)
        if state:
            out[i] = out[i] * 0.1
            out[i][rng.integers(len(out[i]))] += rng.choice([-1, 1]) * 40
    return [x.round(3) for x in out]


def numbered(zones, seed=0, gaps=0.0):
    """(zone, frame_no, samples) in order; some numbers are left out where ``gaps`` > 0."""
    rng = np.random.default_rng(seed)
    out = []
    for z, frames in enumerate(zones):
        no = 0
        for i, x in enumerate(frames):
            no += 0 if i == 0 else 1 + int(rng.random() < gaps) * int(rng.integers(1, 40))
            out.append((z, no, x))
    return out


def rows(zones, gaps=0.0):
    out, at = [], 0
    for z, no, x in numbered(zones, gaps=gaps):
        out += [(z, no, at + i, float(v)) for i, v in enumerate(x)]
        at += len(x) + 3
    return out


@pytest.fixture(scope="module")
def zones():
    out = [recording(s, loud=l) for s, l in zip(range(12), [0.05, 0.2, 0.5, 0.9] * 3)]
    out.append([recording(99)[0]] + [np.array([0.0, 0, 0, 50, 0])] * 20)  # peak at the indent, never quiet
    return out


@pytest.fixture(scope="module")
def uneven():
    """Frames of any length: mostly far shorter than the nominal one, or longer, loud for long."""
    out = [recording(s, 150, loud=l, longest=n) for s, (l, n) in enumerate([(0.1, 2), (0.4, 3), (2.5, 4), (0.9, 30), (3, 1)] * 2)]
    out.append([recording(98)[0]] + [np.array([50.0 * (i % 2)]) for i in range(140)])  # frames of one sample
    out.append([recording(97)[0]] + [np.array([0.0, 60, 0])] * 140)  # never quiet
    return out


def want(zones):
    return {(z, i): a for z, frames in enumerate(zones) for i, a in enumerate(simulate(frames, P))}


FRAMES = "zone int, frame_no long, sample_idx long, value double"


@pytest.mark.parametrize("gaps", [0.0, 0.3])
@pytest.mark.parametrize("block", [3, 11, 1 << 16])
@pytest.mark.parametrize("kind", ["zones", "uneven"])
def test_batch(spark, request, monkeypatch, kind, block, gaps):
    zones = request.getfixturevalue(kind)
    monkeypatch.setattr("tremorline.operators.crop.PIECE_FRAMES", block)
    frames = spark.createDataFrame(rows(zones, gaps), FRAMES)
    got = crop.alarm_samples(frames, P).toPandas().sort_values(["zone", "alarm_no", "time"])
    for _, g in got.groupby(["zone", "alarm_no"]):
        assert list(g["time"]) == list(range(len(g)))
    got = {k: list(g["value"]) for k, g in got.groupby(["zone", "alarm_no"])}
    assert got == want(zones)
    assert len(got) > 20


def fold_in_order(frames):
    """Status of every frame of one zone by the step function of the stream."""
    state, noise, out = crop.CropState(), np.std(frames[0]), []
    state.last_no, state.last_n = 0, len(frames[0])
    for no, x in enumerate(frames[1:], 1):
        mid = np.median(x)
        top = int(np.argmin(x) if x.max() - mid < mid - x.min() else np.argmax(x))
        closed = state.step(no, len(x), np.std(x) / noise > P.threshold, top, P)
        out.append((no, "emitted" if closed is not None else "recording" if state.recording else "idle", state.cached))
    return out


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_status_of_every_frame(spark, uneven, monkeypatch, block):
    monkeypatch.setattr("tremorline.operators.crop.PIECE_FRAMES", block)
    frames = spark.createDataFrame(rows(uneven), FRAMES)
    got = crop.frame_status(frames, P).select("zone", "frame_no", "status", "cached").collect()
    wanted = [(z, 0, "idle", 0) for z in range(len(uneven))]
    wanted += [(z, *r) for z, zone in enumerate(uneven) for r in fold_in_order(zone)]
    assert sorted(map(tuple, got)) == sorted(wanted)


def streamed(spark, batches, **options):
    """Events of frames that come in the given batches; the query is stopped and started again between them."""
    source, sink, state = (scratch_path(spark, n) for n in ("frames", "events", "state"))
    schema = "zone int, frame_no long, samples array<double>"
    for some in batches:
        data = [(z, n, [float(v) for v in x]) for z, n, x in some]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = (
            stream_events(stream, P, **options).writeStream.format("parquet").option("path", sink)
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(sink).toPandas().sort_values(["zone", "close_frame"])


def alarms_in(events):
    found = events[events["kind"] == "alarm"]
    return {(z, i): list(a) for z, g in found.groupby("zone") for i, a in enumerate(g["samples"])}


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_shuffled_frames_gives_the_batch_result(spark, zones, uneven, seed):
    both = zones[:4] + uneven[:5]
    frames = numbered(both)
    frames += frames[::17]  # some twice
    rng = np.random.default_rng(seed)
    rng.shuffle(frames)
    cuts = np.sort(rng.integers(0, len(frames), 2))
    events = streamed(spark, [frames[: cuts[0]], frames[cuts[0] : cuts[1]], frames[cuts[1] :]])
    assert alarms_in(events) == want(both)
    assert set(events["kind"]) == {"alarm", "repeated"}
    assert (events["kind"] == "repeated").sum() == len(numbered(both)[::17])


def test_gaps_and_late_frames_are_reported(spark, uneven):
    both = uneven[:4]
    frames = numbered(both, gaps=0.2)
    quiet = [(z, max(n for y, n, _ in frames if y == z) + 1 + k, both[z][0] * 0) for z in range(4) for k in range(60)]
    taken = {(z, n) for z, n, _ in frames}
    # almost in order: no frame is 20 numbers late, but for one of a number that was given up, and one more copy of it
    rng = np.random.default_rng(5)
    order = sorted(frames + quiet, key=lambda r: r[1] + rng.uniform(0, 20))
    missing = next((z, n) for z, no, _ in frames for n in range(no) if (z, n) not in taken)
    late = [(*missing, np.ones(3)), (*missing, np.ones(3))]
    events = streamed(spark, [order[:300], order[300:], late], lateness=45)
    assert alarms_in(events) == {(z, i): a for z, zone in enumerate(both) for i, a in enumerate(simulate(zone + [zone[0] * 0] * 60, P))}
    reported = {(r.zone, n) for r in events[events["kind"] == "gap"].itertuples() for n in range(r.first_frame, r.close_frame + 1)}
    assert reported == {(z, n) for z, no, _ in frames for n in range(no) if (z, n) not in taken}
    odd = events[events["kind"].isin(["late", "repeated"])]
    assert [(r.kind, r.zone, r.close_frame) for r in odd.itertuples()] == [("late", *missing), ("repeated", *missing)]


def test_timer_gives_up_what_does_not_come(spark):
    quiet, loud = [0.0, 1.0, 0.0, 1.0, 0.0], [0.0, 0.0, 90.0, 0.0, 0.0]
    frames = [(0, 0, quiet), (0, 1, quiet), (0, 3, loud), *((0, n, quiet) for n in range(4, 9))]
    source, sink, state = (scratch_path(spark, n) for n in ("frames", "events", "state"))
    data = spark.createDataFrame(frames, "zone int, frame_no long, samples array<double>")
    data.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(data.schema).parquet(source)
    events = stream_events(stream, P, lateness=1000, patience=100)
    query = (
        events.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state)
        .trigger(processingTime="200 milliseconds").start()
    )
    found, until = [], time.monotonic() + 60
    while len(found) < 2 and time.monotonic() < until and query.isActive:
        time.sleep(1)
        found = spark.read.schema(events.schema).parquet(sink).orderBy("close_frame").collect()
    query.stop()
    assert [(r.kind, r.first_frame, r.close_frame) for r in found] == [("gap", 2, 2), ("alarm", 1, 7)]


def test_open_alarm_is_not_emitted(spark):
    quiet, loud = np.array([0.0, 1, 0, 1, 0]), np.array([0.0, 0, 90, 0, 0])
    frames = spark.createDataFrame(
        rows([[quiet, quiet, loud, quiet]]), "zone int, frame_no long, sample_idx long, value double"
    )
    assert crop.crop_alarms(frames, P).count() == 0
    status = crop.frame_status(frames, P).orderBy("frame_no").collect()
    assert [r["status"] for r in status] == ["idle", "idle", "recording", "recording"]
    assert [r["cached"] for r in status] == [0, 0, 6, 11]
