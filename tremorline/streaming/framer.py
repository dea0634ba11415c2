"""From a stream of trace messages to the frames of each zone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tremorline.sources.traces import CHANNELS, REPLAY_STEP, decode_trace_message, fanout_zones

FRAMES = "zone int, frame_no long, samples array<double>"


class PartialFrame(StatefulProcessor):
    """Samples of one frame until all ``step`` have come; complete frames leave the state."""

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.part = handle.getValueState("part", "places array<int>, samples array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        zone, frame_no = key
        saved = self.part.get()
        samples = dict(zip(*saved)) if saved else {}
        for some in rows:
            samples.update(zip((some["trace_no"] % self.step).tolist(), some["value"].tolist()))
        if len(samples) < self.step:
            self.part.update(([int(p) for p in samples], [float(v) for v in samples.values()]))
            return
        self.part.clear()
        values = np.array([samples[p] for p in range(self.step)], dtype=float)
        yield pd.DataFrame({"zone": [zone], "frame_no": [frame_no], "samples": [values]})

    def close(self) -> None:
        pass


def message_samples(messages: DataFrame, channels: tuple[int, ...] = CHANNELS) -> DataFrame:
    """(zone, trace_no, value) of the chosen channels from messages (first_trace, payload) of any number of traces.

    ``first_trace`` is the number of the first trace of a message. Works on streams and tables alike.
    """
    traces = decode_trace_message(messages, "first_trace", "payload")
    return fanout_zones(traces.withColumn("trace_no", F.col("first_trace") + F.col("trace")), channels)


def stream_frames(samples: DataFrame, step: int = REPLAY_STEP) -> DataFrame:
    """(zone, frame_no, samples): every run of ``step`` samples of a zone, as soon as it is complete.

    ``samples``: a stream of (zone, trace_no, value) in any order and batching. The state holds the samples of incomplete
    frames, each under its zone and number, so that the frames of one zone are put together in many tasks. A sample that
    comes twice while its frame is open counts once.
    """
    frame = F.floor(F.col("trace_no") / step).alias("frame_no")
    read = samples.select(F.col("zone").cast("int").alias("zone"), frame, "trace_no", F.col("value").cast("double").alias("value"))
    return read.groupBy("zone", "frame_no").transformWithStateInPandas(PartialFrame(step), FRAMES, "append", "none")
