"""Real-time cropping: frames put back into order per zone, then the same step function as in batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tremorline.operators.crop import CropParams, CropState

ALARM, GAP, LATE, REPEATED = "alarm", "gap", "late", "repeated"
EVENTS = (
    "zone int, kind string, first_frame long, close_frame long, date_time timestamp, n_samples long, samples array<double>"
)
_NAMES = ["zone", "kind", "first_frame", "close_frame", "date_time", "n_samples", "samples"]
# The open alarm and what the next frame needs; waiting: numbers of the frames held back; skipped: bounds of gaps given up.
_STATE = (
    "noise double, recording boolean, cooling long, cached long, expected long, last_no long, last_samples array<double>, "
    "piece_frames array<long>, piece_samples array<array<double>>, waiting array<long>, skipped array<long>, alarm long"
)
_FRAME = "samples array<double>, micros long"

LATENESS = 1024  # frames: a missing frame is given up once one this much newer has come
HELD_FRAMES = 256  # frames of a zone held in memory while they wait; further ones wait in the state store
GAPS_KEPT = 256  # gaps remembered per zone, to tell late frames from repeated ones


def _peak(x: np.ndarray) -> int:
    mid = np.median(x)
    return int(np.argmin(x) if x.max() - mid < mid - x.min() else np.argmax(x))


class ZoneStream:
    """The fold of one zone over frames in order, and the samples of the open alarm.

    Bounded by the longest alarm: max_time plus one frame and the indent.
    """

    def __init__(self, params: CropParams, saved: tuple | None = None):
        self.params, self.fold = params, CropState()
        self.noise: float | None = None
        self.last = np.zeros(0)
        self.samples: list[np.ndarray] = []
        if saved is not None:
            self.noise, recording, cooling, cached, last_no, last, frames, samples = saved
            self.last = np.asarray(last, float)
            self.samples = [np.asarray(s, float) for s in samples]
            pieces = [(f, 0) for f in frames]
            self.fold = CropState(recording, cooling, cached, last_no, len(self.last), pieces)

    def saved(self) -> tuple:
        f = self.fold
        return (
            self.noise, f.recording, f.cooling, f.cached, f.last_no, self.last.tolist(),
            [no for no, _ in f.pieces], [s.tolist() for s in self.samples],
        )

    def take(self, frame_no: int, x: np.ndarray) -> tuple[int, np.ndarray] | None:
        """One frame in order; returns (first frame, samples) of an alarm that closes on it."""
        if self.noise is None:
            self.noise = float(np.std(x))
            self.fold.last_no, self.fold.last_n, self.last = frame_no, len(x), x
            return None
        std = float(np.std(x))
        detected = std / self.noise > self.params.threshold if self.noise else std > 0
        before = len(self.fold.pieces)
        closed = self.fold.step(frame_no, len(x), detected, _peak(x), self.params)
        if closed is not None:
            out, self.samples = np.concatenate(self.samples), []
            return closed[0][0], out
        for no, skip in self.fold.pieces[before:]:
            self.samples.append((x if no == frame_no else self.last)[skip:])
        self.last = x
        return None


class Reordered(StatefulProcessor):
    """Frames of a zone in the order of their numbers, whatever the order and the batches they come in.

    A frame whose predecessors are missing waits. A missing run is given up, and reported as a gap, when a frame
    ``lateness`` newer has come (judged at the end of a batch, so that the order inside a batch does not matter), or
    ``patience`` milliseconds after it held up the zone, by a timer of the batches' own clock. Every frame ends in one of
    three ways: it is folded, or reported late (its number was given up), or reported repeated.
    """

    def __init__(self, params: CropParams, lateness: int, patience: int | None):
        self.params, self.lateness, self.patience = params, lateness, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.zone = handle.getValueState("zone", _STATE)
        self.waiting = handle.getMapState("waiting", "frame_no long", _FRAME)

    # --- state -----------------------------------------------------------------------------------------------------

    def _load(self) -> None:
        self.memory: dict[int, tuple] = {}
        saved = self.zone.get()
        if saved is None:
            self.fold, self.expected, self.numbers, self.skipped, self.armed = ZoneStream(self.params), 0, set(), [], None
            return
        noise, recording, cooling, cached, expected, last_no, last, frames, samples, waiting, skipped, armed = saved
        self.fold = ZoneStream(self.params, (noise, recording, cooling, cached, last_no, last, frames, samples))
        self.expected, self.numbers, self.armed = expected, set(waiting), armed
        self.skipped = [(a, b) for a, b in zip(skipped[::2], skipped[1::2])]

    def _save(self) -> None:
        self._spill()
        noise, recording, cooling, cached, last_no, last, frames, samples = self.fold.saved()
        skipped = [int(x) for gap in self.skipped[-GAPS_KEPT:] for x in gap]
        self.zone.update((
            noise, recording, cooling, cached, self.expected, last_no, last, frames, samples, sorted(self.numbers), skipped,
            self.armed,
        ))

    def _spill(self) -> None:
        for no, (samples, micros) in self.memory.items():
            self.waiting.updateValue((no,), (samples.tolist(), micros))
        self.memory.clear()

    def _next(self) -> tuple:
        """Take the expected frame out of the waiting ones."""
        self.numbers.discard(self.expected)
        if self.expected in self.memory:
            return self.memory.pop(self.expected)
        samples, micros = self.waiting.getValue((self.expected,))
        self.waiting.removeKey((self.expected,))
        return np.asarray(samples, float), micros

    # --- frames ----------------------------------------------------------------------------------------------------

    def _arrive(self, no: int, samples: np.ndarray, micros: int | None) -> tuple | None:
        if no < self.expected or no in self.numbers:
            gone = no not in self.numbers and any(a <= no <= b for a, b in self.skipped)
            if gone:  # reported once; a second copy is a repetition
                self.skipped = [r for a, b in self.skipped for r in _without(a, b, no)]
            return (LATE if gone else REPEATED, no, no, micros, len(samples), None)
        if len(self.memory) >= HELD_FRAMES:
            self._spill()
        self.memory[no] = (samples, micros)
        self.numbers.add(no)
        return None

    def _drain(self) -> Iterator[tuple]:
        """Fold what is in order."""
        while self.expected in self.numbers:
            samples, micros = self._next()
            closed = self.fold.take(self.expected, samples)
            if closed is not None:
                yield ALARM, closed[0], self.expected, micros, len(closed[1]), closed[1].tolist()
            self.expected += 1

    def _give_up(self) -> Iterator[tuple]:
        """Report the run of missing frames before the oldest waiting one, and go on from there."""
        first, found = self.expected, min(self.numbers)
        self.skipped.append((first, found - 1))
        yield GAP, first, found - 1, None, None, None
        self.expected = found
        yield from self._drain()

    def _overdue(self) -> Iterator[tuple]:
        while self.numbers and max(self.numbers) - self.expected >= self.lateness:
            yield from self._give_up()

    def _arm(self, now: int) -> None:
        """A timer for the frame that holds up the zone; ``armed`` is its number."""
        if self.patience is None or self.armed == (self.expected if self.numbers else None):
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.armed = self.expected if self.numbers else None
        if self.numbers:
            self.handle.registerTimer(now + self.patience)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        for part in rows:
            out = []
            part = part.sort_values("frame_no")
            for no, samples, micros in zip(part["frame_no"], part["samples"], part["micros"]):
                known = None if pd.isna(micros) else int(micros)
                told = self._arrive(int(no), np.asarray(samples, float), known)
                if told is not None:
                    out.append(told)
                else:
                    out += self._drain()
            yield _events(key[0], out)
        out = list(self._overdue())
        self._arm(timerValues.getCurrentProcessingTimeInMs() if self.patience is not None else 0)
        self._save()
        yield _events(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = list(self._give_up()) if self.numbers and self.armed == self.expected else []
        self.armed = None
        self._arm(timerValues.getCurrentProcessingTimeInMs())
        self._save()
        yield _events(key[0], out)

    def close(self) -> None:
        pass


def _without(a: int, b: int, no: int) -> list[tuple[int, int]]:
    """The range a to b without one number."""
    if not a <= no <= b:
        return [(a, b)]
    return [r for r in ((a, no - 1), (no + 1, b)) if r[0] <= r[1]]


def _events(zone: int, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(zone, *r) for r in rows], columns=_NAMES)
    out["date_time"] = pd.to_datetime(out["date_time"].astype("Int64"), unit="us")
    out["n_samples"] = out["n_samples"].astype("Int64")
    return out


def stream_events(
    frames: DataFrame, params: CropParams, lateness: int = LATENESS, patience: int | None = None
) -> DataFrame:
    """What happens in a stream of frames (zone, frame_no, samples and, if there is one, date_time).

    zone, kind, first_frame, close_frame, date_time, n_samples, samples. ``alarm``: frames and samples of a closed alarm, at
    the time of its closing frame; ``gap``: frames that were given up; ``late`` and ``repeated``: a frame that came after
    its number was given up, or again. Numbers count from 0. Alarms still open and frames still waiting stay in the state:
    per zone one open alarm and the frames of the last ``lateness`` numbers.
    """
    micros = F.unix_micros(F.col("date_time").cast("timestamp")) if "date_time" in frames.columns else F.lit(None).cast("long")
    read = frames.select("zone", "frame_no", F.col("samples").cast("array<double>").alias("samples"), micros.alias("micros"))
    return read.groupBy("zone").transformWithStateInPandas(
        Reordered(params, lateness, patience), EVENTS, "append", "none" if patience is None else "processingTime"
    )


def alarms_of(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind") == ALARM).drop("kind")


def stream_crop_alarms(
    frames: DataFrame, params: CropParams, lateness: int = LATENESS, patience: int | None = None
) -> DataFrame:
    """The alarms among ``stream_events``, which also tells of gaps and of late and repeated frames."""
    return alarms_of(stream_events(frames, params, lateness, patience))
