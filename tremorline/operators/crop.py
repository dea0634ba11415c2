"""Cropping of alarms out of detected frames.

The alarm logic is a state machine over the frames of a zone. Its state before a frame is either *idle* or "recording
since frame s", and all that a recording adds follows from s: when it closes depends only on the frames from s on, of which
at most ``max_time`` + 2 matter. So a zone is cut into pieces of frames, and each piece computes, for every frame at which
the machine may enter it idle, the frame at which it leaves it idle again (``Piece.exits``). These maps are composed along
the pieces of a zone, which is a few numbers per piece; then every piece knows its real entry and lists its alarms. Pieces
run in parallel twice, whether or not the zone is ever quiet. Only one small row per frame is folded; the samples are joined
afterwards by (zone, frame).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.blocks import number_rows, with_halo
from tremorline.operators.detect import detect_frames, frame_summary, peak
from tremorline.session import materialize

# Frames of a zone folded by one task (a few megabytes).
PIECE_FRAMES = 1 << 16
OPEN = -1  # leaving a piece: an alarm is open when the recording ends


@dataclass(frozen=True)
class CropParams:
    """Lengths in samples (milliseconds at 1 kHz). ``frame_len`` is nominal; frames may have any length."""

    threshold: float = 3.0
    indent: int = 500
    cooling: int = 2000
    max_time: int = 10000
    frame_len: int = 1000

    @property
    def reach(self) -> int:
        """Frames within which every alarm has closed: each adds at least one sample to at most ``max_time``."""
        return self.max_time + 2

@dataclass
class CropState:
    """What one zone remembers between frames. ``pieces`` = (frame_no, skipped leading samples) of the open alarm."""

    recording: bool = False
    cooling: int = 0
    cached: int = 0
    last_no: int | None = None
    last_n: int = 0
    pieces: list[tuple[int, int]] = field(default_factory=list)

    def step(self, frame_no: int, n: int, detected: bool, peak_pos: int, p: CropParams) -> list[tuple[int, int]] | None:
        """Take one frame; returns the pieces of an alarm that closes on it (the closing frame is not used)."""
        late = self.cached > p.max_time
        cooled = self.recording and not detected and self.cooling > p.cooling
        if late or cooled:
            closed, self.pieces = self.pieces, []
            self.recording, self.cooling, self.cached = False, 0, 0
            return closed
        if detected and not self.recording:
            self.recording, self.cooling = True, 0
            missing = p.indent - peak_pos
            if missing < 0:
                self._add(frame_no, -missing, n)
            else:
                # nothing missing takes the whole previous frame
                if self.last_no is not None:
                    self._add(self.last_no, max(self.last_n - missing, 0) if missing else 0, self.last_n)
                self._add(frame_no, 0, n)
        elif self.recording:
            self.cooling = 0 if detected else self.cooling + n
            self._add(frame_no, 0, n)
        self.last_no, self.last_n = frame_no, n
        return None

    def _add(self, frame_no: int, skip: int, n: int) -> None:
        self.pieces.append((frame_no, skip))
        self.cached += n - skip


class Piece:
    """The frames of one piece with those around it that it needs: two before, ``reach`` after.

    All positions are indexes into these frames; ``lo`` to ``hi`` (exclusive) are the piece itself. For every detected
    frame s, ``held[v][s]`` is what an alarm holds after it and ``close[v][s]`` the frame that closes the alarm (``size`` if
    none does). v = 0: the frame before s is the one before it; v = 1: that frame closed an alarm and was not used, so
    the one before that counts as previous.
    """

    def __init__(self, table: pa.Table, block: int, frames: int, params: CropParams):
        order = np.argsort(table["pos"].to_numpy(), kind="stable")
        table = table.take(order)
        pos = table["pos"].to_numpy()
        self.first, self.size, self.params = int(pos[0]), len(pos), params
        self.lo, self.hi = (int(x) for x in np.searchsorted(pos, [block * frames, (block + 1) * frames]))
        self.frame_no, self.first_sample = table["frame_no"].to_numpy(), table["first_sample"].to_numpy()
        self.n = table["n"].to_numpy()
        # the frame that fits the noise is never tested
        loud = table["detected"].fill_null(False).to_numpy(zero_copy_only=False) & (pos > 0)
        self.before = np.r_[0, np.cumsum(self.n)]
        at = np.arange(self.size)
        self.next_loud = np.r_[self._next(loud), self.size]
        last_loud = np.maximum.accumulate(np.where(loud, at, -1))
        silence = self.before[:-1] - self.before[last_loud + 1]
        cooled = self._next(~loud & (silence > params.cooling))
        missing = params.indent - table["peak"].fill_null(0).to_numpy().astype(np.int64)
        self.skip = np.maximum(-missing, 0)
        self.taken, self.held, self.close = [], [], []
        for back in (1, 2):
            previous = np.where(at >= back, self.n[np.maximum(at - back, 0)], 0)
            # nothing missing takes the whole previous frame
            taken = np.where(missing < 0, 0, np.where(missing == 0, previous, np.minimum(missing, previous)))
            held = self.n - self.skip + taken
            full = np.searchsorted(self.before, params.max_time - held + self.before[1:], "right")
            close = np.minimum(np.maximum(full, at + 1), np.r_[cooled[1:], self.size])
            self.taken.append(taken)
            self.held.append(held)
            self.close.append(np.minimum(close, self.size))

    def _next(self, flags: np.ndarray) -> np.ndarray:
        """For each frame the first one at or after it that has the flag; ``size`` if none has."""
        at = np.where(flags, np.arange(len(flags)), len(flags))
        return np.minimum.accumulate(at[::-1])[::-1]

    def exits(self) -> tuple[list[int], list[bool], list[int]]:
        """For an idle entry at each frame of the piece, right after an alarm closed, and last for one at ``lo`` that
        did not: the position of the exit (of the zone; OPEN if the recording ends before), whether an alarm closed right
        before it, alarms closed on the way."""
        count = self.hi - self.lo
        places, closed, alarms = [0] * (count + 1), [False] * (count + 1), [0] * (count + 1)
        next_loud = self.next_loud.tolist()
        plain, after = self.close[0].tolist(), self.close[1].tolist()
        for e in [*range(self.hi - 1, self.lo - 1, -1), self.hi]:
            k = e - self.lo
            start = next_loud[self.lo if e == self.hi else e]
            if start >= self.hi:  # no alarm starts in the rest of the piece
                places[k], closed[k] = self.first + self.hi, False
                continue
            end = (after if start == e else plain)[start]
            if end == self.size:
                places[k] = OPEN
            elif end + 1 >= self.hi:
                places[k], closed[k], alarms[k] = self.first + end + 1, True, 1
            else:
                j = end + 1 - self.lo
                places[k], closed[k], alarms[k] = places[j], closed[j], alarms[j] + 1
        return places, closed, alarms

    def alarms(self, entry: int, closed: bool) -> Iterator[tuple[int, int, int]]:
        """(start, close, v) of the alarms that start in the piece when the machine enters it idle at ``entry``."""
        at = entry - self.first
        while at < self.hi:
            start = int(self.next_loud[at])
            if start >= self.hi:
                return
            v = int(closed and start == at)
            end = int(self.close[v][start])
            yield start, end, v
            at, closed = end + 1, True

    def pieces(self, start: int, end: int, v: int) -> list[tuple[int, int, int, int]]:
        """(frame_no, first sample, skipped samples, samples of the alarm before) of each frame of an alarm."""
        out = []
        if self.taken[v][start]:
            previous = start - 1 - v
            left = self.n[previous] - self.taken[v][start]
            out.append((int(self.frame_no[previous]), int(self.first_sample[previous]), int(left), 0))
        done = int(self.taken[v][start])
        for i in range(start, end):
            skip = int(self.skip[i]) if i == start else 0
            out.append((int(self.frame_no[i]), int(self.first_sample[i]), skip, done))
            done += int(self.n[i]) - skip
        return out


_EXITS = pa.schema([
    ("zone", pa.int32()), ("block", pa.int64()), ("stop", pa.int64()), ("entry", pa.list_(pa.int64())),
    ("exit", pa.list_(pa.int64())), ("closed", pa.list_(pa.bool_())), ("alarms", pa.list_(pa.int64())),
])
_ENTRIES = pa.schema([
    ("zone", pa.int32()), ("block", pa.int64()), ("entry", pa.int64()), ("closed", pa.bool_()), ("alarms", pa.int64()),
])
_PIECES = pa.list_(
    pa.struct([("frame_no", pa.int64()), ("first_sample", pa.int64()), ("skip", pa.int64()), ("at", pa.int64())])
)
_FOLDED = pa.schema([
    ("zone", pa.int32()), ("frame_no", pa.int64()), ("status", pa.string()), ("cached", pa.int64()),
    ("alarm_no", pa.int64()), ("n_samples", pa.int64()), ("pieces", _PIECES),
])


def _piece_exits(frames: int, params: CropParams):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        zone, block = (k.as_py() for k in key)
        piece = Piece(table, block, frames, params)
        if piece.lo == piece.hi:  # only frames around another piece
            return _EXITS.empty_table()
        places, closed, alarms = piece.exits()
        last = len(places) - 1
        start = piece.first + piece.lo
        # entries after an alarm, at most ``reach`` + 1 into the piece, as runs of equal results; the plain entry comes first
        entry, rows = [start], [last]
        for k in range(min(last, params.reach + 2)):
            same = (places[k], closed[k], alarms[k]) == (places[rows[-1]], closed[rows[-1]], alarms[rows[-1]])
            if k == 0 or not same:
                entry.append(start + k)
                rows.append(k)
        columns = [[zone], [block], [piece.first + piece.hi], [entry], *([[x[k] for k in rows]] for x in (places, closed, alarms))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _EXITS)], schema=_EXITS)

    return run


def _compose(key: tuple, table: pa.Table) -> pa.Table:
    """Where the machine enters every piece of a zone, idle: the pieces' maps one after the other."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    at, closed, alarms, out = 0, False, 0, []
    for r in rows:
        if at == OPEN:
            break
        if at >= r["stop"]:
            continue
        out.append((r["zone"], r["block"], at, closed, alarms))
        k = int(np.searchsorted(r["entry"][1:], at, "right")) if closed else 0
        at, closed, alarms = r["exit"][k], r["closed"][k], alarms + r["alarms"][k]
    columns = list(zip(*out)) or [[]] * len(_ENTRIES)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRIES)], schema=_ENTRIES)


def _piece_status(frames: int, params: CropParams):
    def run(key: tuple, table: pa.Table, entries: pa.Table) -> pa.Table:
        zone, block = (k.as_py() for k in key)
        if not len(entries):
            return _FOLDED.empty_table()
        piece, known = Piece(table, block, frames, params), entries.to_pylist()[0]
        out = []
        for k, (start, end, v) in enumerate(piece.alarms(known["entry"], known["closed"])):
            held = piece.held[v][start] + piece.before[start + 1 : end + 1] - piece.before[start + 1]
            numbers = piece.frame_no[start:end].tolist()
            out += [(zone, no, "recording", c, None, None, None) for no, c in zip(numbers, held.tolist())]
            if end < piece.size:
                parts = [dict(zip(("frame_no", "first_sample", "skip", "at"), p)) for p in piece.pieces(start, end, v)]
                row = (zone, int(piece.frame_no[end]), "emitted", 0, known["alarms"] + k, int(held[-1]), parts)
                out.append(row)
        columns = list(zip(*out)) or [[]] * len(_FOLDED)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOLDED)], schema=_FOLDED)

    return run


def fold_frames(detected: DataFrame, params: CropParams) -> DataFrame:
    """Status of every active frame; frames not returned are idle.

    Columns: zone, frame_no, status (recording or emitted), cached (samples held after the frame) and, where an alarm is
    emitted, alarm_no (0, 1, ... per zone), n_samples and its pieces. Frames of a zone follow each other in the order of
    their numbers, of which any may be missing; they may have any number of samples. ``detected`` is read three times and
    should be a stored table.
    """
    columns = ["zone", "frame_no", "n", "first_sample", "detected", peak().alias("peak")]
    placed = materialize(number_rows(detected.select(*columns), "zone", F.col("frame_no"), name="pos"), "placed")
    near = with_halo(placed, "zone", "pos", 2, params.reach, PIECE_FRAMES)
    spec = "zone int, block long, stop long, entry array<long>, exit array<long>, closed array<boolean>, alarms array<long>"
    exits = near.groupBy("zone", "block").applyInArrow(_piece_exits(PIECE_FRAMES, params), spec)
    # one row per PIECE_FRAMES frames
    entries = exits.groupBy("zone").applyInArrow(_compose, "zone int, block long, entry long, closed boolean, alarms long")
    entries = materialize(entries, "entries")
    piece = "array<struct<frame_no: long, first_sample: long, skip: long, at: long>>"
    return (
        near.groupBy("zone", "block")
        .cogroup(entries.groupBy("zone", "block"))
        .applyInArrow(
            _piece_status(PIECE_FRAMES, params),
            f"zone int, frame_no long, status string, cached long, alarm_no long, n_samples long, pieces {piece}",
        )
    )


def detected_frames(frames: DataFrame, params: CropParams) -> DataFrame:
    """Frame summaries with noise_std, ratio and detected, from one scan of the samples.

    The summaries, a thousandth of the samples, are written. A zone's noise is that of its first frame.
    """
    summary = materialize(frame_summary(frames), "frames")
    noise = summary.groupBy("zone").agg(F.min_by("std", "frame_no").alias("noise_std"))
    return detect_frames(summary, params.threshold, noise)


def _written_frames(frames: DataFrame, params: CropParams) -> DataFrame:
    return materialize(detected_frames(frames, params), "detected")


def frame_status(frames: DataFrame, params: CropParams) -> DataFrame:
    """Per frame: index range, std ratio, status, alarm flag and cached samples (replay log / pending status)."""
    detected = _written_frames(frames, params)
    folded = fold_frames(detected, params).select("zone", "frame_no", "status", "cached")
    out = detected.join(folded, ["zone", "frame_no"], "left")
    status = F.coalesce("status", F.lit("idle"))
    return out.select(
        "zone",
        "frame_no",
        F.col("first_sample").alias("from_idx"),
        (F.col("first_sample") + params.frame_len).alias("to_idx"),
        "ratio",
        status.alias("status"),
        (status == "recording").alias("alarm_flag"),
        F.coalesce("cached", F.lit(0)).cast("long").alias("cached"),
    )


def _emitted(frames: DataFrame, params: CropParams) -> DataFrame:
    folded = fold_frames(_written_frames(frames, params), params).filter(F.col("status") == "emitted")
    return folded.select("zone", "alarm_no", F.col("frame_no").alias("close_frame"), "n_samples", "pieces")


def crop_alarms(frames: DataFrame, params: CropParams) -> DataFrame:
    """One row per emitted alarm: zone, alarm_no (0, 1, ...), first and closing frame, number of samples."""
    return _emitted(frames, params).select(
        "zone",
        "alarm_no",
        F.col("pieces")[0]["frame_no"].alias("first_frame"),
        F.col("pieces")[0]["skip"].alias("first_skip"),
        "close_frame",
        "n_samples",
    )


def alarm_samples(frames: DataFrame, params: CropParams) -> DataFrame:
    """The samples of each alarm as a signal: zone, alarm_no, time (0, 1, ...), sample_idx, value.

    Joined by (zone, frame), which spreads every zone and alarm; an alarm is of bounded length. The samples of a frame have
    consecutive indexes, so the place of a sample follows from its frame and nothing is sorted.
    """
    pieces = _emitted(frames, params).select("zone", "alarm_no", F.inline("pieces"))
    pos = F.col("sample_idx") - F.col("first_sample") - F.col("skip")
    located = frames.join(pieces, ["zone", "frame_no"]).filter(pos >= 0)
    return located.select("zone", "alarm_no", (F.col("at") + pos).cast("long").alias("time"), "sample_idx", "value")


def onset_indent(frames: DataFrame, params: CropParams) -> DataFrame:
    """For every detected frame: where an alarm beginning there would start.

    ``skip`` leading samples of the frame are left out, or ``from_previous`` samples of the previous frame are put in
    front (all of them when the peak lies exactly at the indent).
    """
    detected = _written_frames(frames, params)
    prev = detected.select("zone", (F.col("frame_no") + 1).alias("frame_no"), F.col("n").alias("prev_n"))
    out = detected.filter("detected").withColumn("peak", peak()).join(prev, ["zone", "frame_no"])
    missing = F.lit(params.indent) - F.col("peak")
    return out.select(
        "zone",
        "frame_no",
        F.col("peak").cast("long").alias("peak"),
        F.greatest(-missing, F.lit(0)).cast("long").alias("skip"),
        F.when(missing < 0, 0)
        .when(missing == 0, F.col("prev_n"))
        .otherwise(F.least(missing, F.col("prev_n")))
        .cast("long")
        .alias("from_previous"),
    )
