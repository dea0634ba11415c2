"""Time-domain filters: normalisation, centred rolling std/mean, symmetric sliding windows, pooling, wavelets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorline.blocks import (
    BLOCK_ROWS,
    attach,
    block_of,
    block_window,
    core,
    ordered_samples,
    series_of,
    with_halo,
)

STD_WINDOW = 32
MEAN_WINDOW = 128


def _bounds(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("signal_raw").alias("lo"), F.max("signal_raw").alias("hi")
    )


def centred(window: int) -> tuple[int, int]:
    """Rows before and after the current row in a centred window; an even window leans to the past."""
    after = (window - 1) // 2
    return window - 1 - after, after


def _normalized() -> Column:
    return F.try_divide(F.col("signal_raw") - F.col("lo"), F.col("hi") - F.col("lo"))


def minmax_normalize(sig: DataFrame) -> DataFrame:
    """``(x - min) / (max - min)`` per series; NULL for a constant series."""
    blocked = sig.withColumn("block", block_of("time"))
    return attach(blocked, _bounds(sig), "id").select("id", "time", _normalized().alias("signal_raw"))


def _rolling(sig: DataFrame, window: int, name: str, fn) -> DataFrame:
    back, ahead = centred(window)
    frame = block_window("id", "time").rowsBetween(-back, ahead)
    out = with_halo(sig, "id", "time", back, ahead).withColumn(name, fn("signal_raw").over(frame))
    return core(out, "time").drop("block")


def rolling_std(sig: DataFrame, window: int = STD_WINDOW) -> DataFrame:
    """Centred rolling sample standard deviation; NULL where the window holds one sample."""
    return _rolling(sig, window, "signal_std", F.stddev_samp)


def rolling_mean(sig: DataFrame, window: int = MEAN_WINDOW) -> DataFrame:
    """Centred rolling mean."""
    return _rolling(sig, window, "signal_mean", F.avg)


@dataclass(frozen=True)
class TimePreprocessing:
    """Raw signal -> raw (optionally normalised), rolling std and rolling mean of it."""

    std_window: int = STD_WINDOW
    mean_window: int = MEAN_WINDOW
    normalize: bool = True

    def transform(self, sig: DataFrame) -> DataFrame:
        return core(self.framed(sig, 0, 0), "time").select("id", "time", "signal_raw", "signal_std", "signal_mean")

    def framed(self, sig: DataFrame, back: int, ahead: int) -> DataFrame:
        """The same with ``block`` and valid neighbours up to ``back``/``ahead`` rows outside each block.

        Later lag windows over ``(id, block)`` reuse the exchange and sort of the rolling windows.
        """
        sides = [centred(self.std_window), centred(self.mean_window)]
        reach_back, reach_ahead = max(s[0] for s in sides), max(s[1] for s in sides)
        sig = sig.select("id", "time", "signal_raw")
        out = with_halo(sig, "id", "time", reach_back + back, reach_ahead + ahead)
        if self.normalize:
            # neighbours of the last block may open one block more than the series has, which the join drops
            out = attach(out, _bounds(sig), "id").withColumn("signal_raw", _normalized())
        w = block_window("id", "time")
        return out.select(
            "id",
            "time",
            "block",
            "signal_raw",
            F.stddev_samp("signal_raw").over(w.rowsBetween(-sides[0][0], sides[0][1])).alias("signal_std"),
            F.avg("signal_raw").over(w.rowsBetween(-sides[1][0], sides[1][1])).alias("signal_mean"),
        )


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _ends(near: DataFrame, value: str, half: int) -> DataFrame:
    """(id, n, head, tail): means of the first 1, 2, ... values of a series and of its last 1, 2, ..., 2 half + 1 at most."""
    out = []
    for name, place in (("head", F.col("time")), ("tail", F.col("n") - 1 - F.col("time"))):
        some = near.select("id", "n", place.alias("__k"), F.col(value).alias("__v")).filter(F.col("__k") <= 2 * half)
        w = Window.partitionBy("id").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
        mean = F.when(F.count("__v").over(w) == F.col("__k") + 1, F.avg("__v").over(w))
        pairs = F.sort_array(F.collect_list(F.struct("__k", F.col("__m").alias("m"))))
        out.append(some.withColumn("__m", mean).groupBy("id").agg(F.max("n").alias("n"), pairs["m"].alias(name)))
    return out[0].join(out[1].drop("n"), "id")


def _sliding_avg(sig: DataFrame, value: str, window: int, name: str) -> DataFrame:
    """Add the mean over a two-pointer window: full inside, shrinking symmetrically at both ends of a series.

    Inside, it is one sliding frame. At the ends the window of a row begins or stops with the series, so it is one of the
    means of the first or last values, of which a series has at most ``window`` + 1 each. The plan does not depend on the
    width. A window with a null has no mean; one that would be the whole series leaves out its last value.
    """
    half, rest = window // 2, (window - 1) // 2
    out = attach(with_halo(sig, "id", "time", half, half), _sizes(sig), "id")
    frame = block_window("id", "time").rowsBetween(-half, rest)
    full = F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))
    near = core(out.withColumn("__full", full), "time")
    ended = attach(near.drop("n"), _ends(core(out, "time"), value, half), "id")
    p, n = F.col("time"), F.col("n")
    edge = (p < half) | (p >= n - half)
    whole = (n > 1) & F.when(edge, 2 * p == n - 1).otherwise((p == half) & (n - 1 - p == rest))
    mean = (
        F.when(whole, F.get("head", (n - 2).cast("int")))
        .when(~edge, F.col("__full"))
        .when(p <= n - 1 - p, F.get("head", (2 * p).cast("int")))
        .otherwise(F.get("tail", (2 * (n - 1 - p)).cast("int")))
    )
    return ended.withColumn(name, mean).select(*sig.columns, name)


def sliding_mean_sym(sig: DataFrame, window: int) -> DataFrame:
    """Moving mean whose window shrinks symmetrically at the ends of the series."""
    return _sliding_avg(sig.select("id", "time", "signal_raw"), "signal_raw", window, "sliding_mean").drop("signal_raw")


def sliding_std_sym(sig: DataFrame, window: int) -> DataFrame:
    """Root of the mean squared distance to the point-wise sliding mean, in the same windows."""
    out = _sliding_avg(sig.select("id", "time", "signal_raw"), "signal_raw", window, "__m")
    out = out.select("id", "time", F.pow(F.col("signal_raw") - F.col("__m"), 2).alias("__d"))
    out = _sliding_avg(out, "__d", window, "__v")
    return out.select("id", "time", F.sqrt("__v").alias("sliding_std"))


def adaptive_avg_pool(sig: DataFrame, length: int) -> DataFrame:
    """Resample every series to ``length`` values: output i is the mean of ``floor(i n/L) .. ceil((i+1) n/L)-1``.

    Each sample names the outputs it belongs to, so the means come from one pre-aggregated grouping.
    """
    out = attach(sig.withColumn("block", block_of("time")), _sizes(sig), "id")
    first = F.expr(f"(CAST(time AS BIGINT) * {length}) div n")
    last = F.expr(f"((CAST(time AS BIGINT) + 1) * {length} + n - 1) div n - 1")
    out = out.select("id", "signal_raw", F.explode(F.sequence(first, last)).alias("pos"))
    return out.groupBy("id", F.col("pos").cast("int").alias("pos")).agg(F.avg("signal_raw").alias("pooled"))


def morlet(scale: int) -> np.ndarray:
    """Weights ``a**-0.5 * psi(lag/a)`` for ``|lag| <= 8 a`` with ``psi(t) = exp(-t*t/2) cos(5t)``."""
    u = np.arange(-8 * scale, 8 * scale + 1) / scale
    return np.exp(-u * u / 2) * np.cos(5 * u) / math.sqrt(scale)


def cwt_scalogram(sig: DataFrame, scales: list[int], dt: float = 0.001) -> DataFrame:
    """|wavelet coefficient| per (series, scale, time) and the pseudo-frequency ``0.8125 / (scale dt)``.

    A task convolves one block with its neighbours (``8 * max(scale)`` rows on each side), never a whole series.
    """
    reach, rows = 8 * max(scales), BLOCK_ROWS

    def convolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch["id"].to_pylist(), batch["block"].to_pylist())
            for (i, block), t, x in zip(keys, series_of(batch, "samples", "t"), series_of(batch, "samples")):
                keep = t // rows == block
                if not keep.any():
                    continue
                n = int(keep.sum())
                parts = []
                for a in scales:
                    k = morlet(a)  # symmetric, so convolution equals correlation
                    size = len(x) + len(k) - 1
                    full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(k, size), size)
                    parts.append(np.abs(full[8 * a : 8 * a + len(x)])[keep])
                yield pa.RecordBatch.from_pydict({
                    "id": np.full(n * len(scales), i),
                    "scale": np.repeat(np.array(scales, "int32"), n),
                    "time": np.tile(t[keep], len(scales)),
                    "magnitude": np.concatenate(parts),
                    "frequency": np.repeat([0.8125 / (a * dt) for a in scales], n),
                })

    near = with_halo(sig.select("id", "time", "signal_raw"), "id", "time", reach, reach)
    arrays = near.groupBy("id", "block").agg(ordered_samples("time", "signal_raw").alias("samples"))
    return arrays.mapInArrow(convolve, "id long, scale int, time long, magnitude double, frequency double")
