"""Features of the spectrum: moments of |DFT| and the entropy of the Welch density."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline.blocks import ordered_samples, series_of
from tremorline.functions.catalog import Feature
from tremorline.functions.source import Source
from tremorline.operators.spectrum import half_spectrum

SEGMENT = 256  # fixed value: longest Welch segment; neighbours overlap by half


def fft_aggregated(src: Source, features: list[Feature]) -> DataFrame:
    """Centroid and variance of the frequency number, weighted by |DFT| (constant part included)."""
    rows, out = src.rows, None
    for channel in dict.fromkeys(f.channel for f in features):
        spec = half_spectrum(rows.filter(F.col(channel).isNotNull()), "pos", channel, largest=src.largest)
        a, k = F.col("a"), F.col("k")
        mass = F.sum(a)
        first, second = F.try_divide(F.sum(k * a), mass), F.try_divide(F.sum(k * k * a), mass)
        wanted = [
            (first if f["aggtype"] == "centroid" else second - first * first).alias(f"f{i}")
            for i, f in enumerate(features)
            if f.channel == channel
        ]
        one = spec.groupBy("id").agg(*wanted)
        out = one if out is None else out.join(one, "id", "outer")
    return out


def _segments(x: np.ndarray, first: bool) -> np.ndarray:
    """Half-overlapping segments as rows; a series below one segment is a segment of its own."""
    if len(x) >= SEGMENT:
        return np.lib.stride_tricks.sliding_window_view(x, SEGMENT)[:: SEGMENT // 2]
    return x[None, :] if first else x[None, :0]


def _power(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed one-sided periodograms of the segments that start in a block, and their number."""
    for batch in batches:
        ids, out = [], []
        for i, block, x in zip(batch["id"].to_pylist(), batch["block"].to_pylist(), series_of(batch, "samples")):
            seg = _segments(x, block == 0)
            m, n = seg.shape
            if n == 0:
                continue
            window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
            power = np.abs(np.fft.rfft((seg - seg.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
            power = power.sum(axis=0) / (window**2).sum()
            power[1 : None if n % 2 else -1] *= 2
            ids.append((i, m))
            out.append(power)
        if out:
            counts = [len(p) for p in out]
            yield pa.RecordBatch.from_pydict({
                "id": np.repeat([i for i, _ in ids], counts),
                "k": np.concatenate([np.arange(c) for c in counts]),
                "m": np.repeat([m for _, m in ids], counts),
                "power": np.concatenate(out),
            })


def welch_density(src: Source, channel: str) -> DataFrame:
    """(id, k, density): mean one-sided periodogram of half-overlapping Hann segments, mean removed per segment.

    A block, with the few rows after it that its last segments need, is the unit of work; the periodograms of the blocks
    of a long series are added up afterwards.
    """
    # the last segment of a block starts half a segment before its end
    rows = src.framed(0, SEGMENT // 2).filter(F.col(channel).isNotNull())
    arrays = rows.groupBy("id", "block").agg(ordered_samples("pos", channel).alias("samples"))
    power = arrays.mapInArrow(_power, "id long, k long, m long, power double")
    return power.groupBy("id", "k").agg((F.sum("power") / F.sum("m")).alias("density"))


def fourier_entropy(src: Source, features: list[Feature]) -> DataFrame:
    """Entropy of a histogram of the Welch density (at most SEGMENT / 2 + 1 values per series)."""
    out = None
    for channel in dict.fromkeys(f.channel for f in features):
        mine = [(i, f["bins"]) for i, f in enumerate(features) if f.channel == channel]
        series = Window.partitionBy("id")
        scaled = (
            welch_density(src, channel)
            .withColumns({"top": F.max("density").over(series), "low": F.min("density").over(series)})
            .select("id", F.try_divide("density", "top").alias("d"), F.try_divide("low", "top").alias("lo"))
        )
        share = F.coalesce(F.try_divide(F.col("d") - F.col("lo"), 1 - F.col("lo")), F.lit(0.0))
        slots = F.array(*[F.least(F.floor(share * b), F.lit(b - 1)) for _, b in mine])
        counts = (
            scaled.select("id", F.posexplode(slots).alias("which", "slot"))
            .groupBy("id", "which", "slot")
            .agg(F.count(F.lit(1)).alias("c"))
        )
        picks = []
        for which, (i, _) in enumerate(mine):
            c = F.when(F.col("which") == which, F.col("c"))
            picks.append((F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)).alias(f"f{i}"))
        one = counts.groupBy("id").agg(*picks)
        out = one if out is None else out.join(one, "id", "outer")
    return out
