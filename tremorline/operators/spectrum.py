"""Amplitude spectra and their logarithmic bins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline import blocks
from tremorline.blocks import longest, ordered_samples, series_of
from tremorline.operators.longdft import long_half_spectrum

# Series below this length are transformed as one array (8 MB); longer ones take the distributed transform.
ARRAY_ROWS = 1 << 20


def _array_spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["id"].to_numpy()
        sizes, amplitudes = [], []
        for x in series_of(batch, "samples"):
            sizes.append(len(x))
            amplitudes.append(np.abs(np.fft.rfft(x)))
        counts = [len(a) for a in amplitudes]
        if counts:
            yield pa.RecordBatch.from_pydict({
                "id": np.repeat(ids, counts),
                "k": np.concatenate([np.arange(c) for c in counts]),
                "n": np.repeat(np.array(sizes, "int64"), counts),
                "a": np.concatenate(amplitudes),
            })


def half_spectrum(
    df: DataFrame, pos: str, value: str, array_rows: int | None = None, largest: int | None = None
) -> DataFrame:
    """|DFT| of every series: (id, k, n, a) for k = 0 .. n div 2, unscaled. ``pos`` must be dense.

    The distributed transform is planned only if a series (``largest`` = rows of the longest one) is too long for an
    array.
    """
    limit = array_rows or ARRAY_ROWS
    largest = longest(df) if largest is None else largest
    schema = "id long, k long, n long, a double"
    if "block" not in df.columns:
        df = df.withColumn("block", blocks.block_of(pos))
    if largest <= min(limit, blocks.BLOCK_ROWS):
        # every series is one block
        whole = df.groupBy("id", "block").agg(ordered_samples(pos, value).alias("samples"))
        return whole.select("id", "samples").mapInArrow(_array_spectra, schema)
    part = F.floor(F.col(pos) / F.lit(limit)).cast("long")
    parts = df.groupBy("id", part.alias("part")).agg(ordered_samples(pos, value).alias("samples"))
    if largest < limit:
        return parts.select("id", "samples").mapInArrow(_array_spectra, schema)
    alone = (F.col("part") == 0) & (F.size("samples") < limit)
    short = parts.filter(alone).select("id", "samples").mapInArrow(_array_spectra, schema)
    long = parts.filter(~alone).select("id", F.inline("samples"))
    return short.unionByName(long_half_spectrum(long))


def amplitude_spectrum(sig: DataFrame, fs: float = 1000.0, array_rows: int | None = None) -> DataFrame:
    """``2/n |rfft|`` without the constant part, and the frequency ``k fs / n``."""
    spec = half_spectrum(sig, "time", "signal_raw", array_rows).filter(F.col("k") > 0)
    return spec.select(
        "id",
        "k",
        (F.col("k") * F.lit(float(fs)) / F.col("n")).alias("freq"),
        (F.lit(2.0) / F.col("n") * F.col("a")).alias("amplitude"),
    )


@dataclass(frozen=True)
class FreqPreprocessing:
    """Signal -> spectrum averaged in ``n_bins`` bins of equal width in log frequency.

    Frequency number k of K falls in bin ``floor(n_bins ln k / ln K)``; rounding to 9 digits keeps exact edges in their
    upper bin. The top frequency is dropped and empty bins are closed up.
    """

    n_bins: int = 70
    fs: float = 1000.0
    array_rows: int | None = None

    def transform(self, sig: DataFrame) -> DataFrame:
        spec = half_spectrum(sig, "time", "signal_raw", self.array_rows)
        top = F.floor(F.col("n") / 2)
        binned = spec.filter((F.col("k") > 0) & (F.col("k") < top)).select(
            "id",
            F.floor(F.round(F.lit(self.n_bins) * F.log("k") / F.log(top.cast("double")), 9)).alias("bin"),
            (F.lit(2.0) / F.col("n") * F.col("a")).alias("amplitude"),
        )
        means = binned.groupBy("id", "bin").agg(F.avg("amplitude").alias("signal_binned_fft"))
        order = Window.partitionBy("id").orderBy("bin")  # at most n_bins rows
        return means.select("id", (F.row_number().over(order) - 1).alias("freq_num"), "signal_binned_fft")
