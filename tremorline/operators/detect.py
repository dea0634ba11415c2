"""Energy detection: frames against the noise of a quiet first frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def frame_summary(frames: DataFrame) -> DataFrame:
    """One row per frame of (zone, frame_no, sample_idx, value); positions count from the start of the frame."""
    out = frames.groupBy("zone", "frame_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("sample_idx").alias("first_sample"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.median("value").alias("median"),
        F.min(F.struct("value", "sample_idx"))["sample_idx"].alias("__argmin"),
        F.max(F.struct("value", (-F.col("sample_idx")).alias("neg")))["neg"].alias("__argmax"),
    )
    return out.select(
        "zone", "frame_no", "n", "first_sample", "std", "lo", "hi", "median",
        (F.col("__argmin") - F.col("first_sample")).alias("argmin"),
        (-F.col("__argmax") - F.col("first_sample")).alias("argmax"),
    )


def peak() -> Column:
    """Position of the larger swing from the median; the first one among equals."""
    down = (F.col("hi") - F.col("median")) < (F.col("median") - F.col("lo"))
    return F.when(down, F.col("argmin")).otherwise(F.col("argmax"))


def noise_fit(frames: DataFrame) -> DataFrame:
    """Noise std and mean per zone from frame 0 (the filter reaches the scan; frame 0 is of bounded size)."""
    return (
        frames.filter(F.col("frame_no") == 0)
        .groupBy("zone")
        .agg(F.stddev_pop("value").alias("noise_std"), F.avg("value").alias("noise_mean"))
    )


def exceeds(std: Column, noise: Column, threshold: float) -> Column:
    """``std / noise > threshold``; silent noise is exceeded by any signal, and never by silence."""
    return F.when(noise == 0, std > 0).otherwise(std / F.nullif(noise, F.lit(0.0)) > threshold)


def detect_frames(summary: DataFrame, threshold: float, noise: DataFrame) -> DataFrame:
    """Add noise_std, ratio and detected to frame summaries; ``noise`` has one row per zone."""
    noise = noise.select("zone", "noise_std")
    # a zone may hold a third of all frames: spread its rows and its noise row over parts of the frame numbers
    parts = 64
    spread = noise.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return (
        summary.withColumn("__part", F.pmod(F.hash("frame_no"), F.lit(parts)))
        .join(spread, ["zone", "__part"])
        .drop("__part")
        .withColumn("ratio", F.try_divide(F.col("std"), F.col("noise_std")))
        .withColumn("detected", exceeds(F.col("std"), F.col("noise_std"), threshold))
    )
