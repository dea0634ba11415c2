"""Ordered channels of many series, as the feature functions read them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.blocks import block_of, core, longest, trim, with_halo
from tremorline.operators.preprocess import TimePreprocessing
from tremorline.session import scratch_path

# Neighbours stored with every block: enough for all lags (10) and for a spectral segment (256).
STORED_BACK, STORED_AHEAD = 16, 256


@dataclass
class Source:
    """Series with one or more channels.

    ``framed(back, ahead)`` gives rows (id, pos, block, channels...) with the neighbours of each block, partitioned by
    (id, block); ``rows`` the same without neighbours; ``ids`` the id of every row. ``pos`` runs 0, 1, ... per series.
    """

    framed: Callable[[int, int], DataFrame]
    rows: DataFrame
    channels: tuple[str, ...]
    ids: DataFrame

    @cached_property
    def largest(self) -> int:
        """Rows of the longest series."""
        return longest(self.ids)


def _flat(df: DataFrame, pos: str, channels: tuple[str, ...]) -> DataFrame:
    return df.select("id", F.col(pos).cast("long").alias("pos"), *channels)


def table_source(df: DataFrame, pos: str, *channels: str) -> Source:
    flat = _flat(df, pos, channels)
    return Source(
        lambda back, ahead: with_halo(flat, "id", "pos", back, ahead),
        flat.withColumn("block", block_of("pos")),
        channels,
        flat.select("id"),
    )


def _time_frame(sig: DataFrame, prep: TimePreprocessing, back: int, ahead: int) -> DataFrame:
    out = prep.framed(sig, back, ahead)
    return out.select("id", F.col("time").cast("long").alias("pos"), "block", "signal_std", "signal_mean")


def time_source(sig: DataFrame, prep: TimePreprocessing) -> Source:
    """The filtered channels, with lags sharing the exchange and sort of the rolling windows."""
    return Source(
        lambda back, ahead: _time_frame(sig, prep, back, ahead),
        core(_time_frame(sig, prep, 0, 0), "pos"),
        ("signal_std", "signal_mean"),
        sig.select("id"),
    )


def _stored(frame: DataFrame, channels: tuple[str, ...]) -> Source:
    """Write blocks with their neighbours to the shared folder, bucketed by (id, block).

    The passes over the series read the buckets in place: windows, groups and joins by (id, block) need no exchange.
    ``frame`` is hash-partitioned by (id, block) already, so every bucket is one file.
    """
    spark = frame.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"channels_{uuid.uuid4().hex}"
    writer = frame.write.bucketBy(buckets, "id", "block").sortBy("id", "block", "pos")
    writer.option("path", scratch_path(spark, name)).saveAsTable(name)
    table = spark.table(name)

    def framed(back: int, ahead: int) -> DataFrame:
        if back > STORED_BACK or ahead > STORED_AHEAD:
            raise ValueError(f"only {STORED_BACK} rows before and {STORED_AHEAD} after a block are stored")
        return trim(table, "pos", back, ahead)

    rows = core(table, "pos")
    return Source(framed, rows, channels, rows.select("id"))


def stored_table(df: DataFrame, pos: str, *channels: str) -> Source:
    return _stored(with_halo(_flat(df, pos, channels), "id", "pos", STORED_BACK, STORED_AHEAD), channels)


def stored_time(sig: DataFrame, prep: TimePreprocessing) -> Source:
    """The filtered channels, written straight from the rolling windows."""
    return _stored(_time_frame(sig, prep, STORED_BACK, STORED_AHEAD), ("signal_std", "signal_mean"))
