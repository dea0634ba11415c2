"""Labelled series from directories and from the alarm store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.blocks import number_rows
from tremorline.operators.curate import Dataset
from tremorline.operators.store import UNKNOWN, read_store


def _numbered(series: DataFrame, group: str, by: Column, ties: list[str]) -> DataFrame:
    """Dense ids over (group, by): rows of a group are numbered and shifted by the sizes of the groups before."""
    placed = number_rows(series, group, by, ties, "__place")
    sizes = series.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(group, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    # one row per class or zone; the join leaves the choice of a broadcast to the size Spark measures
    return placed.join(shift, group).withColumn("id", F.col("__place") + F.col("__shift")).drop("__place", "__shift")


def _long(series: DataFrame, label: Column) -> Dataset:
    signals = series.select("id", F.posexplode("signal").alias("time", "signal_raw"))
    return Dataset(
        signals.select("id", F.col("time").cast("long").alias("time"), F.col("signal_raw").cast("double").alias("signal_raw")),
        series.select("id", label.alias("label")),
    )


def read_simple_dir(spark: SparkSession, path: str, label_from: str = "file") -> Dataset:
    """Series (key, signal) from the files of a directory.

    The class is the file name without its extension, or, with ``label_from="folder"``, the name of the folder (the
    part after ``=``), as a class written by many tasks has many files.
    """
    pattern = r"([^/]+)\.[^./]+$" if label_from == "file" else r"([^/=]+)/[^/]+$"
    files = spark.read.option("recursiveFileLookup", "true").parquet(path)
    series = files.select("key", "signal", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("label"))
    return _long(_numbered(series, "label", F.col("key"), []), F.col("label"))


def read_nested_store(spark: SparkSession, path: str) -> Dataset:
    """Every alarm of a store as a series; alarms without a label are ``unknown``."""
    alarms = read_store(spark, path)
    series = _numbered(alarms, "zone", F.unix_micros("date_time"), ["alarm_id"])
    return _long(series, F.coalesce("label", F.lit(UNKNOWN)))


def unknown_label_report(alarms: DataFrame) -> DataFrame:
    """Zone and time of each alarm without a label."""
    return alarms.filter(F.col("label").isNull()).select("zone", "date_time")
