"""The shared tables as signals, frames, traces, classes and alarms (both for Spark and as check SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.blocks import number_rows
from tremorline.session import tune

ZONES = 8
FRAME = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rounded_value(c: Column | str, digits: int = 6) -> Column:
    """Round; NaN becomes NULL and -0.0 becomes 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    rounded = F.round(c.cast("double"), digits)
    return F.when(F.isnan(rounded), F.lit(None)).otherwise(rounded + F.lit(0.0))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[rounded_value(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# --- signals -------------------------------------------------------------------------------------------------------


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, time, signal_raw): the values of one user are one series."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    numbered = number_rows(events, "user_id", micros(), ["event_id"])
    return numbered.select(
        F.col("user_id").alias("id"), "time", F.col("value").alias("signal_raw")
    )


SIG = """sig AS (
  SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS time,
         value AS signal_raw
  FROM events)"""

NORM = """norm AS (
  SELECT id, time, (signal_raw - min(signal_raw) OVER (PARTITION BY id))
         / nullif(max(signal_raw) OVER (PARTITION BY id) - min(signal_raw) OVER (PARTITION BY id), 0) AS signal_raw
  FROM sig)"""



def channels_sql(mean_window: int = 128) -> str:
    """sig, norm and chan (id, time, signal_raw, signal_std, signal_mean) as common table expressions."""
    after = (mean_window - 1) // 2
    return f"""{SIG}, {NORM}, chan AS (
  SELECT id, time, signal_raw,
         stddev_samp(signal_raw) OVER (PARTITION BY id ORDER BY time ROWS BETWEEN 16 PRECEDING AND 15 FOLLOWING)
           AS signal_std,
         avg(signal_raw) OVER (PARTITION BY id ORDER BY time
                               ROWS BETWEEN {mean_window - 1 - after} PRECEDING AND {after} FOLLOWING) AS signal_mean
  FROM norm)"""


# --- zones and frames ----------------------------------------------------------------------------------------------


def timed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, sample_idx, value, date_time): every zone is one continuous recording."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % ZONES).cast("int").alias("zone"), "ts", "event_id", "value"
    )
    numbered = number_rows(events, "zone", micros(), ["event_id"], "sample_idx")
    return numbered.select("zone", "sample_idx", "value", F.col("ts").cast("timestamp").alias("date_time"))


def zone_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_samples(spark, sf_dir).drop("date_time")


def frame_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, frame_no, sample_idx, value) with 20-sample frames."""
    return zone_samples(spark, sf_dir).withColumn("frame_no", F.expr(f"sample_idx div {FRAME}"))


def frame_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, frame_no, samples, date_time): whole frames, at the time of their last sample."""
    frames = timed_samples(spark, sf_dir).withColumn("frame_no", F.expr(f"sample_idx div {FRAME}"))
    samples = F.sort_array(F.collect_list(F.struct("sample_idx", "value")))["value"]
    return frames.groupBy("zone", "frame_no").agg(samples.alias("samples"), F.max("date_time").alias("date_time"))


def uneven_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, frame_no, sample_idx, value) with frames of 2, 3 and 7 samples and gaps in their numbers."""
    place = F.col("sample_idx") % 12
    part = F.when(place < 2, 0).when(place < 5, 1).otherwise(2)
    number = F.expr("sample_idx div 12 * 3 + sample_idx div 60 * 4")
    return zone_samples(spark, sf_dir).withColumn("frame_no", number + part)


ZONE_SAMPLES = f"""samples AS (
  SELECT CAST(user_id % {ZONES} AS INTEGER) AS zone,
         row_number() OVER (PARTITION BY user_id % {ZONES} ORDER BY ts, event_id) - 1 AS sample_idx, value
  FROM events)"""

FRAMES = f"""{ZONE_SAMPLES}, frames AS (
  SELECT zone, sample_idx // {FRAME} AS frame_no, sample_idx, value FROM samples)"""


FRAME_TIMES = f"""times AS (
  SELECT zone, sample_idx // {FRAME} AS frame_no, max(ts) AS date_time
  FROM (SELECT CAST(user_id % {ZONES} AS INTEGER) AS zone, ts,
               row_number() OVER (PARTITION BY user_id % {ZONES} ORDER BY ts, event_id) - 1 AS sample_idx FROM events)
  GROUP BY ALL)"""

# frame_no is the place of a frame, as the machine takes them one after the other; raw_no is its number
UNEVEN_FRAMES = f"""{ZONE_SAMPLES}, raw AS (
  SELECT zone, sample_idx, value, (sample_idx // 12) * 3 + (sample_idx // 60) * 4
         + CASE WHEN sample_idx % 12 < 2 THEN 0 WHEN sample_idx % 12 < 5 THEN 1 ELSE 2 END AS raw_no FROM samples),
frames AS (
  SELECT zone, dense_rank() OVER (PARTITION BY zone ORDER BY raw_no) - 1 AS frame_no, raw_no, sample_idx, value FROM raw)"""


# --- arrays --------------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("samples"), "label"
    )


# --- classes -------------------------------------------------------------------------------------------------------


def class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label")
    )


def signal_labels(sig: DataFrame) -> DataFrame:
    return sig.filter(F.col("time") == 0).select("id", F.concat(F.lit("c"), F.col("id") % 5).alias("label"))


# --- alarms --------------------------------------------------------------------------------------------------------


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, date_time, alarm_id, label, value, props): every event is one alarm of its zone."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % ZONES).cast("int").alias("zone"),
        F.col("ts").cast("timestamp").alias("date_time"),
        F.col("event_id").alias("alarm_id"),
        F.col("event_type").alias("label"),
        "value",
        "props",
    )


ALARMS = f"""alarms AS (
  SELECT CAST(user_id % {ZONES} AS INTEGER) AS zone, ts AS date_time, event_id AS alarm_id, event_type AS label,
         value, props, strftime(ts, '%Y_%m_%d') AS date, strftime(ts, '%Hh') AS hour
  FROM events)"""
