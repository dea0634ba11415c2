"""From emitted alarms to class probabilities."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.functions.extract import all_features
from tremorline.operators.model import plain_columns, predict_proba
from tremorline.operators.preprocess import TimePreprocessing
from tremorline.operators.spectrum import FreqPreprocessing


# An alarm's id: its zone above these bits, its number in them.
NUMBER_BITS = 40


def alarm_id(zone: str = "zone", number: str = "alarm_no") -> Column:
    return F.shiftleft(F.col(zone).cast("long"), NUMBER_BITS) + F.col(number)


def zone_of(id: str = "id") -> Column:
    return F.shiftright(id, NUMBER_BITS).cast("int")


def number_of(id: str = "id") -> Column:
    return F.col(id).bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))


def alarm_signals(samples: DataFrame) -> DataFrame:
    """Alarm samples (zone, alarm_no, time, value) as a signal; the id combines zone and alarm number."""
    return samples.select(alarm_id().alias("id"), F.col("time").cast("long").alias("time"), F.col("value").alias("signal_raw"))


def features_of(
    sig: DataFrame, time: TimePreprocessing | None = None, freq: FreqPreprocessing | None = None
) -> DataFrame:
    """The feature table with ML-safe column names."""
    return plain_columns(all_features(sig, time, freq))


def score_alarms(
    model: PipelineModel,
    samples: DataFrame,
    time: TimePreprocessing | None = None,
    freq: FreqPreprocessing | None = None,
) -> DataFrame:
    """(zone, alarm_no, probabilities) of cropped alarms."""
    scored = predict_proba(model, features_of(alarm_signals(samples), time, freq))
    return scored.select(zone_of().alias("zone"), number_of().alias("alarm_no"), "probabilities")
