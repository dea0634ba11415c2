"""From the events of a stream of frames to the alarm store, messages and the log of gaps, each exactly once.

A micro-batch is computed and scored once and written whole below ``batches/batch=<id>``; its success marker commits it. The
sinks only ever read such a committed batch, and each writes under the batch's id, so that any of them can be repeated:
after a failure the query starts the batch again, finds it committed, and writes the same rows to the same places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.operators.model import alarm_message, predict_proba
from tremorline.operators.preprocess import TimePreprocessing
from tremorline.operators.score import features_of
from tremorline.operators.spectrum import FreqPreprocessing
from tremorline.operators.store import MAX_ALARMS, exists, read_store, sink_batch
from tremorline.session import materialize
from tremorline.streaming.crop_stream import ALARM

# (id, time, signal_raw) -> (id, probabilities)
Scorer = Callable[[DataFrame], DataFrame]

STORE, MESSAGES, GAPS, BATCHES = "store", "messages", "gaps", "batches"


def forest_scorer(
    model: PipelineModel, time: TimePreprocessing | None = None, freq: FreqPreprocessing | None = None
) -> Scorer:
    """Class probabilities by the feature table and a saved forest."""
    return lambda signals: predict_proba(model, features_of(signals, time, freq))


def score_events(events: DataFrame, score: Scorer) -> DataFrame:
    """The events of a micro-batch with the probabilities of its alarms.

    The batch is written once, as features read it several times; that also numbers its rows.
    """
    kept = materialize(events.withColumn("id", F.monotonically_increasing_id()), "events")
    alarms = kept.filter(F.col("kind") == ALARM)
    if alarms.isEmpty():  # nothing to plan a hundred features for
        return kept.drop("id").withColumn("probabilities", F.lit(None).cast("map<string,double>"))
    scored = score(alarms.select("id", F.posexplode("samples").alias("time", "signal_raw")))
    return kept.join(scored.select("id", "probabilities"), "id", "left").drop("id")


def committed(events: DataFrame, batch_id: int, root: str, score: Scorer) -> DataFrame:
    """The scored batch as it was first written; computed only if it is not there."""
    spark = events.sparkSession
    path = f"{root}/{BATCHES}/batch={batch_id}"
    if not exists(spark, f"{path}/_SUCCESS"):
        score_events(events, score).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _alarms(batch: DataFrame) -> DataFrame:
    """Rows of the alarm store; an alarm's number is that of its closing frame, which is its zone's own."""
    return batch.filter(F.col("kind") == ALARM).select(
        "zone", "date_time", F.col("close_frame").alias("alarm_id"), F.col("samples").alias("signal"), "probabilities",
        F.lit(None).cast("string").alias("label"),
    )


def alarm_chain(score: Scorer, root: str, keep: int = MAX_ALARMS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for ``stream_events``: store (with retention), messages and gaps below ``root``.

    ``messages`` has JSON lines (nchn, width, alarm, timestamp); ``gaps`` whatever was not an alarm, so that nothing is
    lost silently. Both have a folder per batch that is written anew when the batch is repeated.
    """
    store = sink_batch(f"{root}/{STORE}", keep)

    def run(events: DataFrame, batch_id: int) -> None:
        batch = committed(events, batch_id, root, score)
        alarms = _alarms(batch)
        store(alarms, batch_id)
        alarm_message(alarms).write.mode("overwrite").json(f"{root}/{MESSAGES}/batch={batch_id}")
        other = batch.filter(F.col("kind") != ALARM).select("zone", "kind", "first_frame", "close_frame", "date_time")
        other.write.mode("overwrite").parquet(f"{root}/{GAPS}/batch={batch_id}")

    return run


def read_chain(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """What the chain has written so far."""
    message = "nchn int, width int, alarm string, timestamp double"
    gap = "zone int, kind string, first_frame long, close_frame long, date_time timestamp"
    return {
        STORE: read_store(spark, f"{root}/{STORE}"),
        MESSAGES: spark.read.schema(message).json(f"{root}/{MESSAGES}/batch=*"),
        GAPS: spark.read.schema(gap).parquet(f"{root}/{GAPS}/batch=*"),
    }
