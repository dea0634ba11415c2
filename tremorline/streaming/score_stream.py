"""Real-time scoring: emitted alarms of a micro-batch go through features and model to a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.operators.model import predict_proba
from tremorline.operators.preprocess import TimePreprocessing
from tremorline.operators.score import features_of
from tremorline.operators.spectrum import FreqPreprocessing
from tremorline.session import materialize


def score_batch(
    model: PipelineModel,
    sink: Callable[[DataFrame, int], None],
    time: TimePreprocessing | None = None,
    freq: FreqPreprocessing | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for the alarms of ``stream_crop_alarms``.

    The micro-batch is written once, as features read it several times. ``sink`` gets (zone, close_frame, signal,
    probabilities) and the batch id, which makes repeated writes of a batch harmless.
    """

    def run(alarms: DataFrame, batch_id: int) -> None:
        kept = materialize(alarms.withColumn("id", F.monotonically_increasing_id()), "batch")
        signals = kept.select("id", F.posexplode("samples").alias("time", "signal_raw"))
        scored = predict_proba(model, features_of(signals, time, freq))
        sink(
            kept.join(scored, "id").select("zone", "close_frame", F.col("samples").alias("signal"), "probabilities"),
            batch_id,
        )

    return run
