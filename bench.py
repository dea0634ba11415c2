"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tremorline.plans import QUERIES
from tremorline.session import local_session

HEADLINE = [
    "time_channels",
    "rolling_mean",
    "adaptive_avg_pool",
    "cwt_scalogram",
    "amplitude_spectrum",
    "logbin_spectrum",
    "detect_frames",
    "crop_alarms",
    "alarm_samples",
    "stream_crop_alarms",
    "f_quantile",
    "f_number_peaks",
    "f_permutation_entropy",
    "f_agg_linear_trend",
    "f_fourier_entropy",
    "f_ar_coefficient",
    "f_lempel_ziv_complexity",
    "feature_table",
    "curate_dataset",
    "series_tensor",
    "train_tuned_rf",
    "hour_ring_buffer",
    "alarm_counts_rollup",
    "next_prev_alarm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["minmax_normalize"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the workers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    samples = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    print(
        json.dumps({
            "metric": "total seconds of the headline queries",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": os.path.basename(sf_dir.rstrip("/")),
            "feature_samples_per_sec": round(samples / seconds["feature_table"], 1),
        })
    )


if __name__ == "__main__":
    main()
