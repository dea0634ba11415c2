"""Long series and large groups: the same results when everything is split."""

import compare
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorline import blocks
from tremorline.plans import CHECKS, QUERIES

SPLIT = [
    "alarm_samples", "amplitude_spectrum", "crop_alarms", "curate_dataset", "cwt_scalogram", "f_agg_linear_trend",
    "f_change_quantiles", "f_count_below_mean", "f_energy_ratio_by_chunks", "f_fft_aggregated", "f_index_mass_quantile",
    "f_lempel_ziv_complexity", "f_longest_strike_below_mean", "f_number_peaks", "f_permutation_entropy", "f_quantile",
    "logbin_spectrum", "next_prev_alarm", "pending_alarm_status", "replay_frames", "rolling_mean", "series_tensor",
    "sliding_std_sym", "src_nested_store", "time_channels",
]


@pytest.mark.parametrize("name", SPLIT)
def test_split_series(spark, db, tiny_blocks, name):
    assert compare.differences(QUERIES[name](spark, compare.SF), db, CHECKS[name]) == []


def hot(spark, rows=3000, seed=1):
    """A third of all rows belongs to one key, and half of its values are equal."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(rows) < 0.34, 0, rng.integers(1, 200, rows))
    value = np.where(rng.random(rows) < 0.5, 7.0, rng.normal(size=rows).round(3))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(rows), "v": value})
    return spark.createDataFrame(pdf), pdf


def test_number_rows_of_hot_key(spark):
    df, pdf = hot(spark)
    got = blocks.number_rows(df, "k", F.col("t"), limit=50).toPandas().sort_values(["k", "t"])
    pdf = pdf.sort_values(["k", "t"])
    assert (got["time"].to_numpy() == pdf.groupby("k").cumcount().to_numpy()).all()


def test_quantiles_of_hot_key(spark):
    df, pdf = hot(spark)
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    got = blocks.exact_quantiles(df, "k", "v", qs, limit=50).toPandas().set_index("k").sort_index()
    for name, q in qs.items():
        want = pdf.groupby("k")["v"].quantile(q).sort_index()
        np.testing.assert_allclose(got[name], want, atol=1e-12)


def test_running_of_hot_key(spark):
    df, pdf = hot(spark)
    placed = blocks.number_rows(df, "k", F.col("t"))
    got = blocks.running(placed, "k", "time", {"s": F.col("v")}, {"m": F.when(F.col("v") < 7, F.col("time"))}, rows=32)
    got = got.toPandas().sort_values(["k", "time"])
    pdf = pdf.sort_values(["k", "t"])
    np.testing.assert_allclose(got["s"], pdf.groupby("k")["v"].cumsum(), atol=1e-9)
    marks = pdf.groupby("k").cumcount().where(pdf["v"] < 7).groupby(pdf["k"]).transform(lambda s: s.ffill())
    np.testing.assert_array_equal(got["m"].fillna(-1), marks.fillna(-1))


def test_dense_ids(spark):
    ids = [0, 1, 2, 5, 6, 10, 11]
    got = blocks.dense_ids(spark.createDataFrame([(i,) for i in ids], "id long")).orderBy("id").collect()
    assert [r["new_id"] for r in got] == list(range(7))
    sparse = sorted({int(i) for i in np.random.default_rng(0).integers(0, 10**12, 500)})
    got = blocks.dense_ids(spark.createDataFrame([(i,) for i in sparse], "id long")).orderBy("id").collect()
    assert [r["new_id"] for r in got] == list(range(len(sparse)))


def test_shuffled_rank_is_a_permutation(spark):
    got = blocks.shuffled_rank(spark.range(1000), 3).toPandas()
    assert sorted(got["rank"]) == list(range(1000)) and set(got["n"]) == {1000}


def slots(df, keys, by, limit):
    from tremorline import blocks

    slotted, offsets = blocks._split_large(df, keys, by, limit)
    assert offsets is not None
    return slotted.groupBy(*keys, "__slot").count().collect()


def skewed_values(kind, n=3000):
    rng = np.random.default_rng(8)
    return {
        "outlier": np.r_[rng.normal(size=n - 1), 1e12],
        "two sides": np.r_[rng.normal(size=n - 2), -1e300, 1.7e308],
        "powers": 2.0 ** rng.integers(-900, 900, n) * rng.random(n),
        "infinite": np.r_[rng.normal(size=n - 4), np.inf, -np.inf, np.inf, np.nan],
    }[kind]


@pytest.mark.parametrize("kind", ["outlier", "two sides", "powers", "infinite"])
def test_slots_of_any_distribution_stay_small(spark, kind):
    values = skewed_values(kind)
    rows = [(1, float(v)) for v in values] + [(2 + i % 300, float(i)) for i in range(6000)]  # a third in one key
    df = spark.createDataFrame(rows, "id long, v double")
    found = slots(df, ["id"], F.col("v"), 100)
    assert max(r["count"] for r in found) < 200
    assert sum(r["count"] for r in found) == len(rows)


@pytest.mark.parametrize("kind", ["outlier", "two sides", "powers"])
def test_quantiles_and_numbers_of_any_distribution(spark, kind):
    from tremorline import blocks

    values = skewed_values(kind, 700)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)] + [(2, 0, 5.0)], "id long, i long, v double")
    got = blocks.exact_quantiles(df, "id", "v", {"a": 0.1, "m": 0.5}, limit=50).filter("id = 1").first()
    assert got["a"] == pytest.approx(np.quantile(values, 0.1)) and got["m"] == pytest.approx(np.median(values))
    numbered = blocks.number_rows(df, "id", F.col("v"), ["i"], limit=50).filter("id = 1").orderBy("time").collect()
    assert [r["time"] for r in numbered] == list(range(700))
    assert [r["v"] for r in numbered] == sorted(values)


@pytest.mark.parametrize("rows", [16, 1 << 16])
def test_dense_ids_of_sparse_numbers(spark, monkeypatch, rows):
    from tremorline import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(4)
    high = 2**62 if rows > 16 else 2**30
    ids = sorted({*map(int, rng.integers(-high, high, 300)), 0, 1, -1, high, -high, *range(50, 90)})
    df = spark.createDataFrame([(i,) for i in ids * 2], "id long")
    got = blocks.dense_ids(df).orderBy("id").collect()
    assert [(r["id"], r["new_id"]) for r in got] == [(i, k) for k, i in enumerate(ids)]
    assert blocks.dense_ids(df.filter("id is null")).count() == 0
