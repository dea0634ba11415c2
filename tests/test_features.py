"""Features that SQL checks cannot cover at their real sizes, against numpy."""

import numpy as np
import pytest

from tremorline.functions import extract, sequential, spectral
from tremorline.functions.catalog import FREQ_FEATURES, TIME_FEATURES, feature, listed
from tremorline.functions.source import table_source
from tremorline.operators.spectrum import half_spectrum


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    return {
        0: np.cumsum(rng.normal(size=700)),
        1: rng.normal(size=256),
        2: np.convolve(rng.normal(size=400), np.ones(16) / 16, "valid"),
        3: rng.normal(size=15),
        4: rng.normal(size=2),
        5: np.full(40, 3.0),
    }


@pytest.fixture(scope="module")
def source(spark, series):
    rows = [(i, t, float(v)) for i, x in series.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, pos long, x double")
    return lambda: table_source(df, "pos", "x")


def values(df, name):
    return {r["id"]: r[name] for r in df.collect()}


def test_catalog_has_the_hundred_features():
    assert len(listed(TIME_FEATURES)) == 74 and len(listed(FREQ_FEATURES)) == 26
    names = {f.name for f in listed(TIME_FEATURES) + listed(FREQ_FEATURES)}
    assert len(names) == 100
    assert 'signal_mean__agg_linear_trend__attr_"rvalue"__chunk_len_50__f_agg_"min"' in names
    assert "signal_std__quantile__q_0.1" in names


@pytest.mark.parametrize("rows", [64, 1 << 16])
def test_autoregression(source, series, monkeypatch, rows):
    monkeypatch.setattr("tremorline.blocks.BLOCK_ROWS", rows)
    monkeypatch.setattr(sequential, "FACTORS_PER_GROUP", 3)
    got = {r["id"]: r["coeffs"] for r in sequential.autoregression(source(), "x", 10).collect()}
    for i in (0, 1, 2):
        x, k = series[i], 10
        lags = np.column_stack([np.ones(len(x) - k)] + [x[k - j : len(x) - j] for j in range(1, k + 1)])
        want = np.linalg.lstsq(lags, x[k:], rcond=None)[0]
        np.testing.assert_allclose(got[i], want, rtol=1e-6, atol=1e-8)
    assert got[3] is None and got[4] is None  # fewer rows than coefficients


def test_half_spectrum_long_and_short(source, series):
    rows = source().rows
    for limit in (1 << 20, 100):
        got = half_spectrum(rows, "pos", "x", limit).toPandas().sort_values(["id", "k"])
        for i, x in series.items():
            np.testing.assert_allclose(got[got["id"] == i]["a"], np.abs(np.fft.rfft(x)), atol=1e-7)


@pytest.mark.parametrize("rows", [256, 1 << 16])
def test_welch_density_of_several_segments(source, series, monkeypatch, rows):
    monkeypatch.setattr("tremorline.blocks.BLOCK_ROWS", rows)
    got = spectral.welch_density(source(), "x").toPandas().sort_values("k")
    for i in (0, 1, 3):
        x = series[i]
        size = min(len(x), 256)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        parts = [x[a : a + size] for a in range(0, len(x) - size + 1, max(size // 2, 1) if size == 256 else size)]
        power = [np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 / (window**2).sum() for p in parts]
        want = np.mean(power, axis=0)
        want[1 : None if size % 2 else -1] *= 2
        np.testing.assert_allclose(got[got["id"] == i]["density"], want, atol=1e-9)


def test_constant_and_short_series(source):
    fs = [
        feature("x", "variance"), feature("x", "skewness"), feature("x", "kurtosis"), feature("x", "cid_ce", normalize=True),
        feature("x", "binned_entropy", max_bins=10), feature("x", "lempel_ziv_complexity", bins=5),
        feature("x", "permutation_entropy", dimension=3, tau=1), feature("x", "agg_linear_trend", attr="rvalue", chunk_len=5, f_agg="max"),
        feature("x", "longest_strike_below_mean"), feature("x", "c3", lag=1),
    ]
    wide = extract.compute((source(), fs))
    got = {r["id"]: {f.function: r[f.name] for f in fs} for r in wide.collect()}
    constant, short = got[5], got[4]
    zero = ("variance", "skewness", "kurtosis", "cid_ce", "binned_entropy", "agg_linear_trend", "permutation_entropy")
    assert all(constant[k] == pytest.approx(0, abs=1e-12) for k in zero)
    assert constant["longest_strike_below_mean"] == 0
    assert short["skewness"] is None and short["kurtosis"] is None and short["permutation_entropy"] is None
    assert short["agg_linear_trend"] is None and short["c3"] == 0


def test_phrases(spark):
    # symbols 0 1 1 0 0 1 0 1 ... parsed into 0 | 1 | 10 | 01 | 011 | (1 is known already)
    bits = [0, 1, 1, 0, 0, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(bits)], "id long, pos long, x double")
    got = extract.compute((table_source(df, "pos", "x"), [feature("x", "lempel_ziv_complexity", bins=2)])).collect()
    assert got[0][1] == pytest.approx(5 / 10)
