import numpy as np
import pytest

from tremorline.operators import preprocess

# First and last sample of the window of every row, by hand: (window, spans of a series).
SPANS = [
    (3, [(0, 0), (1, 1)]),
    (3, [(0, 0), (0, 1), (2, 2)]),
    (4, [(0, 0), (0, 2), (1, 3), (3, 3)]),
    (9, [(0, 0), (0, 2), (0, 3), (2, 4), (4, 4)]),
    (7, [(0, 0), (0, 2), (0, 4), (0, 5), (2, 6), (4, 6), (6, 6)]),
    (5, [(0, 0), (0, 2), (0, 4), (1, 5), (2, 6), (3, 7), (5, 7), (7, 7)]),
    (4, [(0, 0), (0, 2), (0, 3), (1, 4), (3, 5), (5, 5)]),
]


@pytest.mark.parametrize("window, spans", SPANS)
def test_symmetric_windows(spark, window, spans):
    x = np.random.default_rng(window).standard_normal(len(spans))
    sig = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(x)], "id long, time long, signal_raw double")
    mean = np.array([x[a : b + 1].mean() for a, b in spans])
    std = np.array([np.sqrt(((x[a : b + 1] - mean[a : b + 1]) ** 2).mean()) for a, b in spans])
    got = [r.sliding_mean for r in preprocess.sliding_mean_sym(sig, window).orderBy("time").collect()]
    assert got == pytest.approx(mean)
    got = [r.sliding_std for r in preprocess.sliding_std_sym(sig, window).orderBy("time").collect()]
    assert got == pytest.approx(std, abs=1e-9)


def loop(x, window):
    """The two-pointer window, row by row."""
    n, half, rest, out = len(x), window // 2, (window - 1) // 2, []
    for p in range(n):
        back, ahead = (min(p, n - 1 - p),) * 2 if p < half or p >= n - half else (half, rest)
        ahead -= n > 1 and back == p and ahead == n - 1 - p
        out.append(np.mean(x[p - back : p + ahead + 1]))
    return np.array(out)


@pytest.fixture(scope="module")
def short_series(spark):
    rng = np.random.default_rng(0)
    series = {n: rng.normal(size=n).round(3) for n in (*range(1, 13), 40)}
    rows = [(n, t, float(v)) for n, x in series.items() for t, v in enumerate(x)]
    return series, spark.createDataFrame(rows, "id long, time long, signal_raw double").persist()


@pytest.mark.parametrize("window", range(1, 15))
def test_symmetric_windows_equal_the_loop(short_series, window):
    series, sig = short_series
    mean = preprocess.sliding_mean_sym(sig, window).toPandas().sort_values(["id", "time"])
    std = preprocess.sliding_std_sym(sig, window).toPandas().sort_values(["id", "time"])
    for n, x in series.items():
        m = loop(x, window)
        assert mean[mean.id == n].sliding_mean.to_numpy() == pytest.approx(m)
        assert std[std.id == n].sliding_std.to_numpy() == pytest.approx(np.sqrt(loop((x - m) ** 2, window)), abs=1e-9)


def test_plan_does_not_grow_with_the_window(short_series):
    _, sig = short_series
    sizes = [len(preprocess.sliding_mean_sym(sig, w)._jdf.queryExecution().analyzed().toString()) for w in (5, 501)]
    assert abs(sizes[0] - sizes[1]) < 200


def test_a_null_leaves_its_windows_without_mean(spark):
    rows = [(1, t, None if t == 3 else float(t)) for t in range(9)]
    sig = spark.createDataFrame(rows, "id long, time long, signal_raw double")
    got = [r.sliding_mean for r in preprocess.sliding_mean_sym(sig, 3).orderBy("time").collect()]
    assert got == [0.0, 1.0, None, None, None, 5.0, 6.0, 7.0, 8.0]
