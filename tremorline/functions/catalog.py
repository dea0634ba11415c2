"""Which features belong to the feature table, and how their columns are called."""

from __future__ import annotations

from dataclasses import dataclass

# The 100 features of the trained classifiers, by channel.
TIME_FEATURES = {
    "signal_mean": {
        "absolute_sum_of_changes": [{}],
        "agg_linear_trend": [{"attr": "rvalue", "chunk_len": 50, "f_agg": "min"}],
        "ar_coefficient": [{"coeff": 1, "k": 10}],
        "binned_entropy": [{"max_bins": 10}],
        "count_below_mean": [{}],
        "fft_aggregated": [{"aggtype": a} for a in ("centroid", "variance")],
        "lempel_ziv_complexity": [{"bins": 100}],
        "number_peaks": [{"n": n} for n in (1, 3, 5, 10)],
        "permutation_entropy": [{"dimension": d, "tau": 1} for d in (3, 4, 5, 6, 7)],
        "ratio_beyond_r_sigma": [{"r": r} for r in (0.5, 1, 3)],
    },
    "signal_std": {
        "absolute_sum_of_changes": [{}],
        "agg_linear_trend": [
            {"attr": "intercept", "chunk_len": 5, "f_agg": "max"},
            {"attr": "intercept", "chunk_len": 5, "f_agg": "mean"},
            {"attr": "intercept", "chunk_len": 5, "f_agg": "min"},
            {"attr": "intercept", "chunk_len": 10, "f_agg": "max"},
            {"attr": "intercept", "chunk_len": 50, "f_agg": "mean"},
            {"attr": "intercept", "chunk_len": 50, "f_agg": "min"},
            {"attr": "stderr", "chunk_len": 50, "f_agg": "mean"},
        ],
        "ar_coefficient": [{"coeff": c, "k": 10} for c in (0, 1)],
        "benford_correlation": [{}],
        "binned_entropy": [{"max_bins": 10}],
        "c3": [{"lag": lag} for lag in (1, 2, 3)],
        "cid_ce": [{"normalize": z} for z in (False, True)],
        "count_above_mean": [{}],
        "fft_aggregated": [{"aggtype": "variance"}],
        "fourier_entropy": [{"bins": b} for b in (3, 5, 10, 100)],
        "index_mass_quantile": [{"q": q} for q in (0.4, 0.6, 0.7, 0.8, 0.9)],
        "kurtosis": [{}],
        "lempel_ziv_complexity": [{"bins": b} for b in (5, 100)],
        "longest_strike_below_mean": [{}],
        "median": [{}],
        "minimum": [{}],
        "number_peaks": [{"n": n} for n in (1, 3)],
        "permutation_entropy": [{"dimension": d, "tau": 1} for d in (3, 7)],
        "quantile": [{"q": q} for q in (0.1, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)],
        "range_count": [{"max": 1, "min": -1}, {"max": 1000000000000.0, "min": 0}],
        "ratio_beyond_r_sigma": [{"r": 0.5}],
        "root_mean_square": [{}],
        "skewness": [{}],
        "standard_deviation": [{}],
        "sum_values": [{}],
        "variance": [{}],
        "variation_coefficient": [{}],
    },
}

FREQ_FEATURES = {
    "signal_binned_fft": {
        "absolute_maximum": [{}],
        "agg_linear_trend": [
            {"attr": "intercept", "chunk_len": 5, "f_agg": "var"},
            {"attr": "slope", "chunk_len": 5, "f_agg": "var"},
            {"attr": "stderr", "chunk_len": 5, "f_agg": "var"},
            {"attr": "intercept", "chunk_len": 10, "f_agg": "mean"},
            {"attr": "intercept", "chunk_len": 10, "f_agg": "var"},
            {"attr": "slope", "chunk_len": 50, "f_agg": "max"},
        ],
        "change_quantiles": [
            {"f_agg": "mean", "isabs": True, "qh": 0.2, "ql": 0.0},
            {"f_agg": "mean", "isabs": True, "qh": 0.4, "ql": 0.0},
            {"f_agg": "mean", "isabs": True, "qh": 0.8, "ql": 0.0},
            {"f_agg": "var", "isabs": False, "qh": 1.0, "ql": 0.0},
            {"f_agg": "var", "isabs": False, "qh": 1.0, "ql": 0.4},
            {"f_agg": "var", "isabs": False, "qh": 1.0, "ql": 0.6},
            {"f_agg": "var", "isabs": True, "qh": 1.0, "ql": 0.0},
            {"f_agg": "var", "isabs": True, "qh": 1.0, "ql": 0.4},
            {"f_agg": "var", "isabs": True, "qh": 1.0, "ql": 0.6},
        ],
        "energy_ratio_by_chunks": [{"num_segments": 10, "segment_focus": s} for s in (8, 9)],
        "index_mass_quantile": [{"q": 0.1}],
        "mean_change": [{}],
        "quantile": [{"q": q} for q in (0.2, 0.3)],
        "sum_values": [{}],
        "time_reversal_asymmetry_statistic": [{"lag": lag} for lag in (2, 3)],
        "variance": [{}],
    },
}


@dataclass(frozen=True)
class Feature:
    channel: str
    function: str
    params: tuple[tuple[str, object], ...] = ()

    @property
    def name(self) -> str:
        """``channel__function__param_value``, parameters by name, text values in quotes."""
        parts = [f'{k}_"{v}"' if isinstance(v, str) else f"{k}_{v}" for k, v in self.params]
        return "__".join([self.channel, self.function, *parts])

    def __getitem__(self, key: str):
        return dict(self.params)[key]


def feature(channel: str, function: str, **params) -> Feature:
    return Feature(channel, function, tuple(sorted(params.items())))


def listed(table: dict[str, dict[str, list[dict]]], function: str | None = None) -> list[Feature]:
    """The features of a table, optionally those of one function."""
    return [
        feature(channel, fn, **p)
        for channel, fns in table.items()
        for fn, params in fns.items()
        if function in (None, fn)
        for p in params
    ]
