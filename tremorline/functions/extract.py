"""Feature tables: one row per series, one column per feature."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.functions import ordered, sequential, spectral
from tremorline.functions.catalog import FREQ_FEATURES, TIME_FEATURES, Feature, listed
from tremorline.functions.rowwise import ROWWISE, rowwise_features
from tremorline.functions.source import Source, stored_table, stored_time, table_source
from tremorline.operators.preprocess import TimePreprocessing
from tremorline.operators.spectrum import FreqPreprocessing

# Functions that are computed together, in one pass over the series.
_TOGETHER = {
    "permutation_entropy": ordered.permutation_entropy,
    "agg_linear_trend": ordered.agg_linear_trend,
    "quantile": ordered.quantiles,
    "median": ordered.quantiles,
    "index_mass_quantile": ordered.mass_and_runs,
    "longest_strike_below_mean": ordered.mass_and_runs,
    "fft_aggregated": spectral.fft_aggregated,
    "fourier_entropy": spectral.fourier_entropy,
    "ar_coefficient": sequential.ar_coefficient,
    "lempel_ziv_complexity": sequential.lempel_ziv_complexity,
}


def compute(*parts: tuple[Source, list[Feature]]) -> DataFrame:
    """Wide table (id, one column per feature, named by ``Feature.name``) of the series that all sources have.

    Each pass gives one array of values per series; the arrays are stacked and gathered by id once, instead of joining
    the passes one after another.
    """
    stacked, columns, needed = None, [], []
    for src, features in parts:
        passes: dict = {}
        for f in features:
            if f.function not in _TOGETHER and f.function not in ROWWISE:
                raise ValueError(f"unknown feature {f.function}")
            passes.setdefault(_TOGETHER.get(f.function, rowwise_features), []).append(f)
        for run, members in passes.items():
            no = len({p for p, _, _ in columns})
            values = F.array(*[F.col(f"f{i}").cast("double") for i in range(len(members))])
            part = run(src, members).select("id", F.struct(F.lit(no).alias("key"), values.alias("value")).alias("part"))
            stacked = part if stacked is None else stacked.union(part)
            columns += [(no, i, f) for i, f in enumerate(members)]
        needed.append([p for p, _, f in columns if f in features])
    gathered = stacked.groupBy("id").agg(F.map_from_entries(F.collect_list("part")).alias("m"))
    for passes in needed:
        gathered = gathered.filter(reduce(lambda a, c: a | c, [F.map_contains_key("m", p) for p in sorted(set(passes))]))
    ordered = sorted(columns, key=lambda c: c[2].name)
    return gathered.select("id", *[F.col("m")[F.lit(p)][i].alias(f.name) for p, i, f in ordered])


def _channels(features: list[Feature]) -> list[str]:
    return list(dict.fromkeys(f.channel for f in features))


def extract_features(channels: DataFrame, pos: str, features: list[Feature], keep: bool = True) -> DataFrame:
    """Features of the channels of a long frame, columns in alphabetical order.

    Several passes read the frame; with ``keep`` it is written once, bucketed, to the shared folder.
    """
    return compute(((stored_table if keep else table_source)(channels, pos, *_channels(features)), features))


def time_features(sig: DataFrame, prep: TimePreprocessing | None = None) -> DataFrame:
    return compute((stored_time(sig, prep or TimePreprocessing()), listed(TIME_FEATURES)))


def freq_features(sig: DataFrame, prep: FreqPreprocessing | None = None) -> DataFrame:
    return extract_features((prep or FreqPreprocessing()).transform(sig), "freq_num", listed(FREQ_FEATURES))


def feature_union(*tables: DataFrame) -> DataFrame:
    """Column-wise union of feature tables by series."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "id")
    return sort_columns(out)


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select("id", *[F.col(f"`{c}`") for c in sorted(df.columns) if c != "id"])


def all_features(
    sig: DataFrame, time: TimePreprocessing | None = None, freq: FreqPreprocessing | None = None
) -> DataFrame:
    """The feature table of the classifiers: 74 time-domain and 26 frequency-domain columns."""
    spectrum = (freq or FreqPreprocessing()).transform(sig)
    features = listed(FREQ_FEATURES)
    return compute(
        (stored_time(sig, time or TimePreprocessing()), listed(TIME_FEATURES)),
        (stored_table(spectrum, "freq_num", *_channels(features)), features),
    )


def to_long(wide: DataFrame) -> DataFrame:
    """(id, feature, value) rows of a wide feature table."""
    names = [c for c in wide.columns if c != "id"]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in names])
    return wide.select("id", F.inline(pairs))
