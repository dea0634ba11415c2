"""Features that are one aggregate over rows, their neighbours and a few values of the whole series.

Every builder returns a Column for ``groupBy(id).agg``; all of them run in one pre-aggregated pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.blocks import attach, block_window, core, exact_quantiles
from tremorline.functions.catalog import Feature
from tremorline.functions.source import Source


class Scope:
    """Names the columns a feature reads and remembers which of them have to be made."""

    def __init__(self, channel: str):
        self.channel = channel
        self.x = F.col(channel)
        self.pos = F.col("pos")
        self.n = F.col("n")
        self.offsets: set[int] = set()
        self.peaks: set[int] = set()
        self.stats: set[str] = set()
        self.quantiles: set[float] = set()
        self.prepared: dict[str, Column] = {}

    def at(self, offset: int) -> Column:
        self.offsets.add(offset)
        return F.col(f"{self.channel}@{offset}")

    def max_near(self, side: str, n: int) -> Column:
        self.peaks.add(n)
        return F.col(f"{self.channel}@{side}{n}")

    def stat(self, name: str) -> Column:
        self.stats.add(name)
        return F.col(f"{self.channel}@{name}")

    def quantile(self, q: float) -> Column:
        self.quantiles.add(q)
        return F.col(f"{self.channel}@q{q}".replace(".", "_"))

    def prepare(self, name: str, value: Column) -> Column:
        """A value of the row that several aggregates read, computed once."""
        self.prepared[f"{self.channel}@{name}"] = value
        return F.col(f"{self.channel}@{name}")


ROWWISE: dict[str, Callable[..., Column]] = {}


def rowwise(fn: Callable[..., Column]) -> Callable[..., Column]:
    ROWWISE[fn.__name__] = fn
    return fn


def _count(cond: Column) -> Column:
    return F.count_if(cond).cast("double")


# --- plain aggregates ----------------------------------------------------------------------------------------------


@rowwise
def sum_values(s):
    return F.sum(s.x)


@rowwise
def variance(s):
    return F.var_pop(s.x)


@rowwise
def standard_deviation(s):
    return F.stddev_pop(s.x)


@rowwise
def root_mean_square(s):
    return F.sqrt(F.avg(s.x * s.x))


@rowwise
def minimum(s):
    return F.min(s.x)


@rowwise
def absolute_maximum(s):
    return F.max(F.abs(s.x))


@rowwise
def variation_coefficient(s):
    return F.try_divide(F.stddev_pop(s.x), F.avg(s.x))


@rowwise
def skewness(s):
    """Adjusted for the sample size; needs three values."""
    n = F.count(s.x)
    adjusted = F.skewness(s.x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n > 2, F.when(F.var_pop(s.x) == 0, 0.0).otherwise(adjusted))


@rowwise
def kurtosis(s):
    """Adjusted excess; needs four values."""
    n = F.count(s.x)
    adjusted = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(s.x) + 6)
    return F.when(n > 3, F.when(F.var_pop(s.x) == 0, 0.0).otherwise(adjusted))


@rowwise
def range_count(s, min, max):
    return _count((s.x >= F.lit(float(min))) & (s.x < F.lit(float(max))))


@rowwise
def benford_correlation(s):
    """Correlation of the shares of first significant digits with Benford's law."""
    s.prepare("digit", F.regexp_extract(F.abs(s.x).cast("string"), "[1-9]", 0))
    law = [math.log10(1 + 1 / d) for d in range(1, 10)]
    law_mean = sum(law) / 9
    spread = sum((w - law_mean) ** 2 for w in law)
    hits = [f"count_if(`{s.channel}@digit` = '{d}')" for d in range(1, 10)]
    # shares differ from counts by a factor, which a correlation does not see
    total, squares = " + ".join(hits), " + ".join(f"{h} * {h}" for h in hits)
    cov = " + ".join(f"{h} * {w - law_mean!r}D" for h, w in zip(hits, law))
    return F.expr(f"try_divide({cov}, sqrt(({squares} - ({total}) * ({total}) / 9D) * {spread!r}D))")


@rowwise
def mean_change(s):
    first, last = F.min_by(s.x, s.pos), F.max_by(s.x, s.pos)
    return F.try_divide(last - first, F.count(s.x) - 1)


# --- neighbours ----------------------------------------------------------------------------------------------------


@rowwise
def absolute_sum_of_changes(s):
    return F.coalesce(F.sum(F.abs(s.x - s.at(-1))), F.lit(0.0))


@rowwise
def cid_ce(s, normalize):
    """Complexity estimate: length of the line through the values, optionally of the z-scores."""
    step = s.x - s.at(-1)
    length = F.sqrt(F.coalesce(F.sum(step * step), F.lit(0.0)))
    return F.coalesce(F.try_divide(length, F.stddev_pop(s.x)), F.lit(0.0)) if normalize else length


@rowwise
def c3(s, lag):
    return F.coalesce(F.avg(s.x * s.at(lag) * s.at(2 * lag)), F.lit(0.0))


@rowwise
def time_reversal_asymmetry_statistic(s, lag):
    mid, far = s.at(lag), s.at(2 * lag)
    return F.coalesce(F.avg(far * far * mid - mid * s.x * s.x), F.lit(0.0))


@rowwise
def number_peaks(s, n):
    """Values above each of their n neighbours on both sides."""
    complete = s.at(-n).isNotNull() & s.at(n).isNotNull()
    return _count(complete & (s.x > s.max_near("back", n)) & (s.x > s.max_near("ahead", n)))


# --- values of the whole series ------------------------------------------------------------------------------------


@rowwise
def count_below_mean(s):
    return _count(s.x < s.stat("mean"))


@rowwise
def count_above_mean(s):
    return _count(s.x > s.stat("mean"))


@rowwise
def ratio_beyond_r_sigma(s, r):
    beyond = F.abs(s.x - s.stat("mean")) > F.lit(float(r)) * s.stat("sd")
    return _count(beyond) / F.count(s.x)


@rowwise
def binned_entropy(s, max_bins):
    """Entropy of an equal-width histogram whose last bin is closed."""
    place = F.floor(F.try_divide(s.x - s.stat("lo"), s.stat("hi") - s.stat("lo")) * max_bins)
    s.prepare(f"bin{max_bins}", F.coalesce(F.least(place, F.lit(max_bins - 1)), F.lit(0)).cast("int"))
    counts = [f"count_if(`{s.channel}@bin{max_bins}` = {i})" for i in range(max_bins)]
    weighted = " + ".join(f"{c} * ln(greatest({c}, 1))" for c in counts)
    return F.expr(f"ln(count(`{s.channel}`)) - ({weighted}) / count(`{s.channel}`)")


@rowwise
def energy_ratio_by_chunks(s, num_segments, segment_focus):
    """Share of the energy in one of equal parts; the first ``n mod parts`` parts are one longer."""
    size, longer = F.floor(s.n / num_segments), s.n % num_segments
    start = size * segment_focus + F.least(longer, F.lit(segment_focus))
    stop = start + size + F.when(longer > segment_focus, 1).otherwise(0)
    inside = F.when((s.pos >= start) & (s.pos < stop), s.x * s.x).otherwise(0.0)
    return F.try_divide(F.sum(inside), F.sum(s.x * s.x))


@rowwise
def change_quantiles(s, f_agg, isabs, qh, ql):
    """Mean or variance of the changes whose both ends lie between two quantiles; 0 where there is none."""
    lo, hi = s.quantile(ql), s.quantile(qh)
    inside = (lo < hi) & s.x.between(lo, hi) & s.at(-1).between(lo, hi)
    step = s.x - s.at(-1)
    kept = F.when(inside, F.abs(step) if isabs else step)
    return F.coalesce({"mean": F.avg, "var": F.var_pop}[f_agg](kept), F.lit(0.0))


_STATS = {"mean": F.avg, "sd": F.stddev_pop, "lo": F.min, "hi": F.max}


def rowwise_features(src: Source, features: list[Feature]) -> DataFrame:
    """One row per series with a column per feature (named by position: f0, f1, ...)."""
    scopes = {c: Scope(c) for c in src.channels}
    built = [ROWWISE[f.function](scopes[f.channel], **dict(f.params)) for f in features]
    used = [s for s in scopes.values() if any(f.channel == s.channel for f in features)]

    reach = [abs(o) for s in used for o in s.offsets] + [n for s in used for n in s.peaks] + [0]
    rows = src.framed(max(reach), max(reach))
    w = block_window("id", "pos")
    lags = [
        (F.lead(s.channel, o) if o > 0 else F.lag(s.channel, -o)).over(w).alias(f"{s.channel}@{o}")
        for s in used
        for o in sorted(s.offsets)
    ]
    tops = [
        F.max(s.channel).over(w.rowsBetween(a, b)).alias(f"{s.channel}@{side}{n}")
        for s in used
        for n in sorted(s.peaks)
        for side, a, b in (("back", -n, -1), ("ahead", 1, n))
    ]
    rows = core(rows.select("id", "pos", "block", *[s.channel for s in used], *lags, *tops), "pos")

    needs_n = any(f.function == "energy_ratio_by_chunks" for f in features)
    if needs_n or any(s.stats or s.quantiles for s in used):
        plain = src.rows
        stats = plain.groupBy("id").agg(
            F.count(F.lit(1)).alias("n"),
            *[_STATS[k](s.channel).alias(f"{s.channel}@{k}") for s in used for k in sorted(s.stats)],
        )
        for s in used:
            if s.quantiles:
                wanted = {f"{s.channel}@q{q}".replace(".", "_"): q for q in sorted(s.quantiles)}
                stats = stats.join(exact_quantiles(plain, "id", s.channel, wanted, largest=src.largest), "id", "left")
        rows = attach(rows, stats, "id")

    rows = rows.withColumns({name: c for s in used for name, c in s.prepared.items()})
    # a channel with undefined values (constant series) has no features
    whole = {s.channel: F.count(s.x) == F.count(F.lit(1)) for s in used}
    aggs = [F.when(whole[f.channel], c).cast("double").alias(f"f{i}") for i, (f, c) in enumerate(zip(features, built))]
    return rows.groupBy("id").agg(*aggs)
