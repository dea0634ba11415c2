"""Registered queries: one per feature function, with all its parameters, and the whole feature table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tremorline.functions import extract
from tremorline.functions.catalog import FREQ_FEATURES, TIME_FEATURES, Feature, feature, listed
from tremorline.functions.source import table_source, time_source
from tremorline.operators.preprocess import TimePreprocessing
from tremorline.operators.spectrum import FreqPreprocessing
from tremorline.plans import bindings as b
from tremorline.plans.registry import CHECKS, query
from tremorline.plans.signal_queries import DFT

S, M, SPEC = "signal_std", "signal_mean", "signal_binned_fft"
BINS = 70
# the test series are shorter than the usual window of 128, over which their mean would be constant
MEAN_WINDOW = 16
TIME = TimePreprocessing(mean_window=MEAN_WINDOW)

# ordered channels of the check SQL: `ch` has (id, pos, signal_std, signal_mean), `sp` has (id, pos, signal_binned_fft)
TIME_CTE = f"""{b.channels_sql(MEAN_WINDOW)}, ch AS (
  SELECT id, CAST(time AS BIGINT) AS pos, signal_std, signal_mean, count(*) OVER (PARTITION BY id) AS n FROM chan)"""
FREQ_CTE = f"""{b.SIG}, {DFT.format(x='signal_raw', src='sig')}, binned AS (
  SELECT id, CAST(floor(round({BINS} * ln(k) / ln(n // 2), 9)) AS BIGINT) AS bin, 2.0 / n * a AS amplitude
  FROM dft WHERE k > 0 AND k < n // 2),
sp AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY bin) - 1 AS pos, avg(amplitude) AS signal_binned_fft,
         count(*) OVER (PARTITION BY id) AS n
  FROM binned GROUP BY id, bin)"""


def source(spark, sf, channel: str):
    sig = b.signal(spark, sf)
    if channel == SPEC:
        return table_source(FreqPreprocessing(n_bins=BINS, fs=1000).transform(sig), "freq_num", SPEC)
    return time_source(sig, TIME)


def long_rows(wide):
    return b.rounded(extract.to_long(wide), "value")


def unpivot(ctes: str, wide: str, features: list[Feature]) -> str:
    """SQL: columns f0, f1, ... of ``wide`` as (id, feature, value) rows."""
    names = ", ".join("'" + f.name + "'" for f in features)
    values = ", ".join(f"CAST(f{i} AS DOUBLE)" for i in range(len(features)))
    return f"""WITH {ctes}, wide AS ({wide})
SELECT id, feature, CASE WHEN isfinite(v) THEN round(v, 6) END AS value
FROM (SELECT id, unnest([{names}]) AS feature, unnest([{values}]) AS v FROM wide)"""


def register(name: str, features: list[Feature], expr=None, frm: str = "{src}", ctes: str = "", sql: str | None = None):
    """Register a feature query over the channels of one kind.

    ``expr(f, x)`` gives the SQL aggregate of a feature over the rows of ``frm`` grouped by id.
    """
    freq = features[0].channel == SPEC
    base = FREQ_CTE if freq else TIME_CTE
    if expr is not None:
        cols = ", ".join(f"{expr(f, f.channel)} AS f{i}" for i, f in enumerate(features))
        wide = f"SELECT id, {cols} FROM {frm.format(src='sp' if freq else 'ch')} GROUP BY id"
        sql = unpivot(base + (", " + ctes if ctes else ""), wide, features)

    def run(spark, sf):
        return long_rows(extract.compute((source(spark, sf, features[0].channel), features)))

    query(name, sql)(run)


def time(fn: str, *extra: Feature) -> list[Feature]:
    return listed(TIME_FEATURES, fn) + list(extra)


def freq(fn: str, *extra: Feature) -> list[Feature]:
    return listed(FREQ_FEATURES, fn) + list(extra)


# --- plain aggregates ----------------------------------------------------------------------------------------------

register("f_minimum", time("minimum"), lambda f, x: f"min({x})")
register("f_sum_values", time("sum_values"), lambda f, x: f"sum({x})")
register("f_sum_values_freq", freq("sum_values"), lambda f, x: f"sum({x})")
register("f_variance", time("variance"), lambda f, x: f"var_pop({x})")
register("f_variance_freq", freq("variance"), lambda f, x: f"var_pop({x})")
register("f_standard_deviation", time("standard_deviation"), lambda f, x: f"stddev_pop({x})")
register("f_root_mean_square", time("root_mean_square"), lambda f, x: f"sqrt(avg({x} * {x}))")
register("f_variation_coefficient", time("variation_coefficient"), lambda f, x: f"stddev_pop({x}) / nullif(avg({x}), 0)")
register("f_median", time("median"), lambda f, x: f"median({x})")
register("f_quantile", time("quantile"), lambda f, x: f"quantile_cont({x}, {f['q']})")
register("f_quantile_freq", freq("quantile"), lambda f, x: f"quantile_cont({x}, {f['q']})")
register("f_kurtosis", time("kurtosis"), lambda f, x: f"kurtosis({x})")
register("f_skewness", time("skewness"), lambda f, x: f"skewness({x})")
register("f_absolute_maximum", freq("absolute_maximum"), lambda f, x: f"max(abs({x}))")
register(
    "f_mean_change",
    freq("mean_change"),
    lambda f, x: f"(arg_max({x}, pos) - arg_min({x}, pos)) / nullif(count(*) - 1, 0)",
)
register(
    "f_range_count",
    time("range_count"),
    lambda f, x: f"count(*) FILTER (WHERE {x} >= {f['min']} AND {x} < {f['max']})",
)


def _benford_sql() -> str:
    law = ", ".join(f"({d}, {math.log10(1 + 1 / d)!r})" for d in range(1, 10))
    feats = time("benford_correlation")
    return unpivot(
        f"""{TIME_CTE}, law(d, p) AS (VALUES {law}), digits AS (
  SELECT id, regexp_extract(CAST(abs(signal_std) AS VARCHAR), '[1-9]') AS d, n FROM ch),
shares AS (
  SELECT i.id, l.d, l.p, count(g.d) / any_value(i.n) AS share
  FROM (SELECT DISTINCT id, n FROM ch) i CROSS JOIN law l
  LEFT JOIN digits g ON g.id = i.id AND g.d = CAST(l.d AS VARCHAR) GROUP BY i.id, l.d, l.p)""",
        "SELECT id, corr(share, p) AS f0 FROM shares GROUP BY id",
        feats,
    )


register("f_benford_correlation", time("benford_correlation"), sql=_benford_sql())

# --- neighbours ----------------------------------------------------------------------------------------------------

_LAGS = {
    c: ", ".join(
        f"{'lead' if o > 0 else 'lag'}({c}, {abs(o)}) OVER (PARTITION BY id ORDER BY pos) AS {c}_{'p' if o > 0 else 'm'}{abs(o)}"
        for o in (-1, 1, 2, 3, 4, 6)
    )
    for c in (S, M, SPEC)
}
TIME_LAGS = f"lagged AS (SELECT *, {_LAGS[S]}, {_LAGS[M]} FROM ch)"
FREQ_LAGS = f"lagged AS (SELECT *, {_LAGS[SPEC]} FROM sp)"

register(
    "f_absolute_sum_of_changes",
    time("absolute_sum_of_changes"),
    lambda f, x: f"coalesce(sum(abs({x} - {x}_m1)), 0)",
    "lagged",
    TIME_LAGS,
)
register(
    "f_cid_ce",
    time("cid_ce"),
    lambda f, x: f"sqrt(coalesce(sum(power({x} - {x}_m1, 2)), 0))"
    + (f" / stddev_pop({x})" if f["normalize"] else ""),
    "lagged",
    TIME_LAGS,
)
register(
    "f_c3",
    time("c3"),
    lambda f, x: f"coalesce(avg({x} * {x}_p{f['lag']} * {x}_p{2 * f['lag']}), 0)",
    "lagged",
    TIME_LAGS,
)
register(
    "f_time_reversal_asymmetry",
    freq("time_reversal_asymmetry_statistic"),
    lambda f, x: f"coalesce(avg({x}_p{2 * f['lag']} * {x}_p{2 * f['lag']} * {x}_p{f['lag']}"
    f" - {x}_p{f['lag']} * {x} * {x}), 0)",
    "lagged",
    FREQ_LAGS,
)


def _peak_cte() -> str:
    parts = []
    for f in listed(TIME_FEATURES, "number_peaks"):
        x, n = f.channel, f["n"]
        w = "OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN"
        parts.append(
            f"(pos >= {n} AND pos < n - {n} AND {x} > max({x}) {w} {n} PRECEDING AND 1 PRECEDING)"
            f" AND {x} > max({x}) {w} 1 FOLLOWING AND {n} FOLLOWING)) AS {x}_top{n}"
        )
    return f"tops AS (SELECT id, {', '.join(parts)} FROM ch)"


register(
    "f_number_peaks",
    time("number_peaks"),
    lambda f, x: f"count(*) FILTER (WHERE {x}_top{f['n']})",
    "tops",
    _peak_cte(),
)

# --- values of the whole series ------------------------------------------------------------------------------------

_STATS = ", ".join(
    f"avg({c}) OVER (PARTITION BY id) AS {c}_mean, stddev_pop({c}) OVER (PARTITION BY id) AS {c}_sd,"
    f" min({c}) OVER (PARTITION BY id) AS {c}_lo, max({c}) OVER (PARTITION BY id) AS {c}_hi"
    for c in (S, M)
)
STATS = f"st AS (SELECT *, {_STATS} FROM ch)"

register("f_count_below_mean", time("count_below_mean"), lambda f, x: f"count(*) FILTER (WHERE {x} < {x}_mean)", "st", STATS)
register("f_count_above_mean", time("count_above_mean"), lambda f, x: f"count(*) FILTER (WHERE {x} > {x}_mean)", "st", STATS)
register(
    "f_ratio_beyond_r_sigma",
    time("ratio_beyond_r_sigma"),
    lambda f, x: f"count(*) FILTER (WHERE abs({x} - {x}_mean) > {f['r']} * {x}_sd) / count(*)",
    "st",
    STATS,
)


def _entropy_sql(features: list[Feature], symbol) -> str:
    """Entropy of the symbols of each feature: one grouped count per feature."""
    parts = " UNION ALL ".join(
        f"SELECT id, {i} AS i, {symbol(f, f.channel)} AS sym FROM st" for i, f in enumerate(features)
    )
    cols = ", ".join(f"max(e) FILTER (WHERE i = {i}) AS f{i}" for i in range(len(features)))
    return unpivot(
        f"""{TIME_CTE}, {STATS}, syms AS ({parts}),
cnt AS (SELECT id, i, sym, count(*) AS c FROM syms WHERE sym IS NOT NULL GROUP BY id, i, sym),
ent AS (SELECT id, i, -sum(p * ln(p)) AS e FROM
  (SELECT id, i, c / sum(c) OVER (PARTITION BY id, i) AS p FROM cnt) GROUP BY id, i)""",
        f"SELECT id, {cols} FROM ent GROUP BY id",
        features,
    )


register(
    "f_binned_entropy",
    time("binned_entropy"),
    sql=_entropy_sql(
        time("binned_entropy"), lambda f, x: f"least(floor(({x} - {x}_lo) / ({x}_hi - {x}_lo) * {f['max_bins']}), {f['max_bins'] - 1})"
    ),
)


def _pattern(f: Feature, x: str) -> str:
    """The window as a list of positions sorted by (value, position), cut off at the end of the series."""
    d = f["dimension"]
    w = f"list({x}) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {d - 1} FOLLOWING)"
    return (
        f"CASE WHEN pos + {d} <= n THEN list_transform(list_sort(list_transform({w},"
        f" lambda v, j: {{'v': v, 'j': j}})), lambda s: s.j)::VARCHAR END"
    )


register("f_permutation_entropy", time("permutation_entropy"), sql=_entropy_sql(time("permutation_entropy"), _pattern))


def _segment(f: Feature) -> str:
    k, parts = f["segment_focus"], f["num_segments"]
    start = f"((n // {parts}) * {k} + least(n % {parts}, {k}))"
    return f"pos >= {start} AND pos < {start} + n // {parts} + CASE WHEN n % {parts} > {k} THEN 1 ELSE 0 END"


register(
    "f_energy_ratio_by_chunks",
    freq("energy_ratio_by_chunks"),
    lambda f, x: f"coalesce(sum({x} * {x}) FILTER (WHERE {_segment(f)}), 0) / nullif(sum({x} * {x}), 0)",
)


def _corridor_cte() -> str:
    qs = sorted({q for f in freq("change_quantiles") for q in (f["ql"], f["qh"])})
    # ranks rounded to 9 digits, so that whole ranks are values of the series themselves
    pick = ", ".join(
        f"max({SPEC}) FILTER (WHERE pos_sorted = floor(round({q} * (n - 1), 9))) +"
        f" (max({SPEC}) FILTER (WHERE pos_sorted = ceil(round({q} * (n - 1), 9)))"
        f" - max({SPEC}) FILTER (WHERE pos_sorted = floor(round({q} * (n - 1), 9))))"
        f" * (round({q} * any_value(n - 1), 9) - floor(round({q} * any_value(n - 1), 9))) AS q{int(q * 10)}"
        for q in qs
    )
    return f"""{FREQ_LAGS}, ranked AS (
  SELECT id, n, {SPEC}, row_number() OVER (PARTITION BY id ORDER BY {SPEC}) - 1 AS pos_sorted FROM sp),
corridor AS (SELECT id, {pick} FROM ranked GROUP BY id),
inside AS (SELECT lagged.*, corridor.* EXCLUDE (id) FROM lagged JOIN corridor ON corridor.id = lagged.id)"""


def _change(f: Feature, x: str) -> str:
    lo, hi = f"q{int(f['ql'] * 10)}", f"q{int(f['qh'] * 10)}"
    step = f"abs({x} - {x}_m1)" if f["isabs"] else f"({x} - {x}_m1)"
    fn = {"mean": "avg", "var": "var_pop"}[f["f_agg"]]
    return (
        f"coalesce({fn}({step}) FILTER (WHERE {lo} < {hi} AND {x} BETWEEN {lo} AND {hi}"
        f" AND {x}_m1 BETWEEN {lo} AND {hi}), 0)"
    )


register("f_change_quantiles", freq("change_quantiles"), _change, "inside", _corridor_cte())


def _mass_cte(src: str, channels: tuple[str, ...]) -> str:
    cols = ", ".join(
        f"sum(abs({c})) OVER (PARTITION BY id ORDER BY pos) / nullif(sum(abs({c})) OVER (PARTITION BY id), 0) AS {c}_share"
        for c in channels
    )
    return f"mass AS (SELECT *, {cols} FROM {src})"


register(
    "f_index_mass_quantile",
    time("index_mass_quantile"),
    lambda f, x: f"(min(pos) FILTER (WHERE {x}_share >= {f['q']}) + 1) / any_value(n)",
    "mass",
    _mass_cte("ch", (S, M)),
)
register(
    "f_index_mass_quantile_freq",
    freq("index_mass_quantile"),
    lambda f, x: f"(min(pos) FILTER (WHERE {x}_share >= {f['q']}) + 1) / any_value(n)",
    "mass",
    _mass_cte("sp", (SPEC,)),
)
register(
    "f_longest_strike_below_mean",
    time("longest_strike_below_mean"),
    sql=unpivot(
        f"""{TIME_CTE}, {STATS}, runs AS (
  SELECT id, signal_std < signal_std_mean AS below, pos - row_number()
         OVER (PARTITION BY id, signal_std < signal_std_mean ORDER BY pos) AS island FROM st),
sized AS (SELECT id, island, below, count(*) AS c FROM runs GROUP BY id, island, below)""",
        "SELECT id, coalesce(max(c) FILTER (WHERE below), 0) AS f0 FROM sized GROUP BY id",
        time("longest_strike_below_mean"),
    ),
)


# --- chunks --------------------------------------------------------------------------------------------------------


def _trend_sql(features: list[Feature]) -> str:
    src = "sp" if features[0].channel == SPEC else "ch"
    fns = {"min": "min", "max": "max", "mean": "avg", "var": "var_pop"}
    ctes, joins, cols = [], [], []
    for i, f in enumerate(features):
        ctes.append(
            f"k{i} AS (SELECT id, pos // {f['chunk_len']} AS x, {fns[f['f_agg']]}({f.channel}) AS y FROM {src} GROUP BY 1, 2)"
        )
        r = "CASE WHEN regr_syy(y, x) = 0 THEN 0 ELSE corr(y, x) END"
        attr = {
            "rvalue": r,
            "slope": "regr_slope(y, x)",
            "intercept": "regr_intercept(y, x)",
            "stderr": f"CASE WHEN count(*) = 2 THEN 0 ELSE sqrt(greatest(1 - power({r}, 2), 0) * regr_syy(y, x)"
            " / nullif(regr_sxx(y, x) * (count(*) - 2), 0)) END",
        }[f["attr"]]
        ctes.append(f"t{i} AS (SELECT id, CASE WHEN count(*) > 1 THEN {attr} END AS f{i} FROM k{i} GROUP BY id)")
        joins.append(f"JOIN t{i} USING (id)")
        cols.append(f"f{i}")
    base = FREQ_CTE if src == "sp" else TIME_CTE
    return unpivot(
        f"{base}, {', '.join(ctes)}",
        f"SELECT id, {', '.join(cols)} FROM (SELECT DISTINCT id FROM {src}) {' '.join(joins)}",
        features,
    )


_more = [feature(S, "agg_linear_trend", attr=a, chunk_len=c, f_agg="max") for a in ("rvalue", "stderr") for c in (5, 10)]
register("f_agg_linear_trend", time("agg_linear_trend", *_more), sql=_trend_sql(time("agg_linear_trend", *_more)))
register("f_agg_linear_trend_freq", freq("agg_linear_trend"), sql=_trend_sql(freq("agg_linear_trend")))

# --- spectral ------------------------------------------------------------------------------------------------------


def _moments(channel: str) -> str:
    name = f"dft_{channel}"
    return (
        DFT.format(x=channel, src="chan").replace("dft AS", f"{name} AS")
        + f", mom_{channel} AS (SELECT id, sum(k * a) / sum(a) AS m1, sum(k * k * a) / sum(a) AS m2 FROM {name} GROUP BY id)"
    )


_fft = time("fft_aggregated")
_fft_cols = ", ".join(
    (f"{f.channel}_.m1" if f["aggtype"] == "centroid" else f"{f.channel}_.m2 - {f.channel}_.m1 * {f.channel}_.m1") + f" AS f{i}"
    for i, f in enumerate(_fft)
)
register(
    "f_fft_aggregated",
    _fft,
    sql=unpivot(
        f"{TIME_CTE}, {_moments(S)}, {_moments(M)}",
        f"SELECT id, {_fft_cols} FROM mom_{S} AS {S}_ JOIN mom_{M} AS {M}_ USING (id)",
        _fft,
    ),
)

_fe = time("fourier_entropy")
_fe_bins = " UNION ALL ".join(
    f"SELECT id, {i} AS i, coalesce(least(floor((d / hi - lo / hi) / nullif(1 - lo / hi, 0) * {f['bins']}), {f['bins'] - 1}), 0) AS sym FROM scaled"
    for i, f in enumerate(_fe)
)
_fe_cols = ", ".join(f"max(e) FILTER (WHERE i = {i}) AS f{i}" for i in range(len(_fe)))
register(
    "f_fourier_entropy",
    _fe,
    sql=unpivot(
        f"""{TIME_CTE}, win AS (
  SELECT id, CAST(time AS BIGINT) AS time, (signal_std - avg(signal_std) OVER (PARTITION BY id))
         * (0.5 - 0.5 * cos(2 * pi() * time / count(*) OVER (PARTITION BY id))) AS y FROM chan),
{DFT.format(x='y', src='win')}, dens AS (
  SELECT id, k, a * a * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS d FROM dft),
scaled AS (SELECT id, d, min(d) OVER (PARTITION BY id) AS lo, max(d) OVER (PARTITION BY id) AS hi FROM dens),
syms AS ({_fe_bins}), cnt AS (SELECT id, i, sym, count(*) AS c FROM syms GROUP BY id, i, sym),
ent AS (SELECT id, i, -sum(p * ln(p)) AS e FROM
  (SELECT id, i, c / sum(c) OVER (PARTITION BY id, i) AS p FROM cnt) GROUP BY id, i)""",
        f"SELECT id, {_fe_cols} FROM ent GROUP BY id",
        _fe,
    ),
)

# --- sequential ----------------------------------------------------------------------------------------------------

register("f_ar_coefficient", time("ar_coefficient"))

_ar2 = [feature(S, "ar_coefficient", coeff=c, k=1) for c in (0, 1)]
register(
    "f_ar_coefficient_one_lag",
    _ar2,
    lambda f, x: f"{'regr_intercept' if f['coeff'] == 0 else 'regr_slope'}({x}, {x}_m1)",
    "lagged",
    TIME_LAGS,
)


def _phrase_sql(features: list[Feature]) -> str:
    """The sequential parse as a recursion over samples: the set of phrases is a list that grows."""
    ctes, joins, cols = [], [], []
    for i, f in enumerate(features):
        x, bins = f.channel, f["bins"]
        ctes.append(f"""q{i} AS (
  SELECT id, pos, n, chr(CAST(200 + greatest(coalesce(ceil(({x} - {x}_lo) / nullif({x}_hi - {x}_lo, 0) * {bins}) - 1, 0), 0) AS INTEGER)) AS sym FROM st),
l{i} AS (
  SELECT id, pos, n, CAST([sym] AS VARCHAR[]) AS seen, '' AS open FROM q{i} WHERE pos = 0
  UNION ALL
  SELECT q.id, q.pos, q.n,
         CASE WHEN list_contains(l.seen, l.open || q.sym) THEN l.seen ELSE list_append(l.seen, l.open || q.sym) END,
         CASE WHEN list_contains(l.seen, l.open || q.sym) THEN l.open || q.sym ELSE '' END
  FROM l{i} l JOIN q{i} q ON q.id = l.id AND q.pos = l.pos + 1),
z{i} AS (SELECT id, len(seen) / n AS f{i} FROM l{i} WHERE pos = n - 1)""")
        joins.append(f"JOIN z{i} USING (id)")
        cols.append(f"f{i}")
    return unpivot(
        f"RECURSIVE {TIME_CTE}, {STATS}, {', '.join(ctes)}",
        f"SELECT id, {', '.join(cols)} FROM (SELECT DISTINCT id FROM ch) {' '.join(joins)}",
        features,
    )


register(
    "f_lempel_ziv_complexity",
    time("lempel_ziv_complexity"),
    sql=_phrase_sql(time("lempel_ziv_complexity")),
)

# --- feature tables ------------------------------------------------------------------------------------------------

@query("sort_columns", f"""WITH {TIME_CTE}
SELECT id, 1 AS place_1, 2 AS place_2, round(min({S}), 6) AS a_min, round(sum({S}), 6) AS b_sum FROM ch GROUP BY id""")
def sort_columns(spark, sf):
    src = source(spark, sf, S)
    wide = extract.compute((src, [feature(S, "sum_values"), feature(S, "minimum")]))
    wide = wide.toDF("id", "a_min", "b_sum").select("id", "b_sum", "a_min")
    out = extract.sort_columns(wide)
    places = {c: i for i, c in enumerate(out.columns)}
    out = out.withColumns({"place_1": F.lit(places["a_min"]), "place_2": F.lit(places["b_sum"])})
    return b.rounded(out, "a_min", "b_sum")


@query("feature_table")
def feature_table(spark, sf):
    """All 100 features of every series as rows."""
    return long_rows(extract.all_features(b.signal(spark, sf), TIME))


# every catalog feature with check SQL of its own: all but the autoregression, which is checked against numpy
def _checked(features: list[Feature]) -> list[Feature]:
    return [f for f in features if f.function != "ar_coefficient"]


def _checks_of(features: list[Feature]) -> str:
    names = ", ".join("'" + f.name + "'" for f in _checked(features))
    parts = [f"SELECT id, feature, value FROM ({CHECKS[q]})" for q in CHECKS if q.startswith("f_") and "one_lag" not in q]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE feature IN ({names})"


def _checked_rows(wide, features: list[Feature]):
    return long_rows(wide).filter(F.col("feature").isin([f.name for f in _checked(features)]))


_TIME, _FREQ = listed(TIME_FEATURES), listed(FREQ_FEATURES)


@query("extract_features", _checks_of(_TIME))
def extract_features(spark, sf):
    """All features of the time channels, one extraction."""
    channels = TIME.transform(b.signal(spark, sf))
    return _checked_rows(extract.extract_features(channels, "time", _TIME), _TIME)


@query("feature_union", _checks_of(_TIME + _FREQ))
def feature_union(spark, sf):
    """All features of the time channels joined to all of the spectrum."""
    sig = b.signal(spark, sf)
    spectrum = extract.extract_features(FreqPreprocessing().transform(sig), "freq_num", _FREQ)
    wide = extract.feature_union(extract.extract_features(TIME.transform(sig), "time", _TIME), spectrum)
    return _checked_rows(wide, _TIME + _FREQ)


@query("feature_long", _checks_of(_TIME + _FREQ))
def feature_long(spark, sf):
    """The features with check SQL, all from one extraction."""
    return _checked_rows(extract.all_features(b.signal(spark, sf), TIME), _TIME + _FREQ)
