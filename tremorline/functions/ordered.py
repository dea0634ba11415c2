"""Features with a grouping or running value of their own: patterns, chunks, ranks, runs and cumulated mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.blocks import attach, block_window, core, exact_quantiles, running
from tremorline.functions.catalog import Feature
from tremorline.functions.source import Source


def _named(features: list[Feature], columns: list[Column]) -> list[Column]:
    return [c.cast("double").alias(f"f{i}") for i, (_, c) in enumerate(zip(features, columns))]


# --- permutation entropy -------------------------------------------------------------------------------------------


def _order_code(names: list[str]) -> Column:
    """A number that is the same for windows of the same rank order; one bit per pair, equal values by position."""
    pairs = [(names[j], names[i]) for i in range(1, len(names)) for j in range(i)]
    bits = [f"IF(`{a}` <= `{b}`, {1 << k}L, 0L)" for k, (a, b) in enumerate(pairs)]
    return F.expr(f"IF(`{names[-1]}` IS NOT NULL, {' + '.join(bits)}, NULL)")


def permutation_entropy(src: Source, features: list[Feature]) -> DataFrame:
    """Entropy of the rank orders of all windows of ``dimension`` values ``tau`` apart."""
    offsets = sorted({(f.channel, j * f["tau"]) for f in features for j in range(f["dimension"])})
    reach = max(o for _, o in offsets)
    w = block_window("id", "pos")
    rows = core(
        src.framed(0, reach).select(
            "id", "pos", "block", *[F.lead(c, o).over(w).alias(f"{c}@{o}") for c, o in offsets]
        ),
        "pos",
    )
    codes = F.array(
        *[_order_code([f"{f.channel}@{j * f['tau']}" for j in range(f["dimension"])]) for f in features]
    )
    counts = (
        rows.select("id", F.posexplode(codes).alias("i", "code"))
        .groupBy("id", "i", "code")
        .agg(F.count("code").alias("c"))
    )
    out = []
    for i in range(len(features)):
        here = (F.col("i") == i) & F.col("code").isNotNull()
        total = F.sum(F.when(here, F.col("c")))
        out.append(F.log(total) - F.try_divide(F.sum(F.when(here, F.col("c") * F.log("c"))), total))
    return counts.groupBy("id").agg(*_named(features, out))


# --- linear trend of chunk aggregates ------------------------------------------------------------------------------

_CHUNK_AGGS = {"min": F.min, "max": F.max, "mean": F.avg, "var": F.var_pop}


def _trend(attr: str, y: Column, x: Column) -> Column:
    """Least-squares line through (x, y); a constant side has correlation 0."""
    m = F.count(y)
    syy, sxx = F.regr_syy(y, x), F.regr_sxx(y, x)
    r = F.coalesce(F.try_divide(F.regr_sxy(y, x), F.sqrt(sxx * syy)), F.lit(0.0))
    if attr == "rvalue":
        return r
    slope = F.try_divide(F.regr_sxy(y, x), sxx)
    if attr == "slope":
        return slope
    if attr == "intercept":
        return F.avg(y) - slope * F.avg(x)
    return F.when(m == 2, 0.0).otherwise(F.sqrt(F.greatest(1 - r * r, F.lit(0.0)) * F.try_divide(syy, sxx * (m - 2))))


def agg_linear_trend(src: Source, features: list[Feature]) -> DataFrame:
    """Line through the min, max, mean or variance of consecutive chunks; NULL unless there are two chunks."""
    lengths = sorted({f["chunk_len"] for f in features})
    needed = sorted({(f.channel, f["f_agg"]) for f in features})
    chunks = (
        src.rows
        .select("*", F.explode(F.array(*[F.lit(c) for c in lengths])).alias("len"))
        .groupBy("id", "len", F.floor(F.col("pos") / F.col("len")).alias("chunk"))
        .agg(*[_CHUNK_AGGS[a](c).alias(f"{c}@{a}") for c, a in needed])
    )
    out = []
    for f in features:
        here = F.col("len") == f["chunk_len"]
        y = F.when(here, F.col(f"{f.channel}@{f['f_agg']}"))
        x = F.when(here, F.col("chunk").cast("double"))
        out.append(F.when(F.count(y) > 1, _trend(f["attr"], y, x)))
    return chunks.groupBy("id").agg(*_named(features, out))


# --- quantiles -----------------------------------------------------------------------------------------------------


def quantiles(src: Source, features: list[Feature]) -> DataFrame:
    """Linear-interpolated quantiles and the median."""
    rows, out = src.rows, None
    for channel in dict.fromkeys(f.channel for f in features):
        wanted = {
            f"f{i}": (0.5 if f.function == "median" else f["q"]) for i, f in enumerate(features) if f.channel == channel
        }
        one = exact_quantiles(rows, "id", channel, wanted, largest=src.largest)
        out = one if out is None else out.join(one, "id", "outer")
    return out


# --- runs and cumulated mass ---------------------------------------------------------------------------------------


def mass_and_runs(src: Source, features: list[Feature]) -> DataFrame:
    """``index_mass_quantile`` and ``longest_strike_below_mean``: both need a running value along the series.

    The longest run below the mean ends at most ``pos - last value not below`` rows after such a value.
    """
    rows = src.rows
    channels = list(dict.fromkeys(f.channel for f in features))
    stats = rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"{c}@mean") for c in channels],
        *[F.sum(F.abs(c)).alias(f"{c}@mass") for c in channels],
    )
    below = {c: F.col(c) < F.col(f"{c}@mean") for c in channels}
    ran = running(
        attach(rows, stats, "id"),
        "id",
        "pos",
        sums={f"{c}@run": F.abs(c) for c in channels},
        maxima={f"{c}@last": F.when(~below[c], F.col("pos")) for c in channels},
    )
    out = []
    for f in features:
        c = f.channel
        if f.function == "index_mass_quantile":
            share = F.try_divide(F.col(f"{c}@run"), F.col(f"{c}@mass"))
            out.append((F.min(F.when(share >= f["q"], F.col("pos"))) + 1) / F.max("n"))
        else:
            length = F.col("pos") - F.coalesce(F.col(f"{c}@last"), F.lit(-1))
            out.append(F.coalesce(F.max(F.when(below[c], length)), F.lit(0)))
    whole = {c: F.count(c) == F.count(F.lit(1)) for c in channels}
    out = [F.when(whole[f.channel], c) for f, c in zip(features, out)]
    return ran.groupBy("id").agg(*_named(features, out))


