"""Features that need linear algebra or a strictly sequential parse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.blocks import attach, ordered_samples, series_of
from tremorline.functions.catalog import Feature
from tremorline.functions.source import Source

# Triangular factors combined in one step (a factor for 10 lags is about 1 kB).
FACTORS_PER_GROUP = 1024


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, padded to a square, so that it can stand for its rows."""
    r = np.linalg.qr(rows, mode="r")
    width = rows.shape[1]
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def _lag_rows(x: np.ndarray, k: int) -> np.ndarray:
    """Rows [1, x[t-1], ..., x[t-k], x[t]]."""
    w = np.lib.stride_tricks.sliding_window_view(x, k + 1)[:, ::-1]
    return np.column_stack([np.ones(len(w)), w[:, 1:], w[:, 0]])


def autoregression(src: Source, channel: str, k: int) -> DataFrame:
    """(id, coeffs): least-squares x[t] ~ 1 + x[t-1] .. x[t-k], minimum norm where the lags are dependent.

    Every block of a series is reduced to the small triangular factor of its lag rows; the factors of the blocks are
    stacked and reduced again (tall-skinny QR), which keeps the accuracy of one decomposition of all rows.
    """

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in series_of(batch, "samples"):
                rows = _lag_rows(x, k) if len(x) > k else np.zeros((0, k + 2))
                out.append(_triangle(rows).ravel() if len(rows) else np.zeros((k + 2) ** 2))
            yield pa.RecordBatch.from_pydict({
                "id": batch["id"],
                "block": batch["block"],
                "m": pa.array([max(len(x) - k, 0) for x in series_of(batch, "samples")], pa.int64()),
                "factor": pa.array(out, pa.list_(pa.float64())),
            })

    def stacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for parts in batch["factors"].to_pylist():
            yield np.array(parts).reshape(-1, k + 2)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_triangle(rows).ravel() for rows in stacked(batch)]
            yield pa.RecordBatch.from_pydict(
                {"id": batch["id"], "m": batch["m"], "factor": pa.array(out, pa.list_(pa.float64()))}
            )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, m in zip(stacked(batch), batch["m"].to_pylist()):
                enough = m >= k + 1
                out.append(np.linalg.lstsq(rows[:, :-1], rows[:, -1], rcond=1e-15)[0] if enough else None)
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "coeffs": pa.array(out, pa.list_(pa.float64()))})

    blocks = (
        src.framed(k, 0)
        .filter(F.col(channel).isNotNull())
        .groupBy("id", "block")
        .agg(ordered_samples("pos", channel).alias("samples"))
    )
    each = blocks.mapInArrow(factors, "id long, block long, m long, factor array<double>")
    gathered = each.groupBy("id", F.floor(F.col("block") / FACTORS_PER_GROUP).alias("g")).agg(
        F.sum("m").alias("m"), F.collect_list("factor").alias("factors")
    )
    reduced = gathered.select("id", "m", "factors").mapInArrow(reduce, "id long, m long, factor array<double>")
    final = reduced.groupBy("id").agg(F.sum("m").alias("m"), F.collect_list("factor").alias("factors"))
    return final.mapInArrow(solve, "id long, coeffs array<double>")


def ar_coefficient(src: Source, features: list[Feature]) -> DataFrame:
    out = None
    for channel, k in dict.fromkeys((f.channel, f["k"]) for f in features):
        picks = [
            F.try_element_at("coeffs", F.lit(f["coeff"] + 1)).alias(f"f{i}")
            for i, f in enumerate(features)
            if (f.channel, f["k"]) == (channel, k)
        ]
        one = autoregression(src, channel, k).select("id", *picks)
        out = one if out is None else out.join(one, "id", "outer")
    return out


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count new phrases in rows sorted by (id, which, pos): a trie walk that remembers only the trie."""
    key, trie, node, found, rows = None, {}, 0, 0, 0
    done: list[tuple] = []
    for batch in batches:
        for i, which, symbol in zip(batch["id"].to_pylist(), batch["which"].to_pylist(), batch["symbol"].to_pylist()):
            if (i, which) != key:
                if key is not None:
                    done.append((*key, found / rows))
                key, trie, node, found, rows = (i, which), {}, 0, 0, 0
            rows += 1
            step = trie.get((node, symbol))
            if step is None:
                found += 1
                trie[(node, symbol)] = found
                node = 0
            else:
                node = step
        if done:
            yield _complexities(done)
            done = []
    if key is not None:
        yield _complexities([(*key, found / rows)])


def _complexities(done: list[tuple]) -> pa.RecordBatch:
    ids, which, values = zip(*done)
    return pa.RecordBatch.from_pydict({"id": ids, "which": pa.array(which, pa.int32()), "value": values})


def lempel_ziv_complexity(src: Source, features: list[Feature]) -> DataFrame:
    """Distinct phrases of the quantised series per sample.

    The parse is sequential by definition. Sorted partitions are streamed, so a task holds the phrases seen so far, not
    the series. Quantisation happens before, in the plan.
    """
    rows = src.rows
    channels = list(dict.fromkeys(f.channel for f in features))
    stats = rows.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(c).alias(f"{c}@lo") for c in channels],
        *[F.max(c).alias(f"{c}@hi") for c in channels],
    )
    symbols = []
    for f in features:
        lo, hi = F.col(f"{f.channel}@lo"), F.col(f"{f.channel}@hi")
        place = F.ceil(F.try_divide(F.col(f.channel) - lo, hi - lo) * f["bins"]) - 1
        symbol = F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)).cast("int")
        symbols.append(F.when(F.col(f.channel).isNotNull(), symbol))
    parsed = (
        attach(rows, stats, "id")
        .select("id", "pos", F.posexplode(F.array(*symbols)).alias("which", "symbol"))
        .filter(F.col("symbol").isNotNull())
        .repartition("id", "which")
        .sortWithinPartitions("id", "which", "pos")
        .select("id", "which", "symbol")
        .mapInArrow(_phrases, "id long, which int, value double")
    )
    picks = [F.max(F.when(F.col("which") == i, F.col("value"))).alias(f"f{i}") for i in range(len(features))]
    return parsed.groupBy("id").agg(*picks)


