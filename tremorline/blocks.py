"""Splitting of long series, so that no task ever holds one whole series.

A series (or zone) may hold a third of all rows. Everything ordered by position is therefore computed per
``(key, block)`` with ``block = position div BLOCK_ROWS``:

* sliding frames and lags get the few neighbouring rows they need from ``with_halo``;
* running totals are taken inside a block and shifted by the totals of the earlier blocks (``running``);
* values of a whole series are aggregated with map-side combine and joined back on ``(key, block)`` after
  ``per_block`` has repeated them once per block, so the join has no hot key either.

Short series have the single block 0 and cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorline.session import materialize

# Rows of one series sorted together in a task (a block of doubles is a few MB).
BLOCK_ROWS = 1 << 16

# Groups above this many rows are split before they are ranked by an arbitrary value. A table of R rows has at most
# R / SPLIT_ROWS such groups: fewer than 160 000 for 10**13 rows, under 10 MB, which bounds the broadcast of them.
SPLIT_ROWS = 1 << 26

# A split group gets this many parts per SPLIT_ROWS rows, to leave room for uneven values.
PARTS_PER_SPLIT = 64


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def block_of(pos: str | Column, rows: int | None = None) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(rows or BLOCK_ROWS)).cast("long")


def with_halo(
    df: DataFrame, keys: str | Sequence[str], pos: str, back: int, ahead: int, rows: int | None = None
) -> DataFrame:
    """Add ``block`` and repeat each row in the blocks whose rows look at it.

    A row at ``p`` may look at ``p-back .. p+ahead``. The result is hash-partitioned by ``(keys, block)``; windows over
    these columns need no further exchange. Drop the repeated rows afterwards with ``core``.
    """
    rows = rows or BLOCK_ROWS
    first = block_of(F.greatest(F.col(pos) - ahead, F.lit(0)), rows)
    last = block_of(F.col(pos) + back, rows)
    out = df.withColumn("block", F.explode(F.sequence(first, last)))
    return out.repartition(*[F.col(k) for k in _names(keys)], F.col("block"))


def block_window(keys: str | Sequence[str], pos: str):
    return Window.partitionBy(*_names(keys), "block").orderBy(pos)


def core(df: DataFrame, pos: str, rows: int | None = None) -> DataFrame:
    """Keep each row once, in its own block."""
    return df.filter(F.col("block") == block_of(pos, rows))


def trim(df: DataFrame, pos: str, back: int, ahead: int, rows: int | None = None) -> DataFrame:
    """Keep only ``back``/``ahead`` of the neighbouring rows of every block."""
    start = F.col("block") * (rows or BLOCK_ROWS)
    return df.filter((F.col(pos) >= start - back) & (F.col(pos) < start + (rows or BLOCK_ROWS) + ahead))


def per_block(stats: DataFrame, n: str = "n", rows: int | None = None) -> DataFrame:
    """Repeat the one row a series has in ``stats`` for each of its blocks (``n`` = rows of the series).

    In two steps, so that the block numbers of a huge series never form one array.
    """
    step = 4096
    last = block_of(F.greatest(F.col(n) - 1, F.lit(0)), rows)
    zero = F.lit(0).cast("long")
    out = stats.withColumn("__from", F.explode(F.sequence(zero, last, F.lit(step).cast("long"))))
    stop = F.least(F.col("__from") + (step - 1), last)
    return out.withColumn("block", F.explode(F.sequence(F.col("__from"), stop))).drop("__from")


def attach(df: DataFrame, stats: DataFrame, keys: str | Sequence[str], n: str = "n", rows: int | None = None) -> DataFrame:
    """Join values of whole series to rows that already carry ``block``."""
    return df.join(per_block(stats, n, rows), [*_names(keys), "block"])


def running(
    df: DataFrame,
    keys: str | Sequence[str],
    pos: str,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add running totals and running maxima (current row included) of ``{new column: expression}``.

    Values per block are pre-aggregated; only these, one row per block, are combined along the series.
    """
    keys, sums, maxima = _names(keys), sums or {}, maxima or {}
    if "block" not in df.columns:
        df = df.withColumn("block", block_of(pos, rows))
    per = df.groupBy(*keys, "block").agg(
        *[F.sum(e).alias(f"__{c}") for c, e in sums.items()], *[F.max(e).alias(f"__{c}") for c, e in maxima.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        *keys,
        "block",
        *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums],
        *[F.max(f"__{c}").over(earlier).alias(f"__{c}") for c in maxima],
    )
    inside = block_window(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    out = df.select(
        "*",
        *[F.coalesce(F.sum(e).over(inside), F.lit(0)).alias(c) for c, e in sums.items()],
        *[F.max(e).over(inside).alias(c) for c, e in maxima.items()],
    ).join(offsets, [*keys, "block"])
    for c in sums:
        out = out.withColumn(c, F.col(c) + F.col(f"__{c}"))
    for c in maxima:
        out = out.withColumn(c, F.greatest(F.col(c), F.col(f"__{c}")))
    return out.drop(*[f"__{c}" for c in [*sums, *maxima]])


def longest(df: DataFrame, keys: str | Sequence[str] = "id") -> int:
    """Rows of the largest group: one pre-aggregated pass over the key columns, one number to the driver."""
    sizes = df.groupBy(*_names(keys)).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def _split_large(
    df: DataFrame, keys: list[str], by: Column, limit: int, largest: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Add ``__slot``: one value for ordinary groups, ranges of ``by`` in ascending order for groups above ``limit`` rows.

    Ranges above ``limit`` rows are cut again, whatever the distribution, until they hold fewer rows or a single value.

    ``__n`` is the size of a split group, else NULL. Also returns ``(keys, __slot, __before)``: how many rows of a
    split group lie in lower slots; None if no group is that large, in which case nothing more is read or joined.
    """
    largest = longest(df, keys) if largest is None else largest
    if largest <= limit:
        # series of a single block may be read from a table that is bucketed by (key, block): keep that as the group
        single = "block" in df.columns and largest <= BLOCK_ROWS
        slot = F.col("block") if single else F.lit(0).cast("long")
        return df.withColumns({"__slot": slot, "__n": F.lit(None).cast("long")}), None
    measured = df.withColumn("__by", by.cast("double"))
    sizes = measured.groupBy(*keys).agg(F.count("__by").alias("__n")).filter(F.col("__n") > limit)
    bounded = F.broadcast(materialize(sizes, "large"))  # at most rows / limit groups, see SPLIT_ROWS
    slot = F.when(F.col("__n").isNull(), F.array(F.lit(0))).otherwise(F.array(_octave(F.col("__by"))))
    slotted = measured.join(bounded, keys, "left").withColumn("__slot", slot)
    while True:
        wide = _wide_slots(slotted, keys, limit)
        if wide is None:
            break
        slotted = _refined(slotted, wide, keys)
    counts = slotted.filter(F.col("__n").isNotNull()).groupBy(*keys, "__slot").agg(F.count(F.lit(1)).alias("__cnt"))
    before = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__slot", F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__before"))
    return slotted.drop("__by"), offsets


def _octave(v: Column) -> Column:
    """A number that ascends with ``v`` and is the same for values of one sign and power of two; null comes first."""
    power = F.floor(F.log2(F.abs(v))).cast("int") + 1100
    infinite = F.lit(float("inf"))
    return (
        F.when(v.isNull(), -4000).when(F.isnan(v), 4000).when(v == infinite, 3000).when(v == -infinite, -3000)
        .when(v == 0, 0).when(v > 0, power).otherwise(-power)
    )


def _wide_slots(slotted: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Slots of split groups that still hold more than ``limit`` rows of different values, with their bounds."""
    infinite = F.lit(float("inf"))
    finite = F.when((F.col("__by") < infinite) & (F.col("__by") > -infinite), F.col("__by"))
    wide = (
        slotted.filter(F.col("__n").isNotNull())
        .groupBy(*keys, "__slot")
        .agg(F.count("__by").alias("__rows"), F.min(finite).alias("__lo"), F.max(finite).alias("__hi"))
        .filter((F.col("__rows") > limit) & (F.col("__hi") > F.col("__lo")))
        .withColumn("__parts", (F.ceil(F.col("__rows") / limit) * PARTS_PER_SPLIT).cast("int"))
        .drop("__rows")
    )
    wide = materialize(wide, "wide")
    return None if wide.isEmpty() else wide


def _refined(slotted: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Cut wide slots into parts of equal width between their own smallest and largest value.

    A slot is the path of its parts, so that slots compare like their values. The first part is the octave, so that values
    of a slot differ by less than a factor of two; each further step tells at least six bits more of 52 apart.
    """
    v, lo, hi, parts = (F.col(c) for c in ("__by", "__lo", "__hi", "__parts"))
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves, as a difference of large values could overflow
    inner = F.least(F.floor(share * parts).cast("int"), parts - 1)
    place = F.when(v.isNull() | (v <= lo), 0).when(v >= hi, parts - 1).otherwise(inner)
    renamed = wide.select(*keys, F.col("__slot").alias("__wide"), "__lo", "__hi", "__parts")
    cond = (F.col("__slot") == F.col("__wide")) & (F.col("__n").isNotNull())
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__k_{k}")
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = slotted.join(F.broadcast(renamed), cond, "left")  # at most rows / limit slots
    path = F.when(parts.isNull(), F.col("__slot")).otherwise(F.concat("__slot", F.array(place)))
    return joined.withColumn("__slot", path).drop("__wide", "__lo", "__hi", "__parts", *[f"__k_{k}" for k in keys])


def number_rows(
    df: DataFrame,
    keys: str | Sequence[str],
    by: Column,
    ties: Sequence[str] = (),
    name: str = "time",
    limit: int | None = None,
) -> DataFrame:
    """Dense numbers 0, 1, ... per key in the order of ``by`` (a number), then ``ties``.

    Only groups above ``limit`` rows are split into ranges of ``by``; the numbers inside a range are shifted by the
    rows of the earlier ranges.
    """
    keys = _names(keys)
    slotted, offsets = _split_large(df, keys, by, limit or SPLIT_ROWS)
    order = Window.partitionBy(*keys, "__slot").orderBy(by, *ties)
    out = slotted.withColumn(name, (F.row_number().over(order) - 1).cast("long"))
    if offsets is not None:
        out = out.join(offsets, [*keys, "__slot"], "left").withColumn(
            name, F.col(name) + F.coalesce(F.col("__before"), F.lit(0))
        )
    return out.drop("__slot", "__before", "__n")


def quantile_position(q: float, n: Column) -> Column:
    """0-based fractional rank of a quantile; rounding keeps whole ranks whole."""
    return F.round(F.lit(float(q)) * (n - 1), 9)


def exact_quantiles(
    df: DataFrame,
    keys: str | Sequence[str],
    value: str,
    wanted: dict[str, float],
    limit: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles ``{name: q}`` of ``value`` per key; ``largest`` = rows of the largest group.

    The needed ranks are picked from sorted ``(key, slot)`` groups; nothing is gathered per key. Equal values of split
    groups are counted before the shuffle, so one value that fills a series does no harm.
    """
    keys = _names(keys)
    limit = limit or SPLIT_ROWS
    kept = [*keys, "block"] if "block" in df.columns else keys
    values = df.select(*kept, F.col(value).cast("double").alias("__v"))
    slotted, offsets = _split_large(values, keys, F.col("__v"), limit, largest)
    slotted = slotted.filter(F.col("__v").isNotNull())
    if offsets is None:
        counted = slotted.withColumn("__c", F.lit(1))
    else:
        counted = slotted.groupBy(*keys, "__slot", "__v", "__n").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*keys, "__slot")
    run = group.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("__end", F.sum("__c").over(run))
    if offsets is None:
        ranked = ranked.withColumn("__n", F.count(F.lit(1)).over(group))
    else:
        ranked = (
            ranked.withColumn("__n", F.coalesce(F.col("__n"), F.sum("__c").over(group)))
            .join(offsets, [*keys, "__slot"], "left")
            .withColumn("__end", F.col("__end") + F.coalesce(F.col("__before"), F.lit(0)))
        )
    ranked = ranked.withColumn("__start", F.col("__end") - F.col("__c"))
    picks = []
    for i, q in enumerate(wanted.values()):
        pos = quantile_position(q, F.col("__n"))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("__start") <= rank) & (rank < F.col("__end"))
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{side}{i}"))
    found = ranked.groupBy(*keys).agg(F.max("__n").alias("__n"), *picks)
    out = []
    for i, (name, q) in enumerate(wanted.items()):
        pos = quantile_position(q, F.col("__n"))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*keys, *out)


def dense_ids(ids: DataFrame, name: str = "id", out: str = "new_id") -> DataFrame:
    """(id, new_id): distinct whole numbers renumbered 0, 1, ... in their order.

    A tree of counts: ranges of BLOCK_ROWS numbers, ranges of BLOCK_ROWS such ranges, and so on up to a level of at most
    BLOCK_ROWS ranges. On every level a range is shifted by the counts of the earlier ones of the same parent and by that
    of the parent, so no window holds more than BLOCK_ROWS rows, however sparse the numbers are.
    """
    ids = ids.select(name).distinct()
    low, high = ids.agg(F.min(name), F.max(name)).first()
    levels = [ids.withColumn("block", block_of_whole(F.col(name))).groupBy("block").agg(F.count(F.lit(1)).alias("__c"))]
    low, high = ((x or 0) // BLOCK_ROWS for x in (low, high))
    while high - low >= BLOCK_ROWS:
        up = block_of_whole(F.col("block"))
        levels.append(levels[-1].groupBy(up.alias("block")).agg(F.sum("__c").alias("__c")))
        low, high = low // BLOCK_ROWS, high // BLOCK_ROWS
    shift = None
    for counts in reversed(levels):
        parent = F.lit(0).cast("long") if shift is None else block_of_whole(F.col("block"))
        placed = counts.withColumn("__up", parent)
        earlier = Window.partitionBy("__up").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("__before", F.coalesce(F.sum("__c").over(earlier), F.lit(0)))
        if shift is not None:
            placed = placed.join(shift, "__up").withColumn("__before", F.col("__before") + F.col("__shift"))
        shift = placed.select(F.col("block").alias("__up"), F.col("__before").alias("__shift"))
    order = Window.partitionBy("block").orderBy(name)
    return (
        ids.withColumn("block", block_of_whole(F.col(name)))
        .withColumn(out, (F.row_number().over(order) - 1).cast("long"))
        .join(shift.select(F.col("__up").alias("block"), "__shift"), "block")
        .select(name, (F.col(out) + F.col("__shift")).alias(out))
    )


def block_of_whole(x: Column) -> Column:
    """``floor(x / BLOCK_ROWS)`` of a 64-bit number, exactly."""
    rows = F.lit(BLOCK_ROWS).cast("long")
    return F.call_function("div", x.cast("long") - F.pmod(x.cast("long"), rows), rows)


def shuffled_rank(ids: DataFrame, seed: int, name: str = "id", out: str = "rank") -> DataFrame:
    """(id, rank, n): ranks 0..n-1 in a random but repeatable order, by the MD5 of ``id:seed``.

    The first four hex digits of the hash cut the ids into 65 536 even parts that are ranked separately.
    """
    hashed = ids.select(name).distinct().withColumn("__h", F.md5(F.concat_ws(":", F.col(name), F.lit(seed)).cast("binary")))
    hashed = hashed.withColumn("__p", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    counts = hashed.groupBy("__p").agg(F.count(F.lit(1)).alias("__c")).withColumn("__all", F.lit(0))
    whole = Window.partitionBy("__all")  # at most 65 536 rows
    earlier = whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__p", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"), F.sum("__c").over(whole).alias("n")
    )
    order = Window.partitionBy("__p").orderBy("__h", name)
    return (
        hashed.withColumn(out, (F.row_number().over(order) - 1).cast("long"))
        .join(F.broadcast(offsets), "__p")  # at most 65 536 rows
        .select(name, (F.col(out) + F.col("__before")).alias(out), "n")
    )


def ordered_samples(pos: str, value: str) -> Column:
    """Aggregate: the (t, x) pairs of a group in the order of ``pos``."""
    pair = F.struct(F.col(pos).cast("long").alias("t"), F.col(value).cast("double").alias("x"))
    return F.sort_array(F.collect_list(pair))


def series_of(batch: pa.RecordBatch, name: str, part: str = "x") -> Iterator[np.ndarray]:
    """The ``x`` (or ``t``) values of every list of (t, x) pairs, without copying."""
    lists = batch[name]
    x = lists.values.field(part).to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:]):
        yield x[a:b]
