"""Curation of labelled training sets: union, class filters, renumbering, balancing, splits, batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorline.blocks import dense_ids, number_rows, shuffled_rank
from tremorline.operators.preprocess import adaptive_avg_pool
from tremorline.session import materialize


@dataclass(frozen=True)
class Dataset:
    """Series (id, time, signal_raw) and their classes (id, label)."""

    signals: DataFrame
    labels: DataFrame


def concat_datasets(datasets: Sequence[Dataset]) -> Dataset:
    """Stack datasets in the given order; the ids of each are shifted past the last id so far."""

    def stacked(tables: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.withColumn("__src", F.lit(i)) for i, t in enumerate(tables)])

    labels = stacked([d.labels for d in datasets])
    sizes = labels.groupBy("__src").agg((F.max("id") + 1).alias("__size")).withColumn("__all", F.lit(0))
    earlier = Window.partitionBy("__all").orderBy("__src").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__src", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__shift"))

    def shifted(df: DataFrame) -> DataFrame:
        out = df.join(F.broadcast(offsets), "__src")  # one row per listed dataset
        return out.withColumn("id", F.col("id") + F.col("__shift")).drop("__src", "__shift")

    return Dataset(shifted(stacked([d.signals for d in datasets])), shifted(labels))


def drop_classes(ds: Dataset, classes: Sequence[str]) -> Dataset:
    """Remove all series of the listed classes."""
    if not classes:
        return ds
    unwanted = F.col("label").isin(list(classes))
    gone = ds.labels.filter(unwanted).select("id")
    return Dataset(ds.signals.join(gone, "id", "left_anti"), ds.labels.filter(~unwanted))


def rename_classes(ds: Dataset, renames: dict[str, str]) -> Dataset:
    """Replace class names, pair after pair, so a -> b and then b -> c gives c."""
    resolved = {}
    for old, new in renames.items():
        resolved = {k: new if v == old else v for k, v in resolved.items()}
        resolved.setdefault(old, new)
    if not resolved:
        return ds
    label = reduce(lambda c, kv: c.when(F.col("label") == kv[0], kv[1]), resolved.items(), F).otherwise(F.col("label"))
    return Dataset(ds.signals, ds.labels.withColumn("label", label))


def densify_ids(ds: Dataset) -> Dataset:
    """Close the gaps between ids.

    Labels and the new ids, one row per series, are written before they are joined, as both are read several times.
    """
    ds = Dataset(ds.signals, materialize(ds.labels, "labels"))
    ids = materialize(dense_ids(ds.labels), "ids")

    def renumbered(df: DataFrame) -> DataFrame:
        return df.join(ids, "id").withColumn("id", F.col("new_id")).drop("new_id")

    return Dataset(renumbered(ds.signals), renumbered(ds.labels))


def downsample_classes(ds: Dataset) -> Dataset:
    """Keep as many series of each class as the smallest class has, the lowest ids first; ids stay as they are."""
    smallest = ds.labels.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.min("c"))
    ranked = number_rows(ds.labels, "label", F.col("id"), name="__rank")
    labels = ranked.filter(F.col("__rank") < smallest.scalar()).drop("__rank").select("id", "label")
    return Dataset(ds.signals.join(labels.select("id"), "id", "left_semi"), labels)


@dataclass(frozen=True)
class LongJoiner:
    """Union, class filter, renaming, renumbering and (optionally) balancing, in this order."""

    labels_to_delete: Sequence[str] = ()
    renames: dict[str, str] = field(default_factory=dict)
    downsample: bool = False

    def concat(self, datasets: Sequence[Dataset]) -> Dataset:
        out = drop_classes(concat_datasets(datasets), self.labels_to_delete)
        out = densify_ids(rename_classes(out, self.renames))
        return downsample_classes(out) if self.downsample else out


# --- classes -------------------------------------------------------------------------------------------------------


def class_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def _indexed(classes: DataFrame, order: str) -> DataFrame:
    """Index of each class; a vocabulary of classes is small, and has one row per class here."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    return classes.select("label", (F.row_number().over(w) - 1).alias("class_idx"))


def label_index_sorted(labels: DataFrame) -> DataFrame:
    return _indexed(labels.select("label").distinct(), "label")


def label_index_seen(labels: DataFrame) -> DataFrame:
    return _indexed(labels.groupBy("label").agg(F.min("id").alias("__first")), "__first")


def sample_series(ds: Dataset, k: int, seed: int) -> DataFrame:
    """The signals of ``k`` randomly, but repeatably chosen series."""
    digest = F.md5(F.concat_ws(":", F.col("id"), F.lit(seed)).cast("binary"))
    chosen = ds.labels.select("id", digest.alias("__h")).orderBy("__h", "id").limit(k).select("id")
    return ds.signals.join(F.broadcast(chosen), "id", "left_semi")  # k rows


def spectra_by_class(spectrum: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean, lowest and highest binned spectrum of each class."""
    value = "signal_binned_fft"
    return (
        spectrum.join(labels, "id")
        .groupBy("label", "freq_num")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean"),
            F.min(value).alias("lowest"),
            F.max(value).alias("highest"),
        )
    )


# --- splits and batches --------------------------------------------------------------------------------------------


def split_train_test(labels: DataFrame, seed: int, test_share: float = 0.25) -> DataFrame:
    """(id, split): the test part has ``ceil(share n)`` series."""
    ranked = shuffled_rank(labels, seed)
    test = F.ceil(F.lit(test_share) * F.col("n"))
    return ranked.select("id", F.when(F.col("rank") >= F.col("n") - test, "test").otherwise("train").alias("split"))


def _three_way(labels: DataFrame, seed: int, train: float, validation: float) -> DataFrame:
    ranked = shuffled_rank(labels, seed)
    a = F.floor(F.lit(train) * F.col("n"))
    b = a + F.floor(F.lit(validation) * F.col("n"))
    rank = F.col("rank")
    split = F.when(rank < a, "train").when(rank < b, "validation").otherwise("test")
    start = F.when(rank < a, F.lit(0)).when(rank < b, a).otherwise(b)
    return ranked.select("id", split.alias("split"), (rank - start).alias("place"))


def split_3way(labels: DataFrame, seed: int, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """(id, split) with whole-number sizes; what remains goes to the test part."""
    return _three_way(labels, seed, train, validation).select("id", "split")


def batch_ids(labels: DataFrame, seed: int, size: int = 8, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """(split, batch_no, ids): consecutive batches of each part."""
    placed = _three_way(labels, seed, train, validation)
    pair = F.struct("place", "id")
    return (
        placed.groupBy("split", F.floor(F.col("place") / size).alias("batch_no"))
        .agg(F.sort_array(F.collect_list(pair)).alias("__b"))
        .select("split", "batch_no", F.col("__b.id").alias("ids"))
    )


def series_tensor(ds: Dataset, length: int = 3000) -> DataFrame:
    """(id, signal, class_idx): every series as an array of the same length, with the index of its class."""
    pooled = adaptive_avg_pool(ds.signals, length)
    arrays = pooled.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "pooled"))).alias("__s"))
    classes = ds.labels.join(label_index_seen(ds.labels), "label")
    return arrays.join(classes, "id").select("id", F.col("__s.pooled").alias("signal"), "class_idx")
