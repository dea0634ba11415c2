"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorline.session import materialize, tune

# White space between words, in Java and RE2 syntax.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equality of columns in which null equals null."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group up to this one, in ``order``.

    The rows are cut into sorted ranges of (group, order), so that a group of any size is spread over many tasks; each
    range is summed alone and shifted by the totals of the group's earlier ranges, of which there are at most as many as
    partitions. Rows equal in ``order`` may come in any order among themselves.
    """
    group = list(group)
    ranged = df.withColumn("__v", value).repartitionByRange(partitions(df.sparkSession), *group, *order)
    ranged = materialize(ranged.withColumn("__pid", F.spark_partition_id()), "ranges")
    run = Window.partitionBy("__pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("__pid", *group).agg(F.sum("__v").alias("__t"))
    earlier = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.withColumn("__before", F.coalesce(F.sum("__t").over(earlier), F.lit(0))).drop("__t")
    keys = ["__pid", *group]
    shift = shift.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__before")
    summed = ranged.withColumn(name, F.sum("__v").over(run))
    cond = F.lit(True)
    for i, c in enumerate(keys):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    out = summed.join(shift, cond).withColumn(name, F.col(name) + F.col("__before"))
    return out.select(*df.columns, name)
