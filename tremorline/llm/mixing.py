"""Mixing sources to target weights with Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorline.llm.common import WORD, prefix_sums, table, text_of
from tremorline.llm.registry import query
from tremorline.session import materialize

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = 20240229


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of letters and spaces in a text."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L} ]", ""))
    return F.greatest(F.lit(0.1), kept / F.greatest(F.length(text), F.lit(1)))


def sampling_key(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``size`` (words) and the sampling order (``key``, ``doc_id``, ``tie``).

    ``key`` is an exponential variable with the document's quality weight as its rate, drawn from a hash of the document:
    the first documents by key are a sample without replacement in which the heavier ones come earlier.
    """
    text = text_of()
    tie = F.xxhash64(text)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", text), 11) + 1) / F.lit(float(2**53 + 1))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.withColumns({"size": size, "tie": tie, "key": -F.log(draw) / quality_weight(text)})


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    Sources by code point, null last, get ``weights`` in turn. Targets share the whole size by weight; a target stops at
    ``most`` times its source's size and what is above goes to the others, until none is above. Each round is one
    aggregate over the table of sources; only its sums reach the driver.
    """
    sources = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = prefix_sums(sources, [], [F.col("source").asc_nulls_last()], F.lit(1), "rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(
        ranked.withColumn("weight", F.get(turn, ((F.col("rank") - 1) % len(weights)).cast("int"))).drop("rank"), "weights"
    )
    cap = (F.col("source_size") * most).cast("double")
    whole, share = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (whole or 0) / (share or 1), -1
    while True:
        full = cap <= F.col("weight") * F.lit(float(level))
        held, rest, n = ranked.agg(
            F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))
        ).first()
        if n == capped or not rest:
            break
        level, capped = (whole - (held or 0.0)) / rest, n
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level))))


def mixing_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): what the mix takes of it.

    ``source``, ``size`` (words; 0 for null or empty text), ``source_size``, ``target`` (of the source), ``epochs`` (how
    often every document of the source is taken), ``taken`` (words taken, repeats counted). What remains of the target
    after whole epochs is filled in the order of the sampling key; the document on the boundary counts with the words
    that still fit. Rows may repeat: each is a document. Identical rows share one key. Null doc_ids and sources are
    values like any other. An empty table gives no rows. Other columns are ignored.
    """
    keyed = sampling_key(docs.select("doc_id", "text", "source"), seed).drop("text")
    keyed = materialize(keyed, "mix")
    targets = materialize(source_targets(keyed.select("source", "size"), weights, most), "targets")
    named = targets.withColumnRenamed("source", "__source")
    order = [F.col("key"), F.col("doc_id"), F.col("tie")]
    summed = prefix_sums(keyed, ["source"], order, F.col("size"), "upto")
    joined = summed.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    ratio = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.least(F.floor(ratio), F.lit(most)).cast("long")
    out = joined.withColumn("epochs", epochs)
    out = out.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size")))
    return out.withColumn("taken", F.col("epochs") * F.col("size") + part)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed documents: each row of ``docs``, all columns, as often as the mix takes it.

    Documents stay whole: the one on the boundary is taken if at least half of it fits. The plan leaves one row per
    source, its epochs and the largest sampling key taken, so the texts themselves are not shuffled.
    """
    plan = mixing_plan(docs, weights, most, seed)
    last = F.struct("key", F.col("doc_id").alias("id"), "tie")
    near = 2 * (F.col("rest") - F.col("upto")) + F.col("size") >= 0
    bounds = plan.groupBy("source").agg(
        F.first("epochs").alias("__epochs"), F.max(F.when(near & (F.col("rest") > 0), last)).alias("__last")
    )
    bounds = materialize(bounds.withColumnRenamed("source", "__source"), "bounds")
    mine = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"), F.col("source").alias("__own"))
    keyed = sampling_key(mine, seed).join(bounds, F.col("__own").eqNullSafe(F.col("__source")))
    once = F.coalesce((F.struct("key", F.col("doc_id").alias("id"), "tie") <= F.col("__last")).cast("int"), F.lit(0))
    times = (F.col("__epochs") + once).cast("int")
    repeated = keyed.withColumn("__times", F.explode(F.array_repeat(F.lit(1), times)))
    return repeated.select("__row.*")


@query("op2_mix_sources")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix with weights 5, 2, 1 takes of every document."""
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")
