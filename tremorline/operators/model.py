"""Random-forest training and scoring, evaluation, alarm messages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorline.blocks import number_rows

# Fixed values of the tuned forest.
TUNED = {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 3, "featureSubsetStrategy": "log2", "bootstrap": True}
WIDTH = 1  # zones an alarm covers


def plain_columns(wide: DataFrame) -> DataFrame:
    """Feature columns named f0, f1, ... in alphabetical order, as ML stages cannot take dots and quotes."""
    names = sorted(c for c in wide.columns if c not in ("id", "label", "weight"))
    kept = [F.col(c) for c in ("id", "label", "weight") if c in wide.columns]
    return wide.select(*kept, *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(names)])


def array_columns(df: DataFrame, array: str, size: int) -> DataFrame:
    """An array of features as columns f0, f1, ..."""
    return df.select("*", *[F.get(array, F.lit(i)).alias(f"f{i}") for i in range(size)]).drop(array)


def feature_names(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[0] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def forest_stages(names: list[str], seed: int, **params) -> list:
    """Stages from feature columns and ``label`` to class probabilities."""
    # forests take no missing values; an undefined feature (constant or very short series) counts as 0
    filled = ", ".join(f"coalesce({c}, 0D) AS {c}_filled" for c in names)
    return [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}_filled" for c in names], outputCol="features"),
        StringIndexer(inputCol="label", outputCol="class_idx", stringOrderType="alphabetAsc", handleInvalid="keep"),
        RandomForestClassifier(labelCol="class_idx", featuresCol="features", seed=seed, **params),
    ]


def _pipeline(train: DataFrame, seed: int, **params) -> Pipeline:
    return Pipeline(stages=forest_stages(feature_names(train), seed, **params))


def train_baseline_rf(train: DataFrame, seed: int = 0, trees: int = 100) -> PipelineModel:
    """Forest with default settings on (label, f0, f1, ...)."""
    return _pipeline(train, seed, numTrees=trees).fit(train)


def balanced_weights(labels: DataFrame) -> DataFrame:
    """(label, n, weight): ``all / (classes * n)``, one row per class."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    total, classes = F.sum("n").over(everything), F.count(F.lit(1)).over(everything)
    return counts.withColumn("weight", total / (classes * F.col("n")))


def train_tuned_rf(train: DataFrame, seed: int = 0, **overrides) -> PipelineModel:
    """Forest with the tuned settings and balanced class weights."""
    weights = balanced_weights(train.select("label")).select("label", "weight")
    weighted = train.join(weights, "label")
    return _pipeline(train, seed, weightCol="weight", **{**TUNED, **overrides}).fit(weighted)


def stratified_folds(labels: DataFrame, folds: int = 3, seed: int = 0) -> DataFrame:
    """(id, fold): the series of each class dealt out in random order."""
    digest = F.md5(F.concat_ws(":", F.col("id"), F.lit(seed)).cast("binary"))
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    ranked = number_rows(labels.select("id", "label"), "label", place, ["id"], "__r")
    return ranked.select("id", (F.col("__r") % folds).cast("int").alias("fold"))


def search_params(
    train: DataFrame, grid: dict[str, Sequence], folds: int = 3, seed: int = 0
) -> tuple[CrossValidatorModel, list[dict]]:
    """Cross-validated grid over forest parameters, scored by the micro F1 (accuracy)."""
    pipeline = _pipeline(train, seed)
    forest = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(forest.getParam(name), list(values))
    maps = builder.build()
    cv = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=maps,
        evaluator=MulticlassClassificationEvaluator(labelCol="class_idx", metricName="accuracy"),
        numFolds=folds,
        foldCol="fold",
        parallelism=2,
    )
    data = train.join(stratified_folds(train, folds, seed), "id")
    fitted = cv.fit(data)
    results = [
        {**{p.name: v for p, v in m.items()}, "score": float(score)} for m, score in zip(maps, fitted.avgMetrics, strict=True)
    ]
    return fitted, results


def classes_of(model: PipelineModel) -> list[str]:
    """Class names in the order of the probabilities."""
    return list(model.stages[-2].labels)


def predict_proba(model: PipelineModel, data: DataFrame) -> DataFrame:
    """(id, probabilities): class -> probability, rounded to 2 digits."""
    names = classes_of(model)
    # the indexer of the classes, second to last, is not needed for scoring
    scored = PipelineModel([s for s in model.stages if s is not model.stages[-2]]).transform(data)
    share = F.slice(vector_to_array("probability"), 1, len(names))
    keys = F.array(*[F.lit(n) for n in names])
    return scored.select("id", F.map_from_arrays(keys, F.transform(share, lambda p: F.round(p, 2))).alias("probabilities"))


def top_class(probabilities: str | Column) -> Column:
    """The likeliest class of a map; the first in class order among equals."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    pairs = F.transform(F.map_entries(p), lambda e: F.struct((-e["value"]).alias("rank"), e["key"].alias("name")))
    return F.array_min(pairs)["name"]


def classification_report(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and averages of (y, pred); 0/0 counts as 0.

    Everything after the count of (y, pred) pairs works on one row per pair of classes.
    """
    cells = pairs.groupBy(F.col("y").cast("string").alias("y"), F.col("pred").cast("string").alias("pred")).agg(
        F.count(F.lit(1)).alias("c")
    )
    hit = F.when(F.col("y") == F.col("pred"), F.col("c")).otherwise(0)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("class"), F.col("c").alias("support"), F.lit(0).cast("long").alias("said"), hit.cast("long").alias("hit")),
                F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("c").alias("said"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "said", "hit")])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    hits = F.col("hit")
    per = sums.select(
        "class",
        ratio(hits, F.col("said")).alias("precision"),
        ratio(hits, F.col("support")).alias("recall"),
        ratio(2 * hits, F.col("said") + F.col("support")).alias("f1"),
        "support",
        "hit",
    )
    metrics = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = ratio(F.sum("hit"), total)
    rows = {
        "accuracy": [accuracy.alias(m) for m in metrics],
        "macro avg": [F.avg(m).alias(m) for m in metrics],
        "weighted avg": [ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in metrics],
    }
    summaries = [
        per.agg(*aggs, total.alias("support")).select(F.lit(name).alias("class"), *metrics, "support")
        for name, aggs in rows.items()
    ]
    return reduce(DataFrame.unionByName, summaries, per.select("class", *metrics, "support"))


def misclassified_ids(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("pred") != F.col("y")).select("id")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def alarm_message(scored: DataFrame) -> DataFrame:
    """(nchn, width, alarm, timestamp) of scored alarms (zone, probabilities, date_time)."""
    return scored.select(
        F.col("zone").alias("nchn"),
        F.lit(WIDTH).alias("width"),
        top_class("probabilities").alias("alarm"),
        (F.unix_micros("date_time") / 1e6).alias("timestamp"),
    )
