"""The feature table as a pipeline stage, so that a saved model takes raw signals."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorline.functions.catalog import FREQ_FEATURES, TIME_FEATURES, listed
from tremorline.functions.extract import all_features
from tremorline.operators.model import TUNED, forest_stages, plain_columns
from tremorline.operators.preprocess import MEAN_WINDOW, STD_WINDOW, TimePreprocessing
from tremorline.operators.spectrum import FreqPreprocessing
from tremorline.session import materialize


class SeriesFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """(id, time, signal_raw[, label]) -> (id[, label], f0 .. f99), features in alphabetical order.

    The label of a series is that of its rows. The result, one row per series, is written once, as the following stages
    read it several times.
    """

    stdWindow = Param(Params._dummy(), "stdWindow", "window of the rolling std", TypeConverters.toInt)
    meanWindow = Param(Params._dummy(), "meanWindow", "window of the rolling mean", TypeConverters.toInt)
    normalize = Param(Params._dummy(), "normalize", "normalise before filtering", TypeConverters.toBoolean)
    nBins = Param(Params._dummy(), "nBins", "bins of the spectrum", TypeConverters.toInt)
    fs = Param(Params._dummy(), "fs", "samples per second", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, stdWindow=STD_WINDOW, meanWindow=MEAN_WINDOW, normalize=True, nBins=70, fs=1000.0):
        super().__init__()
        self._setDefault(stdWindow=STD_WINDOW, meanWindow=MEAN_WINDOW, normalize=True, nBins=70, fs=1000.0)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        time = TimePreprocessing(get(self.stdWindow), get(self.meanWindow), get(self.normalize))
        freq = FreqPreprocessing(get(self.nBins), get(self.fs))
        out = plain_columns(all_features(dataset.select("id", "time", "signal_raw"), time, freq))
        if "label" in dataset.columns:
            out = out.join(dataset.groupBy("id").agg(F.max("label").alias("label")), "id")
        return materialize(out, "features")


def signal_pipeline(features: SeriesFeatures | None = None, seed: int = 0, **overrides) -> Pipeline:
    """Features and tuned forest in one pipeline: fit on labelled signals, score raw signals."""
    names = [f"f{i}" for i in range(len(listed(TIME_FEATURES)) + len(listed(FREQ_FEATURES)))]
    return Pipeline(stages=[features or SeriesFeatures(), *forest_stages(names, seed, **{**TUNED, **overrides})])
