"""Detectors and scores as Spark ML estimators, models and evaluators.

They can be set, copied, put in pipelines, saved and loaded like any other of Spark's, and stand
where a user's own do: ``fit_classifier``, cross-validation, search and training runs take any
estimator by object and any evaluators as scorers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLWritable,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.learning import store
from metricloom.learning.evaluate import scores
from metricloom.operators import outliers


class _Detecting(Params):
    """What detectors have in common."""

    featuresCols = Param(Params._dummy(), "featuresCols", "numeric columns", TypeConverters.toListString)
    contamination = Param(Params._dummy(), "contamination", "share of anomalies", TypeConverters.toFloat)
    predictionCol = Param(Params._dummy(), "predictionCol", "-1 for anomalies, 1 for others", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(contamination=0.1, predictionCol="prediction")

    def _of(self, name: str):
        return self.getOrDefault(self.getParam(name))


class _StoredWriter(DefaultParamsWriter):
    """Parameters by Spark's way, the fitted state as a table beside them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance._save_state(self.sparkSession, f"{path}/state")


class _StoredReader(DefaultParamsReader):
    def load(self, path: str):
        instance = super().load(path)
        instance._load_state(self.sparkSession, f"{path}/state")
        return instance


class _StoredModel(Model, _Detecting, MLReadable, MLWritable):
    """A fitted detector; ``fitted`` is the operator's own object."""

    def __init__(self, fitted=None):
        super().__init__()
        self.fitted = fitted

    def write(self) -> _StoredWriter:
        return _StoredWriter(self)

    @classmethod
    def read(cls) -> _StoredReader:
        return _StoredReader(cls)

    @property
    def features(self) -> list[str]:
        return list(self._of("featuresCols"))


class _ForestParams(_Detecting):
    keyCols = Param(Params._dummy(), "keyCols", "columns that name a row", TypeConverters.toListString)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "rows of a tree", TypeConverters.toInt)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "share of the features of a tree", TypeConverters.toFloat)
    bootstrap = Param(Params._dummy(), "bootstrap", "draw rows with replacement", TypeConverters.toBoolean)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(numTrees=100, maxSamples=256, maxFeatures=1.0, bootstrap=False, seed=42)


class IsolationForestModel(_StoredModel, _ForestParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.predict(dataset, self._of("predictionCol"))

    def _save_state(self, spark, path: str) -> None:
        store.save_forest(spark, self.fitted, path)

    def _load_state(self, spark, path: str) -> None:
        self.fitted = store.load_forest(spark, path)


class IsolationForestDetector(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Trees on hashed samples; rows whose score lies below the training quantile are -1."""

    @keyword_only
    def __init__(
        self, *, featuresCols=None, keyCols=None, contamination=0.1, numTrees=100, maxSamples=256,
        maxFeatures=1.0, bootstrap=False, seed=42, predictionCol="prediction",
    ):
        super().__init__()
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, **given):
        return self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> IsolationForestModel:
        forest = outliers.fit_isolation_forest(
            dataset, self._of("featuresCols"), self._of("keyCols"), self._of("numTrees"), self._of("maxSamples"),
            self._of("contamination"), self._of("maxFeatures"), self._of("bootstrap"), self._of("seed"),
        )
        return self._copyValues(IsolationForestModel(forest))


class _HistogramParams(_Detecting):
    numBins = Param(Params._dummy(), "numBins", "bins of a column", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(numBins=10)


class HistogramModel(_StoredModel, _HistogramParams):
    """Histogram scores with the cut of the training rows."""

    def __init__(self, fitted=None, cut: float = 0.0):
        super().__init__(fitted)
        self.cut = cut

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored = self.fitted.score(dataset)
        return scored.withColumn(self._of("predictionCol"), F.when(F.col("score") > F.lit(self.cut), -1).otherwise(1))

    def _save_state(self, spark, path: str) -> None:
        store.save_histograms(spark, self.fitted, self.cut, path)

    def _load_state(self, spark, path: str) -> None:
        self.fitted, self.cut = store.load_histograms(spark, path)


class HistogramDetector(Estimator, _HistogramParams, DefaultParamsReadable, DefaultParamsWritable):
    """Rows in rare bins of equal-width histograms are -1."""

    @keyword_only
    def __init__(self, *, featuresCols=None, contamination=0.1, numBins=10, predictionCol="prediction"):
        super().__init__()
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, **given):
        return self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> HistogramModel:
        fitted = outliers.fit_hbos(dataset, self._of("featuresCols"), self._of("numBins"))
        cut = outliers.exact_quantiles(fitted.score(dataset), "score", [1 - self._of("contamination")])[0]
        return self._copyValues(HistogramModel(fitted, cut))


class LabelEvaluator(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """One of the hard-label scores, by name."""

    metricName = Param(Params._dummy(), "metricName", "a column of scores()", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "prediction", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, metricName="f1_weighted", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._set(metricName="f1_weighted", labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        name, label, found = (self.getOrDefault(self.getParam(n)) for n in ("metricName", "labelCol", "predictionCol"))
        return float(scores(dataset.select(q(label), q(found)), label, found).first()[name] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def judged(evaluator: Evaluator, rows: DataFrame, columns: Mapping[str, str]) -> float:
    """What an evaluator makes of scored rows; its own column settings give way to ``columns``.

    Columns it does not know are left alone, as are settings of a user's own.
    """
    known = {evaluator.getParam(p): c for p, c in columns.items() if evaluator.hasParam(p) and c in rows.columns}
    return float(evaluator.evaluate(rows, known))
