"""Training and detection from one specification.

Stages follow one order: shape, filter, scale, augment, fit or load, report. Scaling comes
before augmentation, in training and in detection alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.learning import store
from metricloom.learning.supervised import Classifier, fit_classifier
from metricloom.learning.tree_shapley import of_classifier, of_forest, tree_shapley
from metricloom.operators import clean
from metricloom.operators.outliers import DETECTORS, IsolationForest, fit_cut, fit_isolation_forest
from metricloom.operators.points import detect_classes, detect_outliers
from metricloom.operators.scale import SCALERS, fit_power, fit_quantile
from metricloom.sinks.writers import anomaly_records, stage_checkpoint, stage_name

_SCALERS = {**SCALERS, "QuantileTransformer": fit_quantile, "PowerTransformer": fit_power}

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class RunSpec:
    """What to do with a wide frame, and where models and stages are kept.

    ``method`` is a name or an estimator of the user's: a classifier where there is a target, and
    otherwise a detector whose model marks anomalies by -1 in ``prediction``.
    """

    root: str
    method: str | Estimator = "isolation_forest"
    export: str = "default"
    interval: str = "1h"
    time: str = "time"
    target: str | None = None
    columns: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    wildcard: str | None = None
    ld: float = 0
    gd: float = 0
    low_variance: bool = False
    fill: bool = True
    dropna: bool = False
    one_hot: bool = False
    scaler: str | None = None
    augment: list[Step] = field(default_factory=list)
    analysis: dict[str, Step] = field(default_factory=dict)
    solo: bool = False
    checkpoint: bool = False
    explain: bool = False
    options: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.method if isinstance(self.method, str) else type(self.method).__name__

    @property
    def detects(self) -> bool:
        """Whether an estimator of the user's is a detector."""
        return isinstance(self.method, Estimator) and self.target is None

    @property
    def finds_outliers(self) -> bool:
        return self.method == "isolation_forest" or self.method in DETECTORS or self.detects


def shape(df: DataFrame, spec: RunSpec, training: bool) -> DataFrame:
    """Filter and clean; columns are only inspected in training, and frozen after it."""
    if spec.columns:
        df = clean.filter_columns(df, spec.columns)
    df = clean.filter_rows(df, spec.ld, spec.gd, spec.time)
    if spec.drop:
        df = clean.drop_columns(df, spec.drop)
    if spec.low_variance and training:
        df = clean.drop_low_variance(df)
    if spec.fill:
        df = clean.fill_missing(df)
    if spec.dropna and training:
        df = clean.drop_missing_columns(df)
    if spec.wildcard:
        df = clean.filter_wildcard(df, spec.wildcard)
    if spec.one_hot:
        kept = [c for c in clean.string_columns(df) if c != spec.target]
        df = clean.one_hot(df, kept)
    return df


def _staged(df: DataFrame, spec: RunSpec, training: bool, stage: str) -> DataFrame:
    if not spec.checkpoint:
        return df
    return stage_checkpoint(df, f"{spec.root}/stages", stage_name(not training, stage))


def _features(df: DataFrame, spec: RunSpec) -> list[str]:
    return [c for c in df.columns if c not in (spec.time, spec.target)]


def _augmented(df: DataFrame, spec: RunSpec) -> DataFrame:
    for step in spec.augment:
        df = df.transform(step)
    return df


def _scaler_path(spec: RunSpec) -> str:
    return f"{spec.root}/{spec.scaler}.scaler"


def analyse(df: DataFrame, spec: RunSpec) -> dict[str, DataFrame]:
    """The tables of all analysis methods, on the frame as fetched."""
    return {name: df.transform(step) for name, step in spec.analysis.items()}


def run(df: DataFrame, spec: RunSpec) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Analyse, then train; with ``solo`` only analyse."""
    tables = analyse(df, spec)
    return tables, None if spec.solo else train(df, spec)


def train(df: DataFrame, spec: RunSpec) -> DataFrame:
    """Fit and save; gives the augmented training frame.

    The list of features is saved with the model, so detection sees the same columns.
    """
    spark = df.sparkSession
    frame = _staged(shape(df, spec, True), spec, True, "filtered")
    if spec.scaler:
        scaler = _SCALERS[spec.scaler](frame, _features(frame, spec))
        store.save_state(spark, scaler, _scaler_path(spec))
        frame = scaler.transform(frame)
    frame = _staged(_augmented(frame, spec), spec, True, "augmented")
    path = model_place(spec)
    features = _features(frame, spec)
    if spec.method == "isolation_forest":
        forest = fit_isolation_forest(frame, features, [spec.time], **spec.options)
        store.save_forest(spark, forest, path)
    elif spec.method in DETECTORS:
        store.save_state(spark, fit_cut(frame, features, spec.method, **spec.options), path)
    elif spec.detects:
        own = spec.method.copy()
        places = {"featuresCols": features, "featuresCol": features, "keyCols": [spec.time]}
        given = {own.getParam(p): v for p, v in {**places, **spec.options}.items() if own.hasParam(p)}
        store.save_model(own.fit(frame, given), path)
        _save_features(spark, features, path)
    else:
        model = fit_classifier(frame, features, spec.target, spec.method, **spec.options)
        store.save_classifier(spark, model, path)
    return frame


def _save_features(spark: SparkSession, features: list[str], path: str) -> None:
    rows = [(i, f) for i, f in enumerate(features)]
    spark.createDataFrame(rows, _FEATURES).coalesce(1).write.mode("overwrite").parquet(f"{path}-features")


_FEATURES = "place int, feature string"


def _load(spark: SparkSession, spec: RunSpec, path: str):
    """The saved model, the features it wants and how it marks rows; None where nothing was saved."""
    if spec.method == "isolation_forest":
        model = store.load_forest(spark, path)
        return model and (model.features, model.predict, model)
    if spec.method in DETECTORS:
        model = store.load_state(spark, path)
        return model and (model.features, model.predict, model)
    if spec.detects:
        model = store.load_model(spark, path)
        if model is None:
            return None
        rows = spark.read.schema(_FEATURES).parquet(f"{path}-features").orderBy("place").collect()
        return [r["feature"] for r in rows], model.transform, getattr(model, "fitted", None)
    model = store.load_classifier(spark, path)
    return model and (model.features, model.predict, model)


def _explained(judged: DataFrame, model, spec: RunSpec, normal: str) -> DataFrame:
    """The flagged rows with the values of their features."""
    key = [spec.time, "prediction"]
    if isinstance(model, IsolationForest):
        return tree_shapley(judged.where("prediction = -1"), key, of_forest(model))
    if not isinstance(model, Classifier):
        raise ValueError(f"{spec.name} is no ensemble of trees: its records cannot be explained")
    # A pass over the flagged rows of each class, for each has a score of its own.
    parts = [
        tree_shapley(judged.where(q("prediction") == c), key, of_classifier(model, c)) for c in model.classes if c != normal
    ]
    return reduce(DataFrame.unionByName, parts)


def _with_columns(df: DataFrame, names: Iterable[str], value: float | None = None) -> DataFrame:
    """The frame with every named column, the absent ones holding ``value``."""
    absent = [F.lit(value).cast("double").alias(c) for c in names if c not in df.columns]
    return df.select(*[q(c) for c in df.columns], *absent) if absent else df


def model_place(spec: RunSpec) -> str:
    return store.model_path(spec.root, spec.name, spec.export)


def load(spark: SparkSession, spec: RunSpec):
    """The saved model with its scaler, to be handed to ``detect``; None where nothing was saved."""
    loaded = _load(spark, spec, model_place(spec))
    return loaded and (*loaded, store.load_state(spark, _scaler_path(spec)) if spec.scaler else None)


def detect(df: DataFrame, spec: RunSpec, loaded=None) -> DataFrame | None:
    """Anomaly records of new rows, or None where no model was saved.

    With ``explain`` a record holds ``analysis``, the Shapley value of each feature for the mean path
    of a forest or the probability of the class found, and the ``base_value`` they are added to.
    Models need to be ensembles of trees for that. ``loaded`` is what ``load`` gives, where it is at
    hand.
    """
    outliers = spec.finds_outliers
    loaded = load(df.sparkSession, spec) if loaded is None else loaded
    if loaded is None:
        return None
    features, predict, model, scaler = loaded
    # A series that has gone missing is filled and scaled like any other gap.
    frame = shape(_with_columns(df, scaler.columns if scaler else ()), spec, False)
    frame = _augmented(scaler.transform(frame) if scaler else frame, spec)
    frame = _with_columns(frame, features, 0.0)
    judged = predict(frame.select(q(spec.time), *[q(c) for c in features]))
    keep: list[str] = []
    if spec.explain:
        judged, keep = _explained(judged, model, spec, normal="0"), ["analysis", "base_value"]
    detector = detect_outliers if outliers else detect_classes
    found = detector(judged, time=spec.time, keep=keep)
    return anomaly_records(found, spec.name, spec.export, spec.interval)

