"""Classifiers on feature frames."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.learning.boosting import Softmax, fit_softmax
from metricloom.session import cut_lineage

_VECTOR, _LABEL = "_features", "_label"


@dataclass(frozen=True)
class Boosted:
    """A weighted vote of trees (multi-class AdaBoost)."""

    trees: list
    weights: list[float]
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        frame = df
        for i, tree in enumerate(self.trees):
            frame = tree.transform(frame).withColumnRenamed("prediction", f"_vote{i}")
            frame = frame.drop("rawPrediction", "probability")
        total = sum(self.weights) or 1.0
        marks = [
            sum(
                (F.when(F.col(f"_vote{i}") == k, w / total).otherwise(-w / total / (self.classes - 1))
                 for i, w in enumerate(self.weights)),
                F.lit(0.0),
            )
            for k in range(self.classes)
        ]
        powers = F.transform(F.array(*marks), lambda m: F.exp(m / (self.classes - 1)))
        frame = frame.withColumn("_powers", powers)
        mass = F.aggregate("_powers", F.lit(0.0), lambda a, x: a + x)
        frame = frame.withColumn("_probability", F.transform("_powers", lambda p: p / mass))
        best = F.array_position("_probability", F.array_max("_probability")) - 1
        votes = [f"_vote{i}" for i in range(len(self.trees))]
        return frame.withColumn("_code", best.cast("double")).drop("_powers", *votes)


def fit_adaboost(
    train: DataFrame,
    classes: int,
    n_estimators: int = 10,
    learning_rate: float = 1.0,
    max_depth: int = 1,
    seed: int = 42,
) -> Boosted:
    """SAMME boosting; the row weights are cut from their lineage every round but the last.

    What several passes read is kept on disk for as long, partitioned as it is.
    """
    weighted = first = train.withColumn("_weight", F.lit(1.0)).persist(StorageLevel.DISK_ONLY)
    trees, weights = [], []
    for i in range(n_estimators):
        tree = DecisionTreeClassifier(
            featuresCol=_VECTOR, labelCol=_LABEL, weightCol="_weight", maxDepth=max_depth,
            seed=seed + i,
        ).fit(weighted)
        judged = tree.transform(weighted).withColumn(
            "_miss", (F.col("prediction") != F.col(_LABEL)).cast("double")
        ).select(_VECTOR, _LABEL, "_weight", "_miss")
        if i < n_estimators - 1:
            judged = judged.persist(StorageLevel.DISK_ONLY)
        count, total, missed = judged.agg(
            F.count(F.lit(1)), F.sum("_weight"), F.sum(F.col("_weight") * F.col("_miss"))
        ).first()
        error = missed / total
        if error >= 1 - 1 / classes:
            break
        say = learning_rate * (math.log((1 - error) / max(error, 1e-16)) + math.log(classes - 1))
        trees.append(tree)
        weights.append(say)
        if error <= 0 or i == n_estimators - 1:
            break
        # Rescaled by the mean weight, so that weights neither vanish nor overflow.
        grown = F.col("_weight") * F.exp(F.lit(say) * F.col("_miss")) / F.lit(total / count)
        weighted = cut_lineage(judged.select(_VECTOR, _LABEL, grown.alias("_weight")))
        for kept in (judged, first):
            kept.unpersist()
    for kept in (judged, first):
        kept.unpersist()
    if not trees:
        trees, weights = [tree], [1.0]
    return Boosted(trees, weights, classes)


def make_estimator(name: str, features: int, classes: int, **options) -> Estimator:
    """A Spark ML classifier by short name; options are its own parameters."""
    common = {"featuresCol": _VECTOR, "labelCol": _LABEL}
    if name == "random_forest":
        return RandomForestClassifier(**{"seed": 42, **common, **options})
    if name == "decision_tree":
        return DecisionTreeClassifier(**{"seed": 42, **common, **options})
    if name == "gbt":
        return GBTClassifier(**{"seed": 42, **common, **options})
    if name == "mlp":
        hidden = list(options.pop("hidden", (50, 20)))
        layers = [features, *hidden, classes]
        return MultilayerPerceptronClassifier(**{"seed": 42, **common, **options, "layers": layers})
    raise ValueError(f"unknown classifier {name}")


def fit_own(estimator: Estimator, train: DataFrame, **options) -> object:
    """Fit a copy of a user's classifier, told where features and labels are; it stays as it was."""
    own = estimator.copy()
    columns = {"featuresCol": _VECTOR, "labelCol": _LABEL, "predictionCol": "prediction"}
    given = {p: v for p, v in columns.items() if own.hasParam(p)}
    unknown = [p for p in options if not own.hasParam(p)]
    if unknown:
        raise ValueError(f"{type(own).__name__} has no parameter {unknown}")
    return own.fit(train, {own.getParam(p): v for p, v in {**given, **options}.items()})


@dataclass
class Classifier:
    """A fitted classifier with its classes in alphabetical order."""

    name: str
    features: list[str]
    classes: list[str]
    assembler: VectorAssembler
    model: object

    def codes(self, df: DataFrame, target: str) -> DataFrame:
        """The model's own columns with the true class as ``label``, as evaluators read them.

        Rows of a class that the model does not know are left out.
        """
        _, rows = labelled_vectors(df, self.features, target, self.classes)
        rows = rows.withColumnRenamed(_LABEL, "label").where(F.col("label") >= 0).select(_VECTOR, "label")
        out = self.model.transform(rows)
        if isinstance(self.model, (Boosted, Softmax)):
            return out.withColumn("prediction", F.col("_code")).withColumn("probability", array_to_vector("_probability"))
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Predicted class, and the class probabilities ``prob`` where the model has them."""
        out = self.model.transform(self.assembler.transform(df))
        if isinstance(self.model, (Boosted, Softmax)):
            out = out.withColumnRenamed("_probability", "prob")
            code = F.col("_code")
        else:
            code = F.col("prediction")
            if "probability" in out.columns:
                out = out.withColumn("prob", vector_to_array("probability"))
        labels = F.array(*[F.lit(c) for c in self.classes])
        out = out.withColumn("_class", F.element_at(labels, code.cast("int") + 1))
        kept = [q(c) for c in df.columns if c != name]
        probs = [F.col("prob")] if "prob" in out.columns else []
        return out.select(*kept, F.col("_class").alias(name), *probs)

    def append(self, df: DataFrame) -> DataFrame:
        """Rows with ``pred`` and one probability column per class."""
        out = self.predict(df, "pred")
        if "prob" not in out.columns:
            return out
        cells = [F.col("prob")[i].alias(f"prob_{i}") for i in range(len(self.classes))]
        return out.select(*[q(c) for c in out.columns if c != "prob"], *cells)

    def importance(self) -> list[tuple[str, float]]:
        """(feature, importance), for models that know it."""
        if isinstance(self.model, Boosted):
            total = sum(self.model.weights)
            parts = [
                [w / total * v for v in t.featureImportances.toArray()]
                for t, w in zip(self.model.trees, self.model.weights)
            ]
            values = [sum(p) for p in zip(*parts)]
        elif hasattr(self.model, "models"):
            parts = [m.featureImportances.toArray() for m in self.model.models]
            values = [float(sum(p)) / len(parts) for p in zip(*parts)]
        else:
            values = self.model.featureImportances.toArray()
        return [(f, float(v)) for f, v in zip(self.features, values)]


def class_list(df: DataFrame, target: str) -> list[str]:
    """The classes of a target; a model has a probability for each, so they are few."""
    found = df.select(q(target).cast("string")).where(q(target).isNotNull()).distinct()
    return sorted(r[0] for r in found.collect())


def labelled_vectors(
    df: DataFrame, features: Sequence[str], target: str, classes: Sequence[str]
) -> tuple[VectorAssembler, DataFrame]:
    assembler = VectorAssembler(inputCols=list(features), outputCol=_VECTOR)
    codes = F.array(*[F.lit(c) for c in classes])
    label = (F.array_position(codes, q(target).cast("string")) - 1).cast("double")
    # All classes are named, so that a model knows those absent from its rows, however many.
    named = {"ml_attr": {"type": "nominal", "name": _LABEL, "vals": list(classes)}}
    return assembler, assembler.transform(df).withColumn(_LABEL, label).withMetadata(_LABEL, named)


def fit_classifier(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    name: str | Estimator = "random_forest",
    classes: Sequence[str] | None = None,
    validation: str | None = None,
    **options,
) -> Classifier:
    """Fit by name, or any Spark ML classifier by object; ``options`` are then its parameters.

    ``validation`` is a 0/1 column that lets boosted trees stop early. Boosting of more than two
    classes is multinomial and has their probabilities.
    """
    features = list(features)
    classes = list(classes) if classes is not None else class_list(df, target)
    assembler, train = labelled_vectors(df, features, target, classes)
    keep = [_VECTOR, _LABEL]
    if validation is not None:
        train = train.withColumn("_held", q(validation) == 1)
        options["validationIndicatorCol"] = "_held"
        keep.append("_held")
    train = train.select(*keep)
    if name == "adaboost":
        model: object = fit_adaboost(train, len(classes), **options)
    elif name == "gbt" and len(classes) > 2:
        held = options.pop("validationIndicatorCol", None)
        model = fit_softmax(train, len(classes), _VECTOR, _LABEL, held, **options)
    elif isinstance(name, Estimator):
        model = fit_own(name, train, **options)
        name = type(name).__name__
    else:
        model = make_estimator(name, len(features), len(classes), **options).fit(train)
    return Classifier(name, features, classes, assembler, model)
