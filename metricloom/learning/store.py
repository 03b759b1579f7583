"""Saved models, found by method and export name."""

from __future__ import annotations

import json
from dataclasses import fields, is_dataclass

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from metricloom.learning.boosting import Softmax
from metricloom.learning.supervised import Boosted, Classifier
from metricloom.operators.outliers import ClusterScore, CutScore, HistogramScore, IsolationForest, ReconstructionScore
from metricloom.operators.scale import AffineScaler, PowerScaler, Projection, QuantileScaler

_META = "name string, features array<string>, classes array<string>, weights array<double>, kind string"


def model_path(root: str, method: str, export: str) -> str:
    return f"{root}/{method}_{export}"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def changed_at(spark: SparkSession, path: str) -> int | None:
    """When a saved model was last written, in milliseconds; None where there is none."""
    if not _exists(spark, path):
        return None
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # A model is a folder of folders; each is written anew when it is saved again.
    return max(s.getModificationTime() for s in [system.getFileStatus(folder), *system.listStatus(folder)])


def save_classifier(spark: SparkSession, model: Classifier, path: str) -> None:
    weights, parts, kind = [], [model.model], "one"
    if isinstance(model.model, Boosted):
        weights, parts, kind = model.model.weights, model.model.trees, "votes"
    elif isinstance(model.model, Softmax):
        weights, parts, kind = model.model.starts, model.model.models, "softmax"
    meta = [(model.name, model.features, model.classes, weights, kind)]
    spark.createDataFrame(meta, _META).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    for i, part in enumerate(parts):
        part.write().overwrite().save(f"{path}/part{i}")


def load_classifier(spark: SparkSession, path: str) -> Classifier | None:
    """The saved classifier, or None where there is none."""
    if not _exists(spark, path):
        return None
    meta = spark.read.schema(_META).parquet(f"{path}/meta").first()
    count = max(1, len(meta["weights"]))
    # Boosting without a single round has margins and no trees.
    places = [f"{path}/part{i}" for i in range(count) if _exists(spark, f"{path}/part{i}")]
    parts = [DefaultParamsReader.loadParamsInstance(p, spark) for p in places]
    if meta["kind"] == "softmax":
        model: object = Softmax(parts, list(meta["weights"]))
    elif meta["weights"]:
        model = Boosted(parts, list(meta["weights"]), len(meta["classes"]))
    else:
        model = parts[0]
    assembler = VectorAssembler(inputCols=list(meta["features"]), outputCol="_features")
    return Classifier(meta["name"], list(meta["features"]), list(meta["classes"]), assembler, model)


def save_forest(spark: SparkSession, forest: IsolationForest, path: str) -> None:
    rows = [
        (t["tree"], t["feature"], t["threshold"], t["low"], t["high"], t["path"], t.get("cover"),
         forest.features, forest.sample_size, forest.offset)
        for t in forest.trees
    ]
    spark.createDataFrame(rows, _FOREST).coalesce(1).write.mode("overwrite").parquet(path)


_FOREST = (
    "tree int, feature array<int>, threshold array<double>, low array<int>, high array<int>, "
    "path array<double>, cover array<int>, features array<string>, sample_size int, offset double"
)


def load_forest(spark: SparkSession, path: str) -> IsolationForest | None:
    """Trees hold a bounded sample each, so a forest fits the driver."""
    if not _exists(spark, path):
        return None
    rows = spark.read.schema(_FOREST).parquet(path).orderBy(F.col("tree")).collect()
    trees = [{k: r[k] for k in ("tree", "feature", "threshold", "low", "high", "path", "cover")} for r in rows]
    return IsolationForest(list(rows[0]["features"]), trees, rows[0]["sample_size"], rows[0]["offset"])


_HISTOGRAMS = "place int, feature string, low double, width double, bins array<double>, tol double, cut double"


def save_histograms(spark: SparkSession, model: HistogramScore, cut: float, path: str) -> None:
    """Histogram scores with the cut above which a row is an anomaly."""
    rows = [(i, f, *parts, model.tol, cut) for i, (f, parts) in enumerate(model.bins.items())]
    spark.createDataFrame(rows, _HISTOGRAMS).coalesce(1).write.mode("overwrite").parquet(path)


def load_histograms(spark: SparkSession, path: str) -> tuple[HistogramScore, float] | None:
    if not _exists(spark, path):
        return None
    rows = spark.read.schema(_HISTOGRAMS).parquet(path).orderBy("place").collect()
    bins = {r["feature"]: (r["low"], r["width"], list(r["bins"])) for r in rows}
    return HistogramScore(bins, rows[0]["tol"]), rows[0]["cut"]


# What is saved as its fields: bounded parameter sets, whatever the rows they were fitted to.
STATES = {
    c.__name__: c for c in (
        AffineScaler, QuantileScaler, PowerScaler, Projection, HistogramScore, ClusterScore, ReconstructionScore, CutScore,
    )
}


def _plain(value):
    if is_dataclass(value):
        return {"kind": type(value).__name__, "fields": {f.name: _plain(getattr(value, f.name)) for f in fields(value)}}
    if isinstance(value, dict):
        return {"entries": [[k, _plain(v)] for k, v in value.items()]}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def _built(value):
    if isinstance(value, dict) and "kind" in value:
        return STATES[value["kind"]](**{k: _built(v) for k, v in value["fields"].items()})
    if isinstance(value, dict):
        return {k: _built(v) for k, v in value["entries"]}
    return [_built(v) for v in value] if isinstance(value, list) else value


def save_state(spark: SparkSession, fitted, path: str) -> None:
    """A fitted scaler, projection or detector as one line of JSON."""
    if type(fitted).__name__ not in STATES:
        raise ValueError(f"{type(fitted).__name__} is not saved by its fields")
    spark.createDataFrame([(json.dumps(_plain(fitted)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str):
    """What ``save_state`` has saved; None where there is none."""
    return _built(json.loads(spark.read.text(path).first()[0])) if _exists(spark, path) else None


def save_model(model: Model, path: str) -> None:
    """Any fitted Spark ML model, a user's own or ours."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> Model | None:
    """The saved model, by the class that wrote it; None where there is none."""
    return DefaultParamsReader.loadParamsInstance(path, spark) if _exists(spark, path) else None
