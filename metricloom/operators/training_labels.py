"""Labels for supervised training, found without supervision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators.neighbours import dbscan
from metricloom.operators.outliers import IsolationForest, fit_isolation_forest
from metricloom.operators.scale import fit_standard
from metricloom.session import cut_lineage


def generate_training_labels(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    eps: float = 0.5,
    min_samples: int = 5,
    contamination: float = 0.1,
    n_estimators: int = 100,
    only_anomalies: bool = False,
    target: str = "target",
    seed: int = 42,
    max_samples: int | float | str = "auto",
) -> DataFrame:
    """Anomalies of a forest, clustered by density; the cluster is the class.

    With ``only_anomalies`` noise is dropped and the other anomalies are returned.
    Otherwise noise is a class of its own above all clusters, classes start at 1 and
    ordinary rows are 0.
    """
    forest = fit_isolation_forest(
        df, features, [key], n_estimators, max_samples, contamination, seed=seed
    )
    flagged = forest.predict(df)
    anomalies = cut_lineage(
        flagged.where("prediction = -1").select(q(key), *[q(c) for c in features])
    )
    scaled = fit_standard(anomalies, features).transform(anomalies)
    clusters = dbscan(scaled, features, key, eps, min_samples, label="_cluster")
    clusters = cut_lineage(clusters.select(q(key).alias("_id"), "_cluster"))
    joined = df.join(clusters, q(key) == F.col("_id"), "left").drop("_id")
    if only_anomalies:
        kept = joined.where(F.col("_cluster") >= 0)
        return kept.withColumn(target, F.col("_cluster")).drop("_cluster")
    top = clusters.agg(F.max("_cluster")).first()[0]
    noise = (top if top is not None else -1) + 1
    label = F.when(F.col("_cluster") == -1, noise + 1).otherwise(F.col("_cluster") + 1)
    return joined.withColumn(target, F.coalesce(label, F.lit(0))).drop("_cluster")


def append_predictions(df: DataFrame, model: IsolationForest, path: str) -> DataFrame:
    """Write the training frame with its ``ano`` label, and read it back."""
    model.predict(df, "ano").drop("score").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
