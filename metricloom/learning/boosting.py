"""Boosting of several classes at once, stopped by the rows held out.

A round fits one regression tree per class to the Newton step of the multinomial loss: the label is
gradient over curvature and the weight the curvature, so that a leaf's weighted mean is the step
that is best for it. The trees of a round do not depend on one another and are fitted at the same
time. Margins are kept with the rows in a table written every round; no round looks back further.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.session import stored

LEAST_CURVATURE = 1e-6


def at_once(spark: SparkSession, act, items: list, threads: int) -> list:
    """``[act(x) for x in items]`` from several driver threads, so that jobs overlap; order is kept."""
    if threads <= 1 or len(items) <= 1:
        return [act(x) for x in items]
    with ThreadPool(min(threads, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(act), items)


def softmax(margins: Column) -> Column:
    """Probabilities from an array of margins; large margins do not overflow."""
    powers = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


@dataclass(frozen=True)
class Softmax:
    """A regression ensemble per class, whose sums over ``starts`` are the classes' margins."""

    models: list
    starts: list[float]

    @property
    def rounds(self) -> int:
        return self.models[0].getNumTrees if self.models else 0

    def transform(self, df: DataFrame) -> DataFrame:
        frame, names = df, [f"_margin{k}" for k in range(len(self.starts))]
        for model, name, start in zip(self.models, names, self.starts):
            frame = model.setPredictionCol(name).transform(frame).withColumn(name, F.col(name) + F.lit(start))
        margins = F.array(*[F.col(n) for n in names]) if self.models else F.array(*[F.lit(s) for s in self.starts])
        frame = frame.withColumn("_probability", softmax(margins)).drop(*names)
        best = F.array_position("_probability", F.array_max("_probability")) - 1
        return frame.withColumn("_code", best.cast("double"))


def _ensemble(spark: SparkSession, trees: list, step: float) -> GBTRegressionModel:
    """The trees of a class as one model of Spark's, so that a row is scored in one go."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    kind = jvm.org.apache.spark.ml.regression
    parts = gateway.new_array(kind.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        parts[i], weights[i] = tree._java_obj, step
    model = GBTRegressionModel(kind.GBTRegressionModel(trees[0].uid + "-sum", parts, weights))
    return model.setFeaturesCol(trees[0].getFeaturesCol())


def fit_softmax(
    train: DataFrame,
    classes: int,
    features: str = "_features",
    label: str = "_label",
    held: str | None = None,
    maxIter: int = 20,
    stepSize: float = 0.3,
    maxDepth: int = 5,
    patience: int = 3,
    seed: int = 42,
    threads: int = 4,
    **options,
) -> Softmax:
    """Boost for ``maxIter`` rounds, or until the log loss of the ``held`` rows has not fallen for
    ``patience`` rounds; the model is that of the best round. Further options go to the trees.

    Rows without a label are left out. Without held rows all rounds are taken.
    """
    spark = train.sparkSession
    rows = train.where(F.col(label).isNotNull()).select(features, label, (F.col(held) if held else F.lit(False)).alias("_held"))
    # Every tree of the first round reads the rows several times; what they are derived from is read once. Kept
    # as they are partitioned, for the trees' sample for splits follows the partitions.
    first = rows.persist(StorageLevel.DISK_ONLY)
    counts = {r[0]: r[1] for r in rows.where("NOT _held").groupBy(label).count().collect()}
    total = sum(counts.values()) or 1
    starts = [math.log((counts.get(float(k), 0) + 0.5) / (total + 0.5 * classes)) for k in range(classes)]
    rows = rows.withColumn("_margins", F.array(*[F.lit(s) for s in starts]))
    grown: list[list] = []
    losses: list[float] = []
    for number in range(maxIter):
        judged = rows.withColumn("_p", softmax(F.col("_margins")))

        def fit(k: int, judged=judged, number=number):
            p = F.col("_p")[k]
            curvature = F.greatest(p * (1 - p), F.lit(LEAST_CURVATURE))
            gradient = (F.col(label) == k).cast("double") - p
            posed = judged.where("NOT _held").select(features, (gradient / curvature).alias("_step"), curvature.alias("_weight"))
            tree = DecisionTreeRegressor(
                featuresCol=features, labelCol="_step", weightCol="_weight", maxDepth=maxDepth, seed=seed + number, **options
            )
            return tree.fit(posed).setPredictionCol(f"_tree{k}")

        trees = at_once(spark, fit, list(range(classes)), threads)
        grown.append(trees)
        last = number == maxIter - 1
        if last and not held:
            break
        # After the last round only the loss of the held rows is wanted.
        rows = rows.where("_held") if last else rows
        for tree in trees:
            rows = tree.transform(rows)
        sums = F.array(*[F.col("_margins")[k] + F.lit(stepSize) * F.col(f"_tree{k}") for k in range(classes)])
        rows = rows.select(features, label, "_held", sums.alias("_margins"))
        rows = rows if last else stored(rows, "boosting")
        if not number and not last:
            first.unpersist()
        if held:
            chance = F.greatest(F.element_at(softmax(F.col("_margins")), F.col(label).cast("int") + 1), F.lit(1e-15))
            loss = rows.where("_held").agg(F.avg(-F.log(chance))).first()[0]
            losses.append(math.inf if loss is None else loss)
            best = losses.index(min(losses))
            if loss is not None and len(losses) - 1 - best >= patience:
                break
    first.unpersist()
    if held and losses and min(losses) < math.inf:
        grown = grown[: losses.index(min(losses)) + 1]
    if not grown:
        return Softmax([], starts)
    return Softmax([_ensemble(spark, [g[k] for g in grown], stepSize) for k in range(classes)], starts)
