"""Estimators and evaluators of a user's own, and ours as Spark ML objects."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from metricloom.learning import estimators as es
from metricloom.learning import selection, store
from metricloom.learning.supervised import fit_classifier
from metricloom.plans import runs
from metricloom.session import scratch_path

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 3))
    x[:12] += 8
    frame = pd.DataFrame({"time": range(600), **{n: x[:, i] for i, n in enumerate(NAMES)}})
    frame["target"] = np.where(x[:, 0] + x[:, 1] > 0.3, "cpu", "ok")
    return spark.createDataFrame(frame).repartition(3).cache()


class Misses(Evaluator):
    """A user's scorer: how many rows are wrong; fewer are better."""

    def _evaluate(self, dataset):
        return dataset.where(F.col("label") != F.col("prediction")).count()

    def isLargerBetter(self):
        return False


DETECTORS = [
    es.IsolationForestDetector(featuresCols=NAMES, keyCols=["time"], contamination=0.02, numTrees=30),
    es.HistogramDetector(featuresCols=NAMES, contamination=0.02),
]


@pytest.mark.parametrize("detector", DETECTORS, ids=lambda d: type(d).__name__)
def test_detectors_find_planted_rows_and_are_the_same_when_loaded(spark, rows, detector):
    path = scratch_path(spark, "model")
    model = detector.fit(rows)
    found = {r.time for r in model.transform(rows).where("prediction = -1").collect()}
    assert found and len(found) <= 13 and len(found & set(range(12))) >= 0.9 * len(found)
    model.write().overwrite().save(path)
    again = store.load_model(spark, path)
    assert type(again) is type(model) and again.getOrDefault("featuresCols") == NAMES
    assert {r.time for r in again.transform(rows).where("prediction = -1").collect()} == found
    detector.write().overwrite().save(f"{path}-estimator")
    copy = type(detector).load(f"{path}-estimator")
    assert copy.extractParamMap().values().__len__() == detector.extractParamMap().values().__len__()
    renamed = detector.copy({detector.predictionCol: "odd"})
    assert "odd" in renamed.fit(rows).transform(rows).columns and detector.getOrDefault("predictionCol") == "prediction"


def test_detectors_stand_in_pipelines(spark, rows):
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=[DETECTORS[0]]).fit(rows).write().overwrite().save(path)
    assert "prediction" in PipelineModel.load(path).transform(rows).columns


def splits(rows):
    return selection.fold_pairs(selection.stratified_folds(rows, "target", ["time"], 2), 2)


def test_own_estimator_and_scorers_in_cross_validation(spark, rows):
    scorers = {
        "misses": Misses(), "loss": MulticlassClassificationEvaluator(metricName="logLoss"),
        "area": BinaryClassificationEvaluator(), "f1": es.LabelEvaluator(metricName="f1_weighted"),
    }
    own = LogisticRegression(maxIter=20)
    found, models = selection.cross_validate(
        splits(rows), NAMES, "target", own, scaler="StandardScaler", train_scores=True, scorers=scorers
    )
    plain, _ = selection.cross_validate(splits(rows), NAMES, "target", own, scaler="StandardScaler")
    for row, other in zip(found, plain):
        assert row["test_f1"] == pytest.approx(other["test_f1_weighted"]) and row["test_f1"] > 0.85
        assert row["test_misses"] == pytest.approx((1 - other["test_accuracy"]) * 300, abs=0.05)
        assert 0 < row["test_loss"] < 0.5 and row["train_area"] > 0.9
    assert own.getFeaturesCol() == "features" and models[0].name == "LogisticRegression"
    path = scratch_path(spark, "classifier")
    store.save_classifier(spark, models[0], path)
    again = store.load_classifier(spark, path)
    assert again.predict(rows).exceptAll(models[0].predict(rows)).count() == 0


def test_search_follows_the_scorer_s_direction(rows):
    search = selection.Search(
        splits(rows), NAMES, "target", LogisticRegression(maxIter=10), refit="misses", scorers={"misses": Misses()}
    )
    table = selection.hpo_grid(search, {"regParam": [0.0, 500.0]})
    assert search.best() == {"regParam": 0.0} and table[0]["misses"] < table[1]["misses"]
    with pytest.raises(ValueError, match="no parameter"):
        fit_classifier(rows, NAMES, "target", LogisticRegression(), depth=3)


def test_built_in_boosting_can_be_judged_by_evaluators(rows):
    found, _ = selection.cross_validate(
        splits(rows), NAMES, "target", "adaboost", {"n_estimators": 3},
        scorers={"loss": MulticlassClassificationEvaluator(metricName="logLoss")},
    )
    assert all(0 < r["test_loss"] < 1 for r in found)


@pytest.mark.parametrize("detector", DETECTORS, ids=lambda d: type(d).__name__)
def test_runs_with_an_own_detector(spark, rows, detector):
    spec = runs.RunSpec(scratch_path(spark, "run"), method=type(detector)(contamination=0.02), scaler="StandardScaler")
    assert runs.detect(rows.drop("target"), spec) is None
    runs.train(rows.drop("target"), spec)
    found = runs.detect(rows.drop("target"), spec)
    assert 1 <= found.count() <= 13 and found.where(F.col("method") != type(detector).__name__).count() == 0


def test_runs_with_an_own_classifier(spark, rows):
    spec = runs.RunSpec(scratch_path(spark, "run"), method=NaiveBayes(modelType="gaussian"), target="target")
    runs.train(rows, spec)
    found = runs.detect(rows.drop("target"), spec)
    assert found.count() == 600
