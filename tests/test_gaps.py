"""Gaps in the data: missing order keys, classes, series and values, and many classes."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.learning import evaluate, supervised
from metricloom.operators import buckets, clean, joins, outliers, ranking
from metricloom.plans import runs


def test_null_order_keys_come_first(spark):
    left = spark.createDataFrame([(None, "a"), (1.0, "b"), (2.0, "c")], "k double, x string")
    numbers = {r.x: r.row_number for r in ranking.row_numbers(left, ["k"]).collect()}
    assert numbers == {"a": 1, "b": 2, "c": 3}
    right = left.select(q("k"), F.upper("x").alias("y"))
    joined = joins.join_positional(left, right, ["k"], ["k"])
    assert sorted((r.x, r.y) for r in joined.select("x", "y").collect()) == [("a", "A"), ("b", "B"), ("c", "C")]


def test_curves_leave_rows_without_score_out(spark):
    frame = spark.createDataFrame([(0.9, 1), (0.4, 0), (0.3, 1), (None, 1), (None, 0)], "s double, y int")
    got = evaluate.pr_curve(frame, F.col("y") == 1, "s").orderBy("threshold").collect()
    assert [(r.threshold, r.recall) for r in got] == [(0.3, 1.0), (0.4, 0.5), (0.9, 0.5)]
    assert [r.tpr for r in evaluate.roc_curve(frame, F.col("y") == 1, "s").orderBy("threshold").collect()] == [1.0, 0.5, 0.5]


def test_bounds_inside_buckets(spark):
    frame = spark.createDataFrame([(5.0,), (10.0,), (30.0,), (55.0,), (56.0,)], "time double")
    got = {r.key: r.doc_count for r in buckets.bucket_count_filled(frame, 20, 10, 55).collect()}
    assert got == {0: 1, 20: 1, 40: 1}


def test_forest_uses_columns_with_gaps_and_fills_small_samples(spark):
    random = np.random.default_rng(1)
    frame = pd.DataFrame({"id": np.arange(4000), "a": random.normal(size=4000), "b": 1.0})
    frame.loc[17, "a"] = np.nan
    rows = spark.createDataFrame(frame)
    for trees, size in ((10, 10), (200, 5)):
        forest = outliers.fit_isolation_forest(rows, ["a", "b"], ["id"], trees, max_samples=size)
        assert len(forest.trees) == trees
        dealt = outliers._deal_rows(rows, ["id"], trees, size, 4000, 42).groupBy("_tree").count().collect()
        assert len(dealt) == trees and all(r["count"] == size for r in dealt)
    assert any(f == 0 and low != high for t in forest.trees for f, low, high in zip(t["feature"], t["low"], t["high"]))


def test_classes_that_training_lacks_and_many_classes(spark):
    frame = pd.DataFrame({"x": np.arange(3000.0), "y": [f"c{i % 150:03d}" for i in range(3000)]})
    rows = spark.createDataFrame(frame)
    model = supervised.fit_classifier(rows, ["x"], "y", "decision_tree", maxDepth=2)
    assert len(model.append(rows.limit(1)).columns) == 3 + 150
    few = rows.where("y < 'c002'")
    model = supervised.fit_classifier(few, ["x"], "y", "decision_tree", classes=["c000", "c001", "c002"])
    assert model.append(rows.limit(2)).where("prob_2 = 0").count() == 2


def test_many_values_become_columns(spark):
    rows = spark.createDataFrame(pd.DataFrame({"t": [f"v{i:04d}" for i in range(2500)]}).assign(u="one"))
    wide = clean.one_hot(rows)
    assert len(wide.columns) == 2501 and wide.columns[0] == "t=v0000"


def test_detection_fills_a_lost_series_before_scaling(spark, tmp_path):
    random = np.random.default_rng(4)
    frame = pd.DataFrame({"time": np.arange(600), "a": random.normal(50, 1, 600), "b": random.normal(20, 1, 600)})
    spec = runs.RunSpec(root=str(tmp_path), scaler="StandardScaler", options={"n_estimators": 20, "contamination": 0.01})
    rows = spark.createDataFrame(frame)
    runs.train(rows, spec)
    assert runs.detect(rows, spec).count() <= 10
    # a filled 0 lies 50 deviations off, so most rows stand out now
    assert runs.detect(rows.drop("a"), spec).count() > 300
