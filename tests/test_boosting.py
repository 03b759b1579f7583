"""Multinomial boosting: probabilities, the round chosen by the rows held out, storing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.learning import selection, store
from metricloom.learning.boosting import at_once
from metricloom.learning.supervised import fit_classifier
from metricloom.session import scratch_path

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 2))
    kind = np.select([x[:, 0] > 0.4, x[:, 1] > 0], ["cpu", "mem"], "0")
    noisy = rng.random(900) < 0.3
    kind[noisy] = rng.choice(["cpu", "mem", "0"], noisy.sum())
    frame = pd.DataFrame({"id": range(900), "a": x[:, 0], "b": x[:, 1], "target": kind})
    return spark.createDataFrame(frame).withColumn("held", (F.col("id") % 3 == 0).cast("int")).repartition(3).cache()


def loss_of(model, rows):
    part = model.append(rows.where("held = 1"))
    chance = F.element_at(F.array(*[F.col(f"prob_{i}") for i in range(3)]), F.array_position(F.array(*[F.lit(c) for c in model.classes]), F.col("target")).cast("int"))
    return part.agg(F.avg(-F.log(chance))).first()[0]


def test_round_is_chosen_by_the_held_rows(spark, rows):
    stopped = fit_classifier(rows, NAMES, "target", "gbt", validation="held", maxIter=12, maxDepth=4, stepSize=0.5, patience=2)
    rounds = stopped.model.rounds
    assert 1 <= rounds < 12
    losses = [
        loss_of(fit_classifier(rows.where("held = 0"), NAMES, "target", "gbt", classes=stopped.classes, maxIter=n, maxDepth=4, stepSize=0.5), rows)
        for n in (max(1, rounds - 1), rounds, rounds + 2)
    ]
    assert loss_of(stopped, rows) == pytest.approx(losses[1]) == min(losses)
    judged = stopped.append(rows)
    assert judged.where(F.abs(F.col("prob_0") + F.col("prob_1") + F.col("prob_2") - 1) > 1e-9).count() == 0
    assert judged.where("pred = target").count() > 0.65 * 900
    assert {f for f, v in stopped.importance() if v > 0.1} == {"a", "b"}
    path = scratch_path(spark, "boosted")
    store.save_classifier(spark, stopped, path)
    assert store.load_classifier(spark, path).append(rows).exceptAll(judged).count() == 0


def test_absent_classes_and_no_rounds(rows):
    some = rows.where("target <> 'mem'")
    model = fit_classifier(some, NAMES, "target", "gbt", classes=["0", "cpu", "mem"], maxIter=2, maxDepth=2)
    assert model.append(rows).where("prob_2 > 0.05 or prob_2 <= 0").count() == 0
    none = fit_classifier(rows, NAMES, "target", "gbt", maxIter=0)
    assert none.append(rows).select("prob_0").distinct().count() == 1


def test_scores_are_the_same_at_any_parallelism(rows):
    splits = selection.fold_pairs(selection.stratified_folds(rows, "target", ["id"], 3), 3)
    tables = []
    for threads in (1, 3):
        found, _ = selection.cross_validate(splits, NAMES, "target", "decision_tree", {"maxDepth": 3}, threads=threads)
        tables.append([{k: v for k, v in r.items() if not k.endswith("_time")} for r in found])
    assert tables[0] == tables[1] and [r["fold"] for r in tables[0]] == [0, 1, 2]


def test_order_is_kept_and_errors_come_through(spark):
    assert at_once(spark, lambda x: spark.range(x).count(), [5, 1, 3], 3) == [5, 1, 3]
    with pytest.raises(ZeroDivisionError):
        at_once(spark, lambda x: 1 // x, [1, 0], 2)


def test_rows_are_not_written_after_the_last_round(rows, monkeypatch):
    from metricloom.learning import boosting, supervised

    calls = []
    for module, name in ((boosting, "stored"), (supervised, "cut_lineage")):
        act = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, act=act, name=name: calls.append(name) or act(*a))
    fit_classifier(rows, NAMES, "target", "gbt", validation="held", maxIter=2, maxDepth=1)
    fit_classifier(rows, NAMES, "target", "adaboost", n_estimators=2)
    assert calls == ["stored", "cut_lineage"]
