"""Exact tree values against all coalitions, and what the models themselves say."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.learning import store, tree_shapley as ts
from metricloom.learning.supervised import fit_classifier
from metricloom.operators.outliers import fit_isolation_forest
from metricloom.plans import runs
from metricloom.session import scratch_path

NAMES = list("abcde")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 5))
    x[:6] += 6
    frame = pd.DataFrame({"time": range(500), **{n: x[:, i] for i, n in enumerate(NAMES)}})
    frame["target"] = np.select([x[:, 0] + x[:, 1] * x[:, 2] > 0.8, x[:, 3] > 0.5], ["cpu", "mem"], "0")
    return spark.createDataFrame(frame).repartition(3).cache()


def coalition_value(tree, node, x, inside):
    """What a tree expects when only the features ``inside`` are known."""
    low, high = tree["low"][node], tree["high"][node]
    if low == node:
        return tree["value"][node]
    if tree["feature"][node] in inside:
        return coalition_value(tree, low if x[tree["feature"][node]] <= tree["threshold"][node] else high, x, inside)
    parts = [(tree["cover"][c] / tree["cover"][node], c) for c in (low, high)]
    return sum(w * coalition_value(tree, c, x, inside) for w, c in parts)


def brute(trees, x):
    k = len(x)
    phi = np.zeros(k)
    worth = {s: sum(coalition_value(t, 0, x, s) for t in trees) for n in range(k + 1) for s in itertools.combinations(range(k), n)}
    for i in range(k):
        for s in worth:
            if i not in s:
                weight = math.factorial(len(s)) * math.factorial(k - len(s) - 1) / math.factorial(k)
                phi[i] += weight * (worth[tuple(sorted((*s, i)))] - worth[s])
    return phi, worth[()]


def random_tree(rng, features, depth):
    tree = {k: [] for k in ("feature", "threshold", "low", "high", "cover", "value")}

    def add(level, cover):
        at = len(tree["low"])
        for name, value in zip(tree, (0, 0.0, at, at, cover, float(rng.normal()))):
            tree[name].append(value)
        if level < depth and cover > 1 and rng.random() < 0.9:
            tree["feature"][at], tree["threshold"][at] = int(rng.integers(features)), float(rng.normal())
            left = int(rng.integers(1, cover))
            tree["low"][at] = add(level + 1, left)
            tree["high"][at] = add(level + 1, cover - left)
        return at

    add(0, 200)
    return tree


@pytest.mark.parametrize("seed", range(6))
def test_equal_to_all_coalitions(seed):
    rng = np.random.default_rng(seed)
    trees = [random_tree(rng, 5, 6) for _ in range(4)]
    ensemble = ts.Ensemble(NAMES, [leaf for t in trees for leaf in ts.leaves_of(*(t[k] for k in ("feature", "threshold", "low", "high", "cover", "value")))])
    x = rng.normal(size=(30, 5))
    x[3, 2] = np.nan
    phi, score = ensemble.explain(x)
    for row, values, total in zip(x, phi, score):
        want, base = brute(trees, row)
        assert np.allclose(values, want) and base == pytest.approx(ensemble.base)
        assert total == pytest.approx(base + want.sum())


def test_leaves_are_added_up_by_cells(monkeypatch):
    rng = np.random.default_rng(3)
    trees = [random_tree(rng, 5, 8) for _ in range(5)]
    leaves = [leaf for t in trees for leaf in ts.leaves_of(*(t[k] for k in ("feature", "threshold", "low", "high", "cover", "value")))]
    x = rng.normal(size=(5000, 5))
    x[::7, 1], x[::11, 2], x[::13, 3] = np.nan, np.inf, -np.inf
    ensemble = ts.Ensemble(NAMES, leaves)
    phi, score = ensemble.explain(x)
    # Far fewer look-ups than leaves, and every row, the lowest too, falls into a leaf of each tree.
    assert 3 * len(ensemble.laid_out[1]) < len(leaves) and not ensemble.laid_out[2]
    assert np.allclose(score, [sum(coalition_value(t, 0, row, range(5)) for t in trees) for row in x])
    assert np.allclose(ensemble.base + phi.sum(axis=1), score)
    for cells in (0, 60):
        monkeypatch.setattr(ts, "GROUP_CELLS", cells)
        other = ts.Ensemble(NAMES, leaves)
        known = x[:, 3] > -np.inf
        assert np.allclose(other.explain(x[known])[0], phi[known]) and other.laid_out[2]


def test_a_lone_leaf_and_no_rows():
    lone = ts.Ensemble(NAMES, ts.leaves_of([0], [0.0], [0], [0], [7], [2.5]))
    phi, score = lone.explain(np.zeros((3, 5)))
    assert lone.base == 2.5 and (phi == 0).all() and (score == 2.5).all()
    assert lone.explain(np.zeros((0, 5)))[0].shape == (0, 5)


def test_forest_values_add_up_before_and_after_saving(spark, rows):
    forest = fit_isolation_forest(rows, NAMES, ["time"], 20)
    path = scratch_path(spark, "forest")
    store.save_forest(spark, forest, path)
    gaps = rows.withColumn("b", F.when(F.col("time") % 9 > 0, F.col("b")))  # missing values too
    plain = ts.tree_shapley(gaps, ["time"], ts.of_forest(forest)).orderBy("time").collect()
    again = ts.tree_shapley(gaps, ["time"], ts.of_forest(store.load_forest(spark, path))).orderBy("time").collect()
    assert [r.analysis for r in plain] == [r.analysis for r in again] and len(plain) == 500
    said = {r.time: r.score for r in forest.score(gaps).collect()}
    from metricloom.operators.outliers import average_path

    for r in plain:
        assert r.score == pytest.approx(-math.log2(-said[r.time]) * average_path(forest.sample_size))
        assert sum(r.analysis.values()) + r.base_value == pytest.approx(r.score)


@pytest.mark.parametrize("name, options", [("decision_tree", {"maxDepth": 4}), ("random_forest", {"numTrees": 4, "maxDepth": 4})])
def test_class_probabilities_add_up(rows, name, options):
    model = fit_classifier(rows, NAMES, "target", name, **options)
    for at, kind in enumerate(model.classes):
        found = ts.tree_shapley(model.append(rows), ["time", f"prob_{at}"], ts.of_classifier(model, kind)).collect()
        for r in found:
            assert r.score == pytest.approx(r[f"prob_{at}"]) == pytest.approx(sum(r.analysis.values()) + r.base_value)


def test_boosted_margins_add_up(rows):
    two = rows.withColumn("target", F.when(F.col("target") == "cpu", "cpu").otherwise("0"))
    model = fit_classifier(two, NAMES, "target", "gbt", maxIter=4, maxDepth=3)
    for r in ts.tree_shapley(model.append(two), ["time", "prob_1"], ts.of_classifier(model)).collect():
        assert 1 / (1 + math.exp(-2 * r.score)) == pytest.approx(r.prob_1)
        assert sum(r.analysis.values()) + r.base_value == pytest.approx(r.score)
    with pytest.raises(ValueError, match="by coalitions"):
        ts.of_classifier(fit_classifier(two, NAMES, "target", "adaboost", n_estimators=2))


@pytest.mark.parametrize("target, method", [(None, "isolation_forest"), ("target", "random_forest")])
def test_records_are_explained(spark, rows, target, method):
    options = {"n_estimators": 20, "contamination": 0.02} if target is None else {"numTrees": 4}
    spec = runs.RunSpec(scratch_path(spark, "run"), method=method, target=target, explain=True, options=options)
    frame = rows if target else rows.drop("target")
    runs.train(frame, spec)
    found = runs.detect(frame.drop("target"), spec).collect()
    assert found and all(set(r.analysis) == set(NAMES) and r.base_value is not None for r in found)
    plain = runs.detect(frame.drop("target"), runs.RunSpec(**{**spec.__dict__, "explain": False}))
    assert sorted(r.utc for r in found) == sorted(r.utc for r in plain.collect())
