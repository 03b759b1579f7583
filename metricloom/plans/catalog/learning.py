"""Classifier, selection and explanation queries."""

from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.learning import explain, grids, selection, store, supervised, tree_shapley
from metricloom.learning.evaluate import ranking_scores
from metricloom.operators.outliers import average_path, fit_isolation_forest
from metricloom.operators.points import detect_classes, detect_outliers
from metricloom.operators.scale import fit_pca, fit_standard, train_test_split
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.registry import query
from metricloom.session import scratch_path, spread

TARGET = "load"
QUICK = {"maxDepth": 4}


def rows_of(spark, sf):
    """Line items with a learnable three-way class, blurred by the row key."""
    rows = spread(lineitem(spark, sf), "row_key")
    blur = F.pmod(q("row_key"), F.lit(1000)) / 100
    level = q("l_quantity") + q("l_discount") * 100 + blur
    kind = F.when(level < 25, "0").when(level < 45, "cpu").otherwise("mem")
    return rows.withColumn(TARGET, kind)


def _fit(rows, name, **options):
    return supervised.fit_classifier(rows, NUMBERS, TARGET, name, **options)


@query("clf_random_forest")
def clf_random_forest(spark, sf):
    rows = rows_of(spark, sf)
    return _fit(rows, "random_forest", numTrees=10, maxDepth=5).append(rows)


@query("clf_decision_tree")
def clf_decision_tree(spark, sf):
    rows = rows_of(spark, sf)
    return _fit(rows, "decision_tree", maxDepth=5).append(rows)


@query("clf_gbt")
def clf_gbt(spark, sf):
    rows = rows_of(spark, sf)
    held = rows.withColumn("held", (F.pmod(q("row_key"), F.lit(5)) == 0).cast("int"))
    model = _fit(held, "gbt", validation="held", maxIter=3, maxDepth=3)
    return model.append(rows)


@query("clf_gbt_probabilities", "SELECT count(*) AS n, count(*) AS whole, count(*) AS chosen FROM lineitem")
def clf_gbt_probabilities(spark, sf):
    """Every row's probabilities add up to one, and the class is the likeliest."""
    rows = rows_of(spark, sf)
    held = rows.withColumn("held", (F.pmod(q("row_key"), F.lit(5)) == 0).cast("int"))
    judged = _fit(held, "gbt", validation="held", maxIter=2, maxDepth=3).append(rows)
    probs = F.array(*[q(f"prob_{i}") for i in range(3)])
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.array_position(probs, F.array_max(probs)).cast("int"))
    return judged.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) < 1e-9).alias("whole"),
        F.count_if(q("pred") == best).alias("chosen"),
    )


@query("clf_mlp")
def clf_mlp(spark, sf):
    rows = rows_of(spark, sf)
    scaled = fit_standard(rows, NUMBERS).transform(rows)
    return _fit(scaled, "mlp", hidden=(8,), maxIter=15).append(scaled)


@query("clf_adaboost")
def clf_adaboost(spark, sf):
    rows = rows_of(spark, sf)
    return _fit(rows, "adaboost", n_estimators=3, max_depth=2).append(rows)


@query("feature_importance")
def feature_importance(spark, sf):
    model = _fit(rows_of(spark, sf), "random_forest", numTrees=5, maxDepth=4)
    return selection.score_table(spark, selection.feature_importance(model))


def _splits(spark, sf, k=2):
    rows = rows_of(spark, sf).select("row_key", TARGET, *NUMBERS)
    return selection.fold_pairs(selection.stratified_folds(rows, TARGET, ["row_key"], k), k)


CLASSES = ["0", "cpu", "mem"]


@query("cross_validate")
def cross_validate(spark, sf):
    rows, _ = selection.cross_validate(
        _splits(spark, sf, 3), NUMBERS, TARGET, "decision_tree", QUICK, CLASSES, "StandardScaler",
        train_scores=True,
    )
    return selection.score_table(spark, rows)


@query("learning_curve")
def learning_curve(spark, sf):
    curve = selection.learning_curve(
        _splits(spark, sf), ["row_key"], [0.3, 1.0], NUMBERS, TARGET, "decision_tree", QUICK
    )
    return selection.score_table(spark, curve)


@query("validation_curve")
def validation_curve(spark, sf):
    curve = selection.validation_curve(
        _splits(spark, sf), "maxDepth", [1, 4], NUMBERS, TARGET, "decision_tree"
    )
    return selection.score_table(spark, curve)


@query("rfe")
def rfe(spark, sf):
    table_rows = selection.rfe(_splits(spark, sf), NUMBERS, TARGET, "decision_tree", QUICK)
    return selection.score_table(spark, table_rows)


GRID = {"maxDepth": [2, 4], "impurity": ["gini", "entropy"]}


def _search(spark, sf):
    return selection.Search(_splits(spark, sf), NUMBERS, TARGET, "decision_tree")


@query("hpo_grid")
def hpo_grid(spark, sf):
    return selection.score_table(spark, selection.hpo_grid(_search(spark, sf), GRID))


@query("hpo_random")
def hpo_random(spark, sf):
    return selection.score_table(spark, selection.hpo_random(_search(spark, sf), GRID, 2))


@query("hpo_evolution")
def hpo_evolution(spark, sf):
    found = selection.hpo_evolution(_search(spark, sf), GRID, population=3, generations=2)
    return selection.score_table(spark, found)


@query("model_search")
def model_search(spark, sf):
    models = {"decision_tree": {"maxDepth": [3, 5]}, "random_forest": {"numTrees": [3], "maxDepth": [4]}}
    found = selection.model_search(
        _splits(spark, sf), NUMBERS, TARGET, [None, "StandardScaler"], [0, 2], models, n_iter=3
    )
    return selection.score_table(spark, found)


@query("hold_out_scores")
def hold_out_scores(spark, sf):
    """Ranking scores of a forest's probability on the third it has not seen."""
    train, test = train_test_split(rows_of(spark, sf), ["row_key"], 0.33)
    judged = _fit(train, "random_forest", numTrees=5, maxDepth=5).append(test)
    return ranking_scores(judged, q(TARGET) == "mem", "prob_2")


def _forest(spark, sf):
    rows = spread(lineitem(spark, sf), "row_key")
    return rows, fit_isolation_forest(rows, NUMBERS, ["row_key"], 25, contamination=0.01)


@query("shap_rows")
def shap_rows(spark, sf):
    rows, forest = _forest(spark, sf)
    flagged = forest.predict(rows).where("prediction = -1").drop("score", "prediction")
    background = explain.background_rows(rows, NUMBERS, ["row_key"], 8)
    return explain.shapley_rows(flagged, NUMBERS, "row_key", forest.score, background, 2)


# The values of all rows, exact: with the base value they add up to what the model itself says.
ADDS_UP = "SELECT count(*) AS n, CAST(0 AS DOUBLE) AS gap FROM lineitem"


def _gap(explained, said):
    total = F.aggregate(F.map_values("analysis"), F.col("base_value"), lambda a, v: a + v)
    gap = F.round(F.max(F.greatest(F.abs(total - said), F.abs(q("score") - said))), 9) + F.lit(0.0)
    return explained.agg(F.count(F.lit(1)).alias("n"), gap.alias("gap"))


@query("shap_tree_forest", ADDS_UP)
def shap_tree_forest(spark, sf):
    rows, forest = _forest(spark, sf)
    scored = forest.score(rows, "said")
    explained = tree_shapley.tree_shapley(scored, ["row_key", "said"], tree_shapley.of_forest(forest))
    return _gap(explained, -F.log2(-q("said")) * average_path(forest.sample_size))


@query("shap_tree_classes", ADDS_UP)
def shap_tree_classes(spark, sf):
    rows = rows_of(spark, sf)
    model = _fit(rows, "random_forest", numTrees=10, maxDepth=5)
    ensemble = tree_shapley.of_classifier(model, "mem")
    explained = tree_shapley.tree_shapley(model.append(rows), ["row_key", "prob_2"], ensemble)
    return _gap(explained, q("prob_2"))


@query("shap_classes")
def shap_classes(spark, sf):
    rows = rows_of(spark, sf)
    model = _fit(rows, "decision_tree", maxDepth=5)
    background = explain.background_rows(rows, NUMBERS, ["row_key"], 5)

    def score(df):
        return model.append(df).withColumnRenamed("prob_2", "score")

    flagged = model.predict(rows).where("prediction = 'mem'")
    values = explain.shapley_rows(flagged, NUMBERS, "row_key", score, background, 2)
    return explain.class_importance(values.withColumn("type", F.lit("mem")), "type")


@query("model_store")
def model_store(spark, sf):
    rows, root = rows_of(spark, sf), scratch_path(spark, "models")
    path = store.model_path(root, "decision_tree", "loads")
    store.save_classifier(spark, _fit(rows, "decision_tree", maxDepth=5), path)
    model = store.load_classifier(spark, path)
    timed = rows.withColumn("time", F.pmod(q("row_key"), F.lit(2_000_000_000)))
    return detect_classes(model.predict(timed), keep=["row_key"])


@query("model_store_forest")
def model_store_forest(spark, sf):
    rows, forest = _forest(spark, sf)
    path = store.model_path(scratch_path(spark, "models"), "isolation_forest", "items")
    store.save_forest(spark, forest, path)
    judged = store.load_forest(spark, path).predict(rows)
    timed = judged.withColumn("time", F.pmod(q("row_key"), F.lit(2_000_000_000)))
    return detect_outliers(timed, keep=["row_key"])


@query("decision_grid")
def decision_grid(spark, sf):
    rows = rows_of(spark, sf)
    scaled = fit_standard(rows, NUMBERS).transform(rows)
    flat = fit_pca(scaled, NUMBERS, 2).transform(scaled).select("pc1", "pc2", TARGET)
    model = supervised.fit_classifier(flat, ["pc1", "pc2"], TARGET, "decision_tree", maxDepth=5)
    return grids.decision_grid(spark, model.append)
