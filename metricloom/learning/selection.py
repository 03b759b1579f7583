"""Folds, cross-validation, curves, feature elimination and parameter search."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.learning.boosting import at_once
from metricloom.learning.estimators import judged as judged_by
from metricloom.learning.evaluate import scores
from metricloom.learning.supervised import Classifier, class_list, fit_classifier
from metricloom.operators.ranking import hash_ranks, hash_split
from metricloom.operators.scale import SCALERS, fit_pca, hash_share
from metricloom.session import stored

FITS_AT_ONCE = 4
METRICS = ("accuracy", "balanced_accuracy", "f1_weighted", "jaccard_weighted", "kappa", "mcc")


def k_folds(df: DataFrame, key: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Folds of equal size."""
    ranked = hash_ranks(df, [], key, seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def stratified_folds(
    df: DataFrame, target: str, key: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Folds in which every class is spread evenly."""
    ranked = hash_ranks(df, [target], key, seed, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def shuffle_splits(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    n_splits: int = 5,
    test: float = 0.25,
    seed: int = 42,
) -> list[tuple[DataFrame, DataFrame]]:
    """Independent stratified splits; each tests the same share of every class.

    Rows without a class are in no split.
    """
    sizes = df.where(q(target).isNotNull()).groupBy(q(target).alias("_t")).agg(
        F.round(F.count(F.lit(1)) * test).cast("long")
    )
    held = {r[0]: r[1] for r in sizes.collect()}
    splits = []
    for i in range(n_splits):
        tested, trained = hash_split(df, target, key, held, seed + i)
        splits.append((trained, tested))
    return splits


def fold_pairs(df: DataFrame, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """Train and test rows of every fold; the folds are drawn once and stored."""
    drawn = stored(df, "folds")
    return [(drawn.where(q("fold") != i), drawn.where(q("fold") == i)) for i in range(folds)]


def fit_and_score(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    target: str,
    name: str,
    options: Mapping[str, object],
    classes: Sequence[str],
    scaler: str | None = None,
    components: int = 0,
    train_scores: bool = False,
    scorers: Mapping[str, Evaluator] | None = None,
) -> tuple[dict, Classifier]:
    """Scaler and components are fitted on the training rows only.

    ``scorers`` are evaluators by name, and take the place of the built-in scores.
    """
    start = time.perf_counter()
    features = list(features)
    if scaler:
        fitted = SCALERS[scaler](train, features)
        train, test = fitted.transform(train), fitted.transform(test)
    if components:
        projection = fit_pca(train, features, components)
        train, test = projection.transform(train), projection.transform(test)
        features = [f"pc{i + 1}" for i in range(len(projection.components))]
    model = fit_classifier(train, features, target, name, classes, **dict(options))
    fitted_at = time.perf_counter()
    row: dict = {"fit_time": fitted_at - start}
    if scorers:
        columns = {"labelCol": "label", "predictionCol": "prediction", "rawPredictionCol": "rawPrediction", "probabilityCol": "probability"}
        for part, rows in {"test": test, **({"train": train} if train_scores else {})}.items():
            coded = model.codes(rows, target)
            row.update({f"{part}_{m}": judged_by(e, coded, columns) for m, e in scorers.items()})
        row["score_time"] = time.perf_counter() - fitted_at
        return row, model
    judged = test.withColumn("_part", F.lit("test"))
    if train_scores:
        judged = judged.unionByName(train.withColumn("_part", F.lit("train")))
    found = scores(model.predict(judged, "_predicted"), target, "_predicted", ["_part"])
    for part in found.collect():
        row.update({f"{part['_part']}_{m}": float(part[m] or 0.0) for m in METRICS})
    row["score_time"] = time.perf_counter() - fitted_at
    return row, model


def cross_validate(
    splits: Iterable[tuple[DataFrame, DataFrame]],
    features: Sequence[str],
    target: str,
    name: str | Estimator = "random_forest",
    options: Mapping[str, object] | None = None,
    classes: Sequence[str] | None = None,
    scaler: str | None = None,
    components: int = 0,
    train_scores: bool = False,
    scorers: Mapping[str, Evaluator] | None = None,
    threads: int = FITS_AT_ONCE,
) -> tuple[list[dict], list[Classifier]]:
    """Scores and model of every split. Each fit and each score is a Spark job of its own.

    ``name`` may be an estimator, and ``scorers`` any evaluators by name. Splits are fitted from
    ``threads`` driver threads; the scores do not depend on their number.
    """
    splits = list(splits)
    if classes is None:
        train, test = splits[0]
        classes = class_list(train.unionByName(test), target)

    def fit(split: tuple[DataFrame, DataFrame]) -> tuple[dict, Classifier]:
        return fit_and_score(
            *split, features, target, name, options or {}, classes, scaler, components, train_scores, scorers
        )

    found = at_once(splits[0][0].sparkSession, fit, splits, threads)
    return [{"fold": i, **row} for i, (row, _) in enumerate(found)], [model for _, model in found]


def mean_score(rows: Sequence[dict], metric: str) -> float:
    return sum(r[f"test_{metric}"] for r in rows) / len(rows)


def score_table(spark, rows: Sequence[dict]) -> DataFrame:
    """Driver-side score rows, one per fit, as a frame."""
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], names)


def learning_curve(
    splits: Sequence[tuple[DataFrame, DataFrame]],
    key: Sequence[str],
    sizes: Sequence[float],
    features: Sequence[str],
    target: str,
    name: str,
    options: Mapping[str, object] | None = None,
    metric: str = "f1_weighted",
    seed: int = 7,
) -> list[dict]:
    """Train and test score by share of training rows; smaller shares lie in larger ones."""
    out = []
    for size in sizes:
        part = [(train.where(hash_share(key, seed) < size), test) for train, test in splits]
        rows, _ = cross_validate(part, features, target, name, options, train_scores=True)
        out.append(
            {
                "size": float(size),
                "train_score": sum(r[f"train_{metric}"] for r in rows) / len(rows),
                "test_score": mean_score(rows, metric),
            }
        )
    return out


def validation_curve(
    splits: Sequence[tuple[DataFrame, DataFrame]],
    param: str,
    values: Sequence[object],
    features: Sequence[str],
    target: str,
    name: str,
    options: Mapping[str, object] | None = None,
    metric: str = "f1_weighted",
) -> list[dict]:
    """Train and test score by the value of one parameter."""
    out = []
    for value in values:
        settings = {**(options or {}), param: value}
        rows, _ = cross_validate(splits, features, target, name, settings, train_scores=True)
        out.append(
            {
                "param": param,
                "value": float(value),
                "train_score": sum(r[f"train_{metric}"] for r in rows) / len(rows),
                "test_score": mean_score(rows, metric),
            }
        )
    return out


def rfe(
    splits: Sequence[tuple[DataFrame, DataFrame]],
    features: Sequence[str],
    target: str,
    name: str = "decision_tree",
    options: Mapping[str, object] | None = None,
    step: int = 1,
    metric: str = "f1_weighted",
) -> list[dict]:
    """Eliminate the weakest ``step`` features a round; keep the set with the best score.

    Gives every feature its mask and ranking (1 is kept); the dropped ones can be handed to
    ``drop_columns``.
    """
    left, history = list(features), []
    while True:
        rows, models = cross_validate(splits, left, target, name, options)
        history.append((mean_score(rows, metric), list(left)))
        if len(left) == 1:
            break
        weight = {f: 0.0 for f in left}
        for model in models:
            for feature, value in model.importance():
                weight[feature] += value
        gone = sorted(left, key=lambda f: (weight[f], f))[: min(step, len(left) - 1)]
        left = [f for f in left if f not in gone]
    best = max(range(len(history)), key=lambda i: (history[i][0], i))
    kept = history[best][1]
    out = []
    for feature in features:
        last = max(i for i, (_, names) in enumerate(history) if feature in names)
        rank = 1 if feature in kept else best - last + 1
        out.append({"feature": feature, "mask": feature in kept, "ranking": rank})
    return out


def drop_list(table: Sequence[dict]) -> list[str]:
    return [r["feature"] for r in table if not r["mask"]]


def feature_importance(model: Classifier, top: int = 30) -> list[dict]:
    ranked = sorted(model.importance(), key=lambda p: (-p[1], p[0]))[:top]
    return [{"feature": f, "importance": v} for f, v in ranked]


def settings_grid(grid: Mapping[str, Sequence[object]]) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*grid.values())]


class Search:
    """Evaluates settings by cross-validation and remembers what it has seen."""

    def __init__(self, splits, features, target, name, metrics=METRICS, refit="f1_weighted", scorers=None):
        """With ``scorers``, evaluators by name, ``refit`` is one of them; the first if it is not named."""
        self.splits, self.features, self.target, self.name = splits, features, target, name
        self.scorers = dict(scorers or {})
        self.metrics = list(self.scorers) or metrics
        self.refit = refit if refit in self.metrics else self.metrics[0]
        # The best value is the largest, or the smallest where the scorer says so.
        self.sign = 1 if self.refit not in self.scorers or self.scorers[self.refit].isLargerBetter() else -1
        self.results: dict[tuple, dict] = {}

    def evaluate(self, settings: Mapping[str, object]) -> float:
        mark = tuple(sorted((k, str(v)) for k, v in settings.items()))
        if mark not in self.results:
            rows, _ = cross_validate(
                self.splits, self.features, self.target, self.name, settings, scorers=self.scorers
            )
            self.results[mark] = {
                "settings": ", ".join(f"{k}={v}" for k, v in mark),
                **{m: mean_score(rows, m) for m in self.metrics},
                "_settings": dict(settings),
            }
        return self.sign * self.results[mark][self.refit]

    def table(self) -> list[dict]:
        ordered = sorted(self.results.values(), key=lambda r: (-self.sign * r[self.refit], r["settings"]))
        return [{"rank": i + 1, **{k: v for k, v in r.items() if k != "_settings"}}
                for i, r in enumerate(ordered)]

    def best(self) -> dict:
        return max(self.results.values(), key=lambda r: self.sign * r[self.refit])["_settings"]


def hpo_grid(search: Search, grid: Mapping[str, Sequence[object]]) -> list[dict]:
    for settings in settings_grid(grid):
        search.evaluate(settings)
    return search.table()


def hpo_random(
    search: Search, grid: Mapping[str, Sequence[object]], n_iter: int = 10, seed: int = 42
) -> list[dict]:
    """A seeded sample of the grid, without repeats."""
    every = settings_grid(grid)
    for settings in random.Random(seed).sample(every, min(n_iter, len(every))):
        search.evaluate(settings)
    return search.table()


def hpo_evolution(
    search: Search,
    grid: Mapping[str, Sequence[object]],
    population: int = 6,
    generations: int = 3,
    tournament: int = 3,
    crossover: float = 0.5,
    mutation: float = 0.2,
    seed: int = 42,
) -> list[dict]:
    """Tournament selection, gene-wise crossover and mutation over the grid's values."""
    rng = random.Random(seed)
    names = list(grid)

    def anyone() -> dict:
        return {n: rng.choice(list(grid[n])) for n in names}

    people = [anyone() for _ in range(population)]
    for _ in range(generations):
        fitness = [search.evaluate(p) for p in people]

        def pick() -> dict:
            rivals = [rng.randrange(len(people)) for _ in range(tournament)]
            return people[max(rivals, key=lambda i: fitness[i])]

        children = []
        for _ in range(population):
            a, b = pick(), pick()
            child = {n: (b if rng.random() < crossover else a)[n] for n in names}
            children.append(
                {n: rng.choice(list(grid[n])) if rng.random() < mutation else v
                 for n, v in child.items()}
            )
        people = children
    for person in people:
        search.evaluate(person)
    return search.table()


def model_search(
    splits: Sequence[tuple[DataFrame, DataFrame]],
    features: Sequence[str],
    target: str,
    scalers: Sequence[str | None],
    components: Sequence[int],
    models: Mapping[str, Mapping[str, Sequence[object]]],
    n_iter: int = 10,
    metric: str = "f1_weighted",
    seed: int = 42,
) -> list[dict]:
    """Random search over scaler, number of components and classifier with its settings."""
    every = [
        (s, c, name, settings)
        for s in scalers
        for c in components
        for name, grid in models.items()
        for settings in settings_grid(grid)
    ]
    out = []
    for s, c, name, settings in random.Random(seed).sample(every, min(n_iter, len(every))):
        rows, _ = cross_validate(
            splits, features, target, name, settings, scaler=s, components=c
        )
        out.append(
            {
                "scaler": s or "none", "components": c, "model": name,
                "settings": ", ".join(f"{k}={v}" for k, v in sorted(settings.items())),
                metric: mean_score(rows, metric),
            }
        )
    return sorted(out, key=lambda r: -r[metric])


def model_compare(table: DataFrame, model: str, score: str | Column) -> DataFrame:
    """The model with the best score; of equals, the first by name."""
    value = q(score) if isinstance(score, str) else score
    return table.groupBy(q(model).alias("model")).agg(F.max(value).alias("score")).orderBy(
        F.col("score").desc(), "model"
    ).limit(1)
