"""Shapley values of single rows for any model that scores a frame."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import q


def background_rows(
    df: DataFrame, features: Sequence[str], key: Sequence[str], n: int = 20, seed: int = 42
) -> list[tuple]:
    """The ``n`` rows with the smallest hashes: a uniform sample, held by the driver."""
    hashed = F.xxhash64(*[q(k) for k in key], F.lit(seed))
    rows = df.orderBy(hashed, *[q(k) for k in key]).limit(n)
    return [tuple(float(v) for v in r) for r in rows.select(*[q(f) for f in features]).collect()]


def _coalitions(features: int, permutations: int, seed: int) -> dict[tuple[bool, ...], list[float]]:
    """Coalitions met along seeded orders (each also reversed), with their part in every
    feature's value: + where the feature has just joined, - where it joins next."""
    rng, orders = random.Random(seed), []
    while len(orders) < permutations:
        order = rng.sample(range(features), features)
        orders += [order, order[::-1]]
    orders = orders[:permutations]
    parts: dict[tuple[bool, ...], list[float]] = {}
    for order in orders:
        inside = [False] * features
        for step in range(features + 1):
            part = parts.setdefault(tuple(inside), [0.0] * features)
            if step:
                part[order[step - 1]] += 1 / len(orders)
            if step < features:
                part[order[step]] -= 1 / len(orders)
                inside[order[step]] = True
    return parts


def shapley_rows(
    rows: DataFrame,
    features: Sequence[str],
    key: str,
    score: Callable[[DataFrame], DataFrame],
    background: Sequence[tuple],
    permutations: int = 4,
    seed: int = 42,
) -> DataFrame:
    """(key, feature, phi, base_value, score) for each row.

    A row is expanded into the coalitions of its features, the others taken from a
    background row, and all are scored by one ``score`` call (it adds ``score``). The
    values of a row add up to its score less the base value.
    """
    features = list(features)
    others = F.array(
        *[F.struct(*[F.lit(v).alias(f"b{i}") for i, v in enumerate(b)]) for b in background]
    )
    sides = F.array(
        *[
            F.struct(
                F.array(*[F.lit(m) for m in mask]).alias("mask"),
                F.array(*[F.lit(c) for c in part]).alias("part"),
            )
            for mask, part in _coalitions(len(features), permutations, seed).items()
        ]
    )
    spread = rows.select(
        q(key).alias("_key"), *[q(f).cast("double").alias(f) for f in features],
        F.explode(others).alias("_b"),
    ).withColumn("_c", F.explode(sides))
    mixed = spread.select(
        "_key",
        *[
            F.when(F.col("_c.mask")[i], q(f)).otherwise(F.col("_b")[f"b{i}"]).alias(f)
            for i, f in enumerate(features)
        ],
        F.col("_c.part").alias("_part"),
        (~F.exists("_c.mask", lambda m: m)).alias("_none"),
        F.forall("_c.mask", lambda m: m).alias("_all"),
    )
    size = float(len(background))
    sums = score(mixed).groupBy("_key").agg(
        *[
            (F.sum(F.col("score") * F.col("_part")[i]) / size).alias(f"_phi{i}")
            for i in range(len(features))
        ],
        (F.sum(F.when(F.col("_none"), F.col("score"))) / size).alias("base_value"),
        (F.sum(F.when(F.col("_all"), F.col("score"))) / size).alias("score"),
    )
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.col(f"_phi{i}").alias("phi"))
            for i, f in enumerate(features)
        ]
    )
    return sums.select(F.col("_key").alias(key), "base_value", "score", F.inline(cells))


def shapley_map(values: DataFrame, key: str) -> DataFrame:
    """One row per explained row, its values as a map from feature."""
    return values.groupBy(q(key), "base_value").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "phi"))).alias("analysis")
    )


def outlier_importance(values: DataFrame) -> DataFrame:
    """Mean absolute value per feature."""
    return values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")).orderBy(
        F.col("importance").desc(), "feature"
    )


def class_importance(values: DataFrame, target: str) -> DataFrame:
    """Signed sum per class and feature, by size."""
    sums = values.groupBy(q(target), "feature").agg(F.sum("phi").alias("importance"))
    return sums.orderBy(q(target), F.abs("importance").desc(), "feature")
