"""Exact Shapley values of tree ensembles, in one pass over the rows.

A feature outside a coalition sends a row down both sides of its cuts, in the shares of the
training rows. A leaf then counts as a product over the features on its path: for a feature in the
coalition 1 or 0, as the row meets its bounds or not, and for one outside, the share ``z`` of the rows
that the feature's cuts have let through. For a leaf of k features the Shapley sum needs only the
elementary symmetric polynomials of k - 1 such terms, and only for the patterns of bounds met.

Leaves that are neighbours in their tree share most bounds. These cut the rows' space into few cells,
for each of which the leaves' values are added up once; rows look their cell's values up. Leaves of
paths with too many features for that are valued for the patterns that occur in a batch. Nothing is
sampled, and no row is expanded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.learning.boosting import Softmax
from metricloom.learning.supervised import Boosted, Classifier
from metricloom.operators.outliers import IsolationForest
from metricloom.session import scratch_path

BATCH_ROWS = 20_000
STEP_ROWS = 4096  # rows that are looked up together
GROUP_CELLS = 4096  # most cells of a group of leaves


@dataclass(frozen=True)
class Leaf:
    """Bounds low < x <= high of each feature on the path, the shares let through, the value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float

    def met(self, rows: np.ndarray) -> np.ndarray:
        """Which bounds each row meets, as bits of a number; a missing value lies above all cuts."""
        code = np.zeros(len(rows), np.int64)
        for bit, (f, low, high) in enumerate(zip(self.features, self.low, self.high)):
            x = rows[:, f]
            inside = ~(x <= low) if math.isinf(high) else (x <= high) & (x > low)
            code |= inside.astype(np.int64) << bit
        return code

    def values(self, codes: np.ndarray) -> np.ndarray:
        """The values of the path's features for each pattern of bounds met."""
        k = len(self.features)
        met = (codes[:, None] >> np.arange(k) & 1).astype(float)
        weight = [math.factorial(s) * math.factorial(k - 1 - s) / math.factorial(k) for s in range(k)]
        out = np.empty((len(codes), k))
        for i in range(k):
            # The polynomial whose coefficient of t^s sums the products of coalitions of s features.
            sums = np.zeros((len(codes), k))
            sums[:, 0] = 1.0
            for j in range(k):
                if j != i:
                    grown = sums[:, :-1] * met[:, j, None]
                    sums *= self.share[j]
                    sums[:, 1:] += grown
            out[:, i] = self.value * (met[:, i] - self.share[i]) * (sums @ weight)
        return out


class Group:
    """Leaves with the sums of their values in every cell that their bounds make."""

    def __init__(self, leaves: Sequence[Leaf], cuts: dict[int, set[float]]):
        self.features = sorted(cuts)
        self.cuts = {f: np.array(sorted(cuts[f])) for f in self.features}
        shape = [len(self.cuts[f]) + 1 for f in self.features]
        self.strides = {f: math.prod(shape[i + 1 :]) for i, f in enumerate(self.features)}
        # The last column is for scores.
        values = np.zeros((*shape, len(shape) + 1))
        for leaf in leaves:
            codes = np.zeros([1] * len(shape), np.int64)
            for bit, f in enumerate(leaf.features):
                below, upto = np.append(-math.inf, self.cuts[f]), np.append(self.cuts[f], math.inf)
                inside = (below >= leaf.low[bit]) & (upto <= leaf.high[bit])
                codes = codes | np.expand_dims(inside.astype(np.int64) << bit, [i for i, g in enumerate(self.features) if g != f])
            patterns = leaf.values(np.arange(1 << len(leaf.features)))
            for bit, f in enumerate(leaf.features):
                values[..., self.features.index(f)] += patterns[codes, bit]
            values[..., -1] += np.where(codes == len(patterns) - 1, leaf.value, 0.0)
        self.values = values.reshape(-1, len(shape) + 1)


def grouped(leaves: Sequence[Leaf]) -> tuple[list[Group], list[Leaf]]:
    """Groups of leaves in the given order, and the leaves that have too many cells for a group."""
    groups, alone = [], []
    held: list[Leaf] = []
    cuts: dict[int, set[float]] = {}
    for leaf in leaves:
        own = {int(f): {b for b in ends if math.isfinite(b)} for f, *ends in zip(leaf.features, leaf.low, leaf.high)}
        if not own or math.prod(len(c) + 1 for c in own.values()) > GROUP_CELLS:
            alone.append(leaf)
            continue
        both = {f: cuts.get(f, set()) | own.get(f, set()) for f in {*cuts, *own}}
        if math.prod(len(c) + 1 for c in both.values()) > GROUP_CELLS:
            groups.append(Group(held, cuts))
            held, both = [], own
        held.append(leaf)
        cuts = both
    if held:
        groups.append(Group(held, cuts))
    return groups, alone


@dataclass(frozen=True)
class Ensemble:
    """Leaves of all trees; the model's score is the sum of those a row falls into, and ``offset``."""

    features: list[str]
    leaves: list[Leaf]
    offset: float = 0.0

    @property
    def base(self) -> float:
        return self.offset + sum(leaf.value * float(np.prod(leaf.share)) for leaf in self.leaves)

    @cached_property
    def laid_out(self) -> tuple[dict[int, np.ndarray], list, list[Leaf]]:
        """The cuts of each feature, the groups, and the leaves left over; made once in a worker.

        A group comes with the place in its table that each range between cuts adds for its feature.
        """
        groups, alone = grouped(self.leaves)
        cuts = {f: np.unique(np.concatenate([g.cuts[f] for g in groups if f in g.cuts])) for f in sorted({f for g in groups for f in g.features})}
        placed = []
        for group in groups:
            # All values of a range have the same cuts of the group below them as its upper end.
            places = [(f, np.searchsorted(group.cuts[f], np.append(cuts[f], math.inf)) * group.strides[f]) for f in group.features]
            placed.append((places, group.features, group.values))
        return cuts, placed, alone

    def _look_up(self, rows: np.ndarray, out: np.ndarray) -> None:
        """Add the groups' values to ``out``; a missing value lies above all cuts, as NaN is sorted."""
        cuts, groups, _ = self.laid_out
        ranges = {f: np.searchsorted(c, rows[:, f]) for f, c in cuts.items()}
        for places, features, values in groups:
            at = sum(place.take(ranges[f]) for f, place in places)
            out[:, [*features, -1]] += values.take(at, axis=0)

    def explain(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values by row and feature, scores)."""
        found = np.zeros((len(rows), len(self.features) + 1))
        for start in range(0, len(rows), STEP_ROWS):
            self._look_up(rows[start : start + STEP_ROWS], found[start : start + STEP_ROWS])
        phi, score = found[:, :-1].copy(), found[:, -1] + self.offset
        for leaf in self.laid_out[2]:
            if not len(leaf.features):
                score += leaf.value
                continue
            seen, place = np.unique(leaf.met(rows), return_inverse=True)
            phi[:, leaf.features] += leaf.values(seen)[place]
            score += np.where(seen == (1 << len(leaf.features)) - 1, leaf.value, 0.0)[place]
        return phi, score


def leaves_of(feature, threshold, low, high, cover, value) -> list[Leaf]:
    """The leaves of a tree given by its nodes; a leaf is its own child, node 0 the root."""
    found: list[Leaf] = []
    todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while todo:
        node, path = todo.pop()
        if low[node] == node:
            if value[node]:
                parts = [(f, *path[f]) for f in sorted(path)]
                columns = [np.array(c) for c in zip(*parts)] or [np.empty(0)] * 4
                found.append(Leaf(columns[0].astype(int), *columns[1:], float(value[node])))
            continue
        f, cut = feature[node], threshold[node]
        least, most, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, bounds in ((low[node], (least, min(most, cut))), (high[node], (max(least, cut), most))):
            todo.append((child, {**path, f: (*bounds, share * cover[child] / cover[node])}))
    return found


def of_forest(forest: IsolationForest) -> Ensemble:
    """A forest's mean path length: short paths are anomalies."""
    leaves = []
    for t in forest.trees:
        if t.get("cover") is None:
            raise ValueError("the forest was saved without its nodes' sizes: fit it again")
        value = [p / len(forest.trees) for p in t["path"]]
        leaves += leaves_of(t["feature"], t["threshold"], t["low"], t["high"], t["cover"], value)
    return Ensemble(forest.features, leaves)


def of_classifier(model: Classifier, output: str | None = None) -> Ensemble:
    """A tree classifier's probability of the class ``output`` (the last one by default).

    For two-class boosted trees it is the margin of the second class, of which the probability is
    the logistic function of twice the value. Nodes are read from the model as Spark saves it.
    """
    at = model.classes.index(output) if output is not None else len(model.classes) - 1
    if isinstance(model.model, (Boosted, Softmax)):
        raise ValueError("the probabilities of this ensemble do not add up: explain it by coalitions")
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    model.model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    weights = {0: 1.0}
    if "nodeData" in saved.columns:
        # (tree, its settings, its weight)
        weights = {r[0]: r[2] for r in spark.read.parquet(f"{path}/treesMetadata").collect()}
        saved = saved.select("treeID", "nodeData.*")
    else:
        saved = saved.select(F.lit(0).alias("treeID"), "*")
    boosted = model.model.hasParam("maxIter")
    total = 1.0 if boosted else sum(weights.values())
    trees: dict[int, dict[int, object]] = {}
    # As many rows as the model has nodes.
    for r in saved.collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    leaves = []
    for number, nodes in trees.items():
        size = max(nodes) + 1
        feature, threshold, low, high = [0] * size, [0.0] * size, list(range(size)), list(range(size))
        cover, value = [1] * size, [0.0] * size
        for i, r in nodes.items():
            cover[i] = r["rawCount"]
            if r["leftChild"] >= 0:
                if r["split"]["numCategories"] != -1:
                    raise ValueError("cuts on categories have no bounds: index them as numbers")
                feature[i], [threshold[i]] = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"]
                low[i], high[i] = r["leftChild"], r["rightChild"]
            else:
                stats = r["impurityStats"]
                value[i] = weights[number] / total * (r["prediction"] if boosted else stats[at] / sum(stats))
        leaves += leaves_of(feature, threshold, low, high, cover, value)
    return Ensemble(model.features, leaves)


def tree_shapley(rows: DataFrame, key: Sequence[str], ensemble: Ensemble, name: str = "analysis") -> DataFrame:
    """The key, ``base_value``, ``score`` and a map from feature to value, one row for each row.

    The values of a row add up to its score less the base value. Missing values take the higher
    side of every cut, as in scoring. The ensemble is broadcast; it is bounded by its fit.
    """
    features = ensemble.features
    sent, base = rows.sparkSession.sparkContext.broadcast(ensemble), ensemble.base
    values = F.array(*[F.coalesce(q(f).cast("double"), F.lit(float("nan"))) for f in features])

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                x = part.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(features))
                phi, score = model.explain(x)
                lists = pa.ListArray.from_arrays(np.arange(0, phi.size + 1, len(features), dtype=np.int32), pa.array(phi.ravel()))
                kept = [part.column(c) for c in key]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score), lists], names=[*key, "score", "_phi"])

    keys = rows.select(*[q(k) for k in key])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema), "score double", "_phi array<double>"])
    found = rows.select(*[q(k) for k in key], values.alias("_x")).mapInArrow(explained, schema)
    names = F.array(*[F.lit(f) for f in features])
    return found.select(*[q(k) for k in key], F.lit(base).alias("base_value"), "score", F.map_from_arrays(names, "_phi").alias(name))


def values_of(explained: DataFrame, key: Sequence[str], name: str = "analysis") -> DataFrame:
    """A row per feature: (key, base_value, score, feature, phi)."""
    kept = [q(k) for k in key]
    return explained.select(*kept, "base_value", "score", F.explode(q(name)).alias("feature", "phi"))
