"""Outlier scores: isolation forest, histograms, clusters and reconstruction error.

All scores except the forest's grow with abnormality; ``flag_top`` turns a score into a
0/1 label. Fitted state is bounded by columns, bins, clusters or trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators.ranking import exact_quantiles
from metricloom.operators.scale import fit_pca, fit_standard
from metricloom.session import cut_lineage, stored

_TREE = (
    "tree int, feature array<int>, threshold array<double>, low array<int>, high array<int>, "
    "path array<double>, cover array<int>"
)
_EULER = 0.5772156649015329


def flag_top(
    scored: DataFrame,
    contamination: float,
    score: str = "score",
    name: str = "prediction",
    store: bool = False,
) -> DataFrame:
    """1 for the share of rows with the highest scores, else 0; rows without a score are 0.

    Scores are read several times: ``store`` those that are dear to compute.
    """
    scored = cut_lineage(scored) if store else scored
    threshold = exact_quantiles(scored, score, [1 - contamination])[0]
    flagged = F.coalesce((q(score) > F.lit(threshold)).cast("int"), F.lit(0))
    return scored.withColumn(name, flagged)


# --- isolation forest ---------------------------------------------------------------------


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


@dataclass(frozen=True)
class IsolationForest:
    features: list[str]
    trees: list[dict]
    sample_size: int
    offset: float = -0.5

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Scores from -1 (isolated at once) to 0; ordinary rows are near -0.5 or above."""
        path = _mean_path(self.trees)(*[q(c).cast("double") for c in self.features])
        scale = average_path(self.sample_size) or 1.0
        return df.withColumn(name, -F.pow(F.lit(2.0), -path / F.lit(scale)))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """-1 for anomalies, 1 for other rows, beside the score."""
        return self.score(df).withColumn(
            name, F.when(F.col("score") < self.offset, -1).otherwise(1)
        )


_CUTS = ("feature", "threshold", "low", "high")


class _Walk:
    """A tree renumbered so that the two sides of a cut are neighbours; ``nodes`` are its own numbers.

    A step is then one comparison, and the tree's depth says how many there are. Leaves point to
    themselves with a bound that nothing exceeds.
    """

    def __init__(self, cuts: Sequence[np.ndarray]):
        feature, threshold, low, high = cuts
        level, order, places = np.zeros(1, np.int64), [np.zeros(1, np.int64)], []
        size, self.steps = 1, 0
        while True:
            inner = low[level] != level
            places.append(np.where(inner, size + 2 * (np.cumsum(inner) - 1), -1))
            if not inner.any():
                break
            level = np.column_stack([low[level[inner]], high[level[inner]]]).ravel()
            order.append(level)
            size, self.steps = size + len(level), self.steps + 1
        self.nodes, first = np.concatenate(order), np.concatenate(places)
        ends = first < 0
        self.first = np.where(ends, np.arange(size), first)
        self.threshold = np.where(ends, np.inf, threshold[self.nodes])
        self.feature = np.where(ends, 0, feature[self.nodes])

    def ends(self, columns: np.ndarray) -> np.ndarray:
        """The leaf of every row, in the new numbers, from ``_columns`` of the rows."""
        rows = columns.shape[1]
        cells, here, start = columns.ravel(), np.arange(rows), self.feature * rows
        node = np.zeros(rows, np.int64)
        for _ in range(self.steps):
            node = self.first.take(node) + (cells.take(start.take(node) + here) > self.threshold.take(node))
        return node


def _columns(rows: np.ndarray, missing: float = np.inf) -> np.ndarray:
    """A line per feature; missing values lie above all cuts."""
    return np.ascontiguousarray(np.where(np.isnan(rows), missing, rows).T)


def _leaves(rows: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The leaf of every row."""
    walk = _Walk(cuts)
    return walk.nodes.take(walk.ends(_columns(rows)))


def _mean_path(trees: list[dict]):
    @F.pandas_udf("double")
    def mean_path(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        walks = [_Walk([np.asarray(t[k]) for k in _CUTS]) for t in trees]
        grown = [(walk, np.asarray(t["path"])[walk.nodes]) for walk, t in zip(walks, trees)]
        for batch in batches:
            columns = _columns(np.column_stack([column.to_numpy(float) for column in batch]))
            total = np.zeros(columns.shape[1])
            for walk, path in grown:
                total += path.take(walk.ends(columns))
            yield pd.Series(total / len(grown))

    return mean_path


def _deal_rows(
    df: DataFrame, key: Sequence[str], trees: int, size: int, count: int, seed: int
) -> DataFrame:
    """Deal every tree more than ``size`` rows by hash, then keep its ``size`` first.

    The surplus is six standard deviations of what a hash deals, so no tree comes short.
    Large inputs are thinned by a filter alone. Small ones are dealt several times over.
    """
    groups = max(1, int(count / (size + 6 * math.sqrt(size) + 12)))
    rounds = F.sequence(F.lit(0), F.lit(math.ceil(trees / groups) - 1))
    dealt = df.withColumn("_round", F.explode(rounds))
    hand = F.xxhash64(*[q(k) for k in key], F.col("_round"), F.lit(seed))
    tree = F.col("_round") * groups + F.pmod(hand, F.lit(groups))
    dealt = dealt.withColumn("_tree", tree.cast("int")).where(F.col("_tree") < trees)
    draw = F.xxhash64(*[q(k) for k in key], F.col("_tree"), F.lit(seed + 1))
    first = Window.partitionBy("_tree").orderBy(draw, *[q(k) for k in key])
    return dealt.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= size)


def _grow(rows: np.ndarray, columns: np.ndarray, rng, limit: int) -> dict:
    feature, threshold, low, high, path, cover = [], [], [], [], [], []

    def add(part: np.ndarray, depth: int) -> int:
        at = len(feature)
        for column, value in ((feature, 0), (threshold, 0.0), (low, at), (high, at), (path, 0.0), (cover, len(part))):
            column.append(value)
        known = ~np.isnan(part[:, columns])
        most = np.where(known, part[:, columns], -np.inf).max(axis=0, initial=-np.inf)
        least = np.where(known, part[:, columns], np.inf).min(axis=0, initial=np.inf)
        open_columns = columns[most > least]
        if depth >= limit or len(part) <= 1 or not len(open_columns):
            path[at] = depth + average_path(len(part))
            return at
        chosen = int(rng.choice(open_columns))
        values = part[:, chosen]
        lowest, highest = np.nanmin(values), np.nanmax(values)
        cut = rng.uniform(lowest, highest)
        cut = cut if cut < highest else lowest
        below = values <= cut  # missing values go with the higher ones, as in scoring
        feature[at], threshold[at] = chosen, float(cut)
        low[at] = add(part[below], depth + 1)
        high[at] = add(part[~below], depth + 1)
        return at

    add(rows, 0)
    return dict(feature=feature, threshold=threshold, low=low, high=high, path=path, cover=cover)


# --- trees over more rows than a task should hold ------------------------------------------

TASK_SAMPLE = 1 << 14
WIDE_LEVELS = 12
_STATE_CELLS = 1 << 22
_POISSON_TAIL = 40


def _times_drawn(hashes: np.ndarray, tree: int, seed: int, share: float, bootstrap: bool) -> np.ndarray | None:
    """How often each row is in a tree's sample: a function of its hash, the tree and the seed. None: all once."""
    if share >= 1 and not bootstrap:
        return None
    # The constants of the splitmix64 generator.
    step, first, second = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    mixed = hashes.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * step % 2**64)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(first)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(second)
    uniform = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    if not bootstrap:
        return (uniform < share).astype(np.int64)
    # Drawing with replacement from many rows takes each a Poisson number of times.
    chances = [math.exp(k * math.log(share) - share - math.lgamma(k + 1)) for k in range(_POISSON_TAIL)]
    return np.searchsorted(np.cumsum(chances), uniform, side="right")


def _level_sums(trees: list[dict], ids: list[int], slots: list[np.ndarray], wide: int, draw):
    """Rows and value range of each open leaf, from one partition's rows.

    Without ``wide`` there are no ranges. ``draw`` says how often each row counts, None for once.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walks = [_Walk([np.asarray(t[k]) for k in _CUTS]) for t in trees]
        open_leaves = [int(s.max()) + 1 for s in slots]
        # Rows in closed leaves go to one place more.
        places = [np.where(s < 0, n, s)[walk.nodes] for s, n, walk in zip(slots, open_leaves, walks)]
        count = [np.zeros(n + 1, dtype=np.int64) for n in open_leaves]
        least = [np.full((wide, n + 1), np.inf) for n in open_leaves]
        most = [np.full((wide, n + 1), -np.inf) for n in open_leaves]
        for batch in batches:
            hashes = batch["_hash"].to_numpy()
            rows = batch.drop(columns="_hash").to_numpy(float)
            columns = _columns(rows)
            tops = _columns(rows, -np.inf) if wide and np.isnan(rows).any() else columns
            for i, tree in enumerate(ids):
                place, times = places[i].take(walks[i].ends(columns)), draw(hashes, tree)
                if times is None:
                    count[i] += np.bincount(place, minlength=len(count[i]))
                else:
                    place = np.where(times > 0, place, open_leaves[i])
                    np.add.at(count[i], place, times)
                for j in range(wide):
                    np.minimum.at(least[i][j], place, columns[j])
                    np.maximum.at(most[i][j], place, tops[j])
        for i, tree in enumerate(ids):
            seen = np.flatnonzero(count[i][:-1])
            ends = np.vstack([least[i][:, seen], most[i][:, seen]]).T
            frame = pd.DataFrame(ends, columns=[f"e{j}" for j in range(2 * wide)])
            frame.insert(0, "n", count[i][seen])
            frame.insert(0, "slot", seen.astype(np.int32))
            frame.insert(0, "tree", np.int32(tree))
            yield frame

    return sums


def _split_leaves(tree: dict, depth: int, last: bool, columns: np.ndarray, wide: int, found: dict, rng) -> None:
    """Close or cut the open leaves of one tree by what the rows say about them."""
    leaves, tree["open"] = tree["open"], []
    for slot, at in enumerate(leaves):
        n, least, most = found.get(slot, (0, None, None))
        tree["cover"][at], tree["path"][at] = n, depth + average_path(n)
        choice = columns[most[columns] > least[columns]] if n > 1 and not last else ()
        if not len(choice):
            continue
        chosen = int(rng.choice(choice))
        cut = rng.uniform(least[chosen], most[chosen])
        cut = cut if cut < most[chosen] else least[chosen]
        tree["feature"][at], tree["threshold"][at], tree["path"][at] = chosen, float(cut), 0.0
        for side in ("low", "high"):
            tree[side][at] = _new_leaf(tree)


def _new_leaf(tree: dict) -> int:
    at = len(tree["feature"])
    for name, value in (("feature", 0), ("threshold", 0.0), ("low", at), ("high", at), ("path", 0.0), ("cover", 0)):
        tree[name].append(value)
    tree["open"].append(at)
    return at


def _grow_by_level(
    df: DataFrame, features: list[str], key: Sequence[str], trees: int, share: float, levels: int,
    used: int, bootstrap: bool, seed: int,
) -> list[dict]:
    """Grow trees over all rows at once, a level in one pass and one small grouped aggregation.

    No row is copied or shuffled: a task looks up its rows' leaves and sends on the count and the
    value range of each. What a task and the driver hold follows leaves and columns, not rows.
    """
    wide = len(features)
    rows = stored(
        df.select(
            F.xxhash64(*[q(k) for k in key], F.lit(seed)).alias("_hash"),
            *[q(c).cast("double").alias(f"c{j}") for j, c in enumerate(features)],
        ),
        "forest-rows",
    )
    at_once = max(1, _STATE_CELLS // (2**levels * wide * 2))

    def draw(hashes, tree):
        return _times_drawn(hashes, tree, seed, share, bootstrap)

    grown: list[dict] = []
    for start in range(0, trees, at_once):
        ids = list(range(start, min(trees, start + at_once)))
        rngs = [np.random.default_rng([seed, t]) for t in ids]
        picked = [np.sort(rng.choice(wide, min(used, wide), replace=False)) for rng in rngs]
        group = [{k: [] for k in (*_CUTS, "path", "cover", "open")} for _ in ids]
        for tree in group:
            _new_leaf(tree)
        for depth in range(levels + 1):
            live = [i for i, tree in enumerate(group) if tree["open"]]
            if not live:
                break
            slots = []
            for i in live:
                slot = np.full(len(group[i]["feature"]), -1, dtype=np.int64)
                slot[group[i]["open"]] = np.arange(len(group[i]["open"]))
                slots.append(slot)
            # The leaves of the last level are counted only; none is cut.
            seen = wide if depth < levels else 0
            ends = [f"e{j}" for j in range(2 * seen)]
            schema = ", ".join(["tree int, slot int, n bigint", *(f"{e} double" for e in ends)])
            merged = [F.sum("n")] + [F.min(e) for e in ends[:seen]] + [F.max(e) for e in ends[seen:]]
            sums = _level_sums([group[i] for i in live], [ids[i] for i in live], slots, seen, draw)
            found: dict = {}
            for row in rows.mapInPandas(sums, schema).groupBy("tree", "slot").agg(*merged).collect():
                found.setdefault(row[0], {})[row[1]] = (
                    row[2], np.array(row[3:3 + seen]), np.array(row[3 + seen:]),
                )
            for i in live:
                _split_leaves(
                    group[i], depth, depth == levels, picked[i], wide, found.get(ids[i], {}), rngs[i]
                )
        grown += [{"tree": t, **{k: tree[k] for k in (*_CUTS, "path", "cover")}} for t, tree in zip(ids, group)]
    return grown


def fit_isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    n_estimators: int = 100,
    max_samples: int | float | str = "auto",
    contamination: float | str = "auto",
    max_features: float | int = 1.0,
    bootstrap: bool = False,
    seed: int = 42,
    task_sample: int = TASK_SAMPLE,
) -> IsolationForest:
    """Trees over samples chosen by hash of the unique ``key``.

    A tree over at most ``task_sample`` rows is grown by one task. Larger samples, as a share in
    ``max_samples`` asks for, are grown level by level over the distributed rows, to ``WIDE_LEVELS``
    levels: anomalies part from the rest far above, and a leaf of n rows counts as the mean path
    of n below it. Such a sample holds its size on average, each row being drawn by its own hash.
    Missing values take the higher side of every cut.

    A numeric ``contamination`` puts the cut at that quantile of the training scores.
    """
    features, count = list(features), df.count()
    size = min(256, count)
    if isinstance(max_samples, float):
        size = max(1, int(max_samples * count))
    elif isinstance(max_samples, int):
        size = min(max_samples, count)
    wide = len(features)
    used = max(1, int(max_features * wide) if isinstance(max_features, float) else max_features)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["_tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        rows = part.sort_values("_n")[features].to_numpy(float)
        if bootstrap:
            rows = rows[rng.integers(0, len(rows), len(rows))]
        columns = np.sort(rng.choice(wide, min(used, wide), replace=False))
        return pd.DataFrame([{"tree": tree, **_grow(rows, columns, rng, limit)}])

    if size > task_sample:
        levels = min(limit, WIDE_LEVELS)
        trees = _grow_by_level(
            df, features, key, n_estimators, size / count, levels, used, bootstrap, seed
        )
    else:
        dealt = _deal_rows(
            df.select(*[q(k) for k in key], *[q(c).cast("double").alias(c) for c in features if c not in key]),
            key, n_estimators, size, count, seed,
        )
        grown = dealt.groupBy("_tree").applyInPandas(build, _TREE)
        trees = [r.asDict() for r in sorted(grown.collect(), key=lambda r: r["tree"])]
    forest = IsolationForest(features, trees, size)
    if contamination == "auto":
        return forest
    # Stored once: finding an exact quantile reads the scores several times.
    scores = cut_lineage(forest.score(df).select("score"))
    offset = exact_quantiles(scores, "score", [float(contamination)])[0]
    return IsolationForest(features, trees, size, offset)


# --- histogram-based score ----------------------------------------------------------------


@dataclass(frozen=True)
class HistogramScore:
    """Per feature: lower edge, bin width and -log2(density + alpha) of every bin."""

    bins: dict[str, tuple[float, float, list[float]]]
    tol: float

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        total = F.lit(0.0)
        for column, (low, width, scores) in self.bins.items():
            n, x = len(scores), q(column).cast("double")
            table, worst = F.array(*[F.lit(s) for s in scores]), F.lit(max(scores))
            spot = F.floor((x - F.lit(low)) / F.lit(width)).cast("int")
            inside = F.element_at(table, F.least(F.greatest(spot, F.lit(0)), F.lit(n - 1)) + 1)
            high = low + width * n
            near = (x >= low - width * self.tol) & (x <= high + width * self.tol)
            total = total + F.when(near, inside).otherwise(worst)
        return df.withColumn(name, total)


def fit_hbos(
    df: DataFrame, features: Sequence[str], n_bins: int = 10, alpha: float = 0.1, tol: float = 0.5
) -> HistogramScore:
    """Equal-width histograms; a row's score adds up how rare its bins are."""
    features = list(features)
    ends = df.agg(
        *[F.struct(F.min(q(c)).cast("double"), F.max(q(c)).cast("double")) for c in features]
    ).first()
    edges = []
    for low, high in ends:
        low, high = (low, high) if high > low else (low - 0.5, high + 0.5)
        edges.append((low, (high - low) / n_bins))
    codes = []
    for i, (c, (low, width)) in enumerate(zip(features, edges)):
        spot = F.least(F.floor((q(c) - F.lit(low)) / F.lit(width)), F.lit(n_bins - 1))
        codes.append(F.lit(i * n_bins) + spot)
    counts = df.select(F.explode(F.array(*codes)).alias("code")).groupBy("code").count()
    found = {r[0]: r[1] for r in counts.collect()}
    bins = {}
    for i, (c, (low, width)) in enumerate(zip(features, edges)):
        here = [found.get(i * n_bins + b, 0) for b in range(n_bins)]
        total = sum(here)
        bins[c] = (low, width, [-math.log2(n / (total * width) + alpha) for n in here])
    return HistogramScore(bins, tol)


# --- cluster-based score ------------------------------------------------------------------


@dataclass(frozen=True)
class ClusterScore:
    features: list[str]
    centers: list[list[float]]
    sizes: list[int]
    large: list[bool]
    use_weights: bool

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Distance to the own centre, or for rows of small clusters to the nearest large one."""
        gaps = F.array(*[self._gap(c) for c in self.centers])
        large = F.array(
            *[self._gap(c) for c, wanted in zip(self.centers, self.large) if wanted]
        )
        base = df.withColumn("_gaps", gaps).withColumn("_near", F.array_min(large))
        own = F.array_position("_gaps", F.array_min("_gaps")).cast("int")
        is_large = F.element_at(F.array(*[F.lit(b) for b in self.large]), own)
        gap = F.when(is_large, F.array_min("_gaps")).otherwise(F.col("_near"))
        value = F.sqrt(gap)
        if self.use_weights:
            value = value * F.element_at(F.array(*[F.lit(s) for s in self.sizes]), own)
        return base.withColumn(name, value).drop("_gaps", "_near")

    def _gap(self, center: list[float]) -> Column:
        terms = [(q(c).cast("double") - F.lit(m)) for c, m in zip(self.features, center)]
        return sum((t * t for t in terms[1:]), terms[0] * terms[0])


def split_by_size(sizes: Sequence[int], alpha: float, beta: float) -> list[bool]:
    """Which clusters are large: the biggest holding ``alpha`` of the rows, or those before
    a size drop by ``beta``."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    total, held, cut = sum(sizes), 0, len(order)
    for rank, i in enumerate(order[:-1], start=1):
        held += sizes[i]
        following = sizes[order[rank]]
        if held >= alpha * total or (following and sizes[i] / following >= beta) or not following:
            cut = rank
            break
    return [i in order[:cut] for i in range(len(sizes))]


def fit_cblof(
    df: DataFrame,
    features: Sequence[str],
    n_clusters: int = 8,
    alpha: float = 0.9,
    beta: float = 5.0,
    use_weights: bool = False,
    seed: int = 42,
) -> ClusterScore:
    features = list(features)
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(
        df.select(*[q(c).cast("double").alias(c) for c in features])
    )
    model = KMeans(k=n_clusters, seed=seed, featuresCol="features").fit(assembled)
    sizes = [int(s) for s in model.summary.clusterSizes]
    centers = [[float(v) for v in c] for c in model.clusterCenters()]
    return ClusterScore(features, centers, sizes, split_by_size(sizes, alpha, beta), use_weights)


# --- reconstruction error -----------------------------------------------------------------


@dataclass(frozen=True)
class ReconstructionScore:
    """Distance between standardised rows and their image in a few components."""

    features: list[str]
    center: list[float]
    spread: list[float]
    components: list[list[float]]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        rows = F.array(*[q(c).cast("double") for c in self.features])
        return df.withColumn(name, _residual(self.center, self.spread, self.components)(rows))


def fit_reconstruction(df: DataFrame, features: Sequence[str], k: int = 2) -> ReconstructionScore:
    """Components are orthonormal, so the squared error is what the projection leaves of the
    squared length."""
    features = list(features)
    scaler = fit_standard(df, features)
    projection = fit_pca(scaler.transform(df), features, k)
    params = [scaler.params[c] for c in features]
    center = [p[0] + m * p[1] for p, m in zip(params, projection.means)]
    return ReconstructionScore(features, center, [p[1] for p in params], projection.components)


def reconstruction_error(
    df: DataFrame, features: Sequence[str], k: int, name: str = "score"
) -> DataFrame:
    """Rows with the score of a model fitted to them."""
    return fit_reconstruction(df, features, k).score(df, name)


# --- scores with a cut --------------------------------------------------------------------


@dataclass(frozen=True)
class CutScore:
    """A detector whose rows above a cut are anomalies."""

    features: list[str]
    detector: HistogramScore | ClusterScore | ReconstructionScore
    cut: float

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """-1 for anomalies, 1 for other rows, those without a score among them."""
        return self.detector.score(df).withColumn(name, F.when(F.col("score") > F.lit(self.cut), -1).otherwise(1))


DETECTORS = {"hbos": fit_hbos, "cblof": fit_cblof, "reconstruction": fit_reconstruction}


def fit_cut(df: DataFrame, features: Sequence[str], method: str, contamination: float = 0.1, **options) -> CutScore:
    """Fit a detector by name and cut at the quantile of its training scores."""
    features = list(features)
    detector = DETECTORS[method](df, features, **options)
    scores = cut_lineage(detector.score(df).select("score"))
    return CutScore(features, detector, exact_quantiles(scores, "score", [1 - contamination])[0])


def _residual(center: list[float], spread: list[float], components: list[list[float]]):
    @F.pandas_udf("double")
    def residual(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.asarray(components).T
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=float)
                continue
            rows = (np.vstack(batch.to_numpy()) - np.asarray(center)) / np.asarray(spread)
            left = (rows * rows).sum(axis=1) - ((rows @ weights) ** 2).sum(axis=1)
            yield pd.Series(np.sqrt(np.maximum(left, 0.0)))

    return residual
