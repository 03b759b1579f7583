"""Feature scaling, reduction, splitting and class balancing.

Fitting is one aggregation whose result is bounded by the number of columns; applying is
a projection, so scaling never shuffles rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.scalars import present, q
from metricloom.operators.ranking import exact_quantiles_of, hash_split

MAX_EXPRESSION_TERMS = 128
MAX_SINGLE_COLUMNS = 16
_STATE = "column string, center double, scale double, shift double"


@dataclass(frozen=True)
class AffineScaler:
    """(x - center) / scale + shift for each fitted column."""

    params: dict[str, tuple[float, float, float]]

    @property
    def columns(self) -> list[str]:
        return list(self.params)

    def transform(self, df: DataFrame) -> DataFrame:
        def cell(name: str) -> Column:
            if name not in self.params:
                return q(name)
            center, scale, shift = self.params[name]
            return ((q(name) - F.lit(center)) / F.lit(scale) + F.lit(shift)).alias(name)

        return df.select(*[cell(c) for c in df.columns])

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, *p) for c, p in self.params.items()]
        spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> AffineScaler | None:
        """The saved scaler, or None where none was saved."""
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return None
        rows = spark.read.schema(_STATE).parquet(path).collect()
        return AffineScaler({r[0]: (r[1], r[2], r[3]) for r in rows})


def apply_saved(df: DataFrame, path: str) -> DataFrame:
    """Scale with a saved scaler; without one the data passes unscaled."""
    scaler = AffineScaler.load(df.sparkSession, path)
    return scaler.transform(df) if scaler else df


@dataclass(frozen=True)
class _Moments:
    low: float | None
    high: float | None
    mean: float | None
    std: float | None


def _vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [q(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    names = [f"c{i}" for i in range(len(columns))]
    maker = VectorAssembler(inputCols=names, outputCol="v", handleInvalid="keep")
    return maker.transform(df.select(*cells)).select("v")


def _moments(df: DataFrame, columns: Sequence[str]) -> list:
    """Range, mean and population deviation of each column, missing values skipped.

    Many columns are summarised as vectors; only those with gaps are then done singly.
    """
    if len(columns) > MAX_SINGLE_COLUMNS:
        summary = Summarizer.metrics("count", "mean", "variance", "min", "max")
        row = _vectors(df, columns).agg(summary.summary(F.col("v")).alias("s")).first()["s"]
        found, ratio = {}, (row["count"] - 1) / row["count"] if row["count"] else 0.0
        for i, c in enumerate(columns):
            if row["count"] and not math.isnan(row["mean"][i]):
                found[c] = _Moments(
                    float(row["min"][i]), float(row["max"][i]), float(row["mean"][i]),
                    math.sqrt(float(row["variance"][i]) * ratio),
                )
        gaps = [c for c in columns if c not in found]
        for start in range(0, len(gaps), MAX_SINGLE_COLUMNS):
            part = gaps[start : start + MAX_SINGLE_COLUMNS]
            found.update(zip(part, _moments(df, part)))
        return [found[c] for c in columns]
    row = df.agg(
        *[
            F.struct(
                F.min(x).cast("double").alias("low"),
                F.max(x).cast("double").alias("high"),
                F.avg(x).alias("mean"),
                F.stddev_pop(x).alias("std"),
            ).alias(f"m{i}")
            for i, x in enumerate(present(df, c) for c in columns)
        ]
    ).first()
    return list(row)


def fit_standard(
    df: DataFrame, columns: Iterable[str], with_mean: bool = True, with_std: bool = True
) -> AffineScaler:
    """Mean 0 and population deviation 1; constant columns become 0."""
    columns = list(columns)
    params = {}
    for c, m in zip(columns, _moments(df, columns)):
        spread = m.std if m.std and m.low != m.high else 1.0
        params[c] = ((m.mean or 0.0) if with_mean else 0.0, spread if with_std else 1.0, 0.0)
    return AffineScaler(params)


def fit_minmax(
    df: DataFrame, columns: Iterable[str], low: float = 0.0, high: float = 1.0
) -> AffineScaler:
    """Range ``low``..``high``; constant columns become ``low``."""
    columns = list(columns)
    params = {}
    for c, m in zip(columns, _moments(df, columns)):
        spread = (m.high - m.low) if m.low is not None and m.high != m.low else 1.0
        params[c] = (m.low or 0.0, spread / (high - low), low)
    return AffineScaler(params)


def fit_maxabs(df: DataFrame, columns: Iterable[str]) -> AffineScaler:
    columns = list(columns)
    params = {}
    for c, m in zip(columns, _moments(df, columns)):
        params[c] = (0.0, max(abs(m.low or 0.0), abs(m.high or 0.0)) or 1.0, 0.0)
    return AffineScaler(params)


def fit_robust(
    df: DataFrame, columns: Iterable[str], low: float = 0.25, high: float = 0.75
) -> AffineScaler:
    """Median 0 and interquartile range 1, from exact quantiles."""
    columns = list(columns)
    found = exact_quantiles_of(df, columns, [low, 0.5, high])
    return AffineScaler({c: (m, (third - first) or 1.0, 0.0) for c, (first, m, third) in zip(columns, found)})


SCALERS = {
    "StandardScaler": fit_standard,
    "MinMaxScaler": fit_minmax,
    "MaxAbsScaler": fit_maxabs,
    "RobustScaler": fit_robust,
}


def scale(df: DataFrame, columns: Iterable[str], method: str, **options) -> DataFrame:
    """Fit and apply a scaler by name."""
    return SCALERS[method](df, list(columns), **options).transform(df)


def normalize_rows(df: DataFrame, columns: Sequence[str], norm: str = "l2") -> DataFrame:
    """Divide each row by its l1, l2 or max norm; zero rows stay."""
    cells = [q(c).cast("double") for c in columns]
    if norm == "max":
        size = F.greatest(*[F.abs(c) for c in cells]) if len(cells) > 1 else F.abs(cells[0])
    elif norm == "l1":
        size = sum((F.abs(c) for c in cells[1:]), F.abs(cells[0]))
    else:
        size = F.sqrt(sum((c * c for c in cells[1:]), cells[0] * cells[0]))
    base = df.withColumn("_norm", size)
    divisor = F.when(F.col("_norm") == 0, 1.0).otherwise(F.col("_norm"))
    new = [((q(c) / divisor).alias(c) if c in columns else q(c)) for c in df.columns]
    return base.select(*new)


@dataclass(frozen=True)
class QuantileScaler:
    """Map values to their position among fitted quantiles, 0 to 1."""

    grids: dict[str, list[float]]

    @property
    def columns(self) -> list[str]:
        return list(self.grids)

    def transform(self, df: DataFrame) -> DataFrame:
        new = {c: _interpolator(g)(q(c).cast("double")) for c, g in self.grids.items()}
        return df.select(*[new.get(c, q(c)).alias(c) for c in df.columns])


def _interpolator(grid: list[float]):
    points = np.asarray(grid)
    marks = np.linspace(0.0, 1.0, len(points))

    @F.pandas_udf("double")
    def position(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # On flat stretches the two directions end at either side; their mean is used.
        for x in batches:
            v = x.to_numpy()
            up = np.interp(v, points, marks)
            down = np.interp(-v, -points[::-1], -marks[::-1])
            out = 0.5 * (up - down)
            out = np.where(v <= points[0], 0.0, np.where(v >= points[-1], 1.0, out))
            yield pd.Series(np.where(np.isnan(v), np.nan, out), index=x.index)

    return position


def fit_quantile(
    df: DataFrame, columns: Iterable[str], n_quantiles: int = 1000
) -> QuantileScaler:
    """Exact quantiles on an even grid of at most ``n_quantiles`` points."""
    count = min(n_quantiles, df.count())
    grid = [i / (count - 1) for i in range(count)] if count > 1 else [0.0]
    columns = list(columns)
    return QuantileScaler(dict(zip(columns, exact_quantiles_of(df, columns, grid))))


@dataclass(frozen=True)
class PowerScaler:
    """Yeo-Johnson transform, then standardised."""

    lambdas: dict[str, float]
    standard: AffineScaler

    @property
    def columns(self) -> list[str]:
        return list(self.lambdas)

    def transform(self, df: DataFrame) -> DataFrame:
        powered = df.select(
            *[
                (yeo_johnson(q(c), self.lambdas[c]).alias(c) if c in self.lambdas else q(c))
                for c in df.columns
            ]
        )
        return self.standard.transform(powered)


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    if abs(lam - 2) < 1e-12:
        down = -F.log1p(-x)
    else:
        down = -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def _powered(x: np.ndarray, logs: np.ndarray, lam: float) -> np.ndarray:
    """``yeo_johnson`` of an array whose ``logs`` are log(1 + |x|)."""
    def part(sizes: np.ndarray, power: float) -> np.ndarray:
        return sizes if abs(power) < 1e-12 else np.expm1(power * sizes) / power

    below = x < 0
    if not below.any():
        return part(logs, lam)
    return np.where(below, -part(logs, 2 - lam), part(logs, lam))


def _merged(parts: Iterable[tuple[int, float, float, float]]) -> tuple[int, float, float, float]:
    """(values, mean, sum of squares about it, sum of signed logs) of parts taken together."""
    count, mean, squares, lift = 0, 0.0, 0.0, 0.0
    for n, m, s, up in parts:
        if n:
            gap = m - mean
            squares += s + gap * gap * count * n / (count + n)
            mean += gap * n / (count + n)
            count, lift = count + n, lift + up
    return count, mean, squares, lift


def _power_sums(df: DataFrame, columns: list[str], trials: dict[str, list[float]]) -> dict[tuple[int, int], tuple]:
    """(values, mean, sum of squares about it, sum of signed logs) for each column and candidate."""
    kinds = ["n", "mean", "squares", "lift"]
    schema = "i int, j int, n long, mean double, squares double, lift double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {(i, j): (0, 0.0, 0.0, 0.0) for i, c in enumerate(columns) for j in range(len(trials[c]))}
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for batch in batches:
                for i, c in enumerate(columns):
                    x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                    if not len(x):
                        continue
                    logs = np.log1p(np.abs(x))
                    lift = float((np.sign(x) * logs).sum())
                    for j, lam in enumerate(trials[c]):
                        y = _powered(x, logs, lam)
                        mean = float(y.mean())
                        y = y - mean  # not in place: it may be the logs themselves
                        held[i, j] = _merged([held[i, j], (len(x), mean, float(y @ y), lift)])
        cells = [[*at, *found] for at, found in held.items() if found[0]]
        if cells:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(cells, columns=["i", "j", *kinds]).astype({"i": "int32", "j": "int32"}))

    def merge(key: tuple[int, int], parts: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(over="ignore", invalid="ignore"):
            return pd.DataFrame([[*key, *_merged(parts[kinds].itertuples(index=False, name=None))]], columns=["i", "j", *kinds])

    values = df.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    found = values.mapInArrow(sums, schema).groupBy("i", "j").applyInPandas(merge, schema)
    return {(r[0], r[1]): tuple(r[2:]) for r in found.collect()}


def fit_power(df: DataFrame, columns: Iterable[str], rounds: int = 8) -> PowerScaler:
    """Each column's lambda by maximum likelihood, on a grid that closes in on the best.

    One round is one pass over all columns and candidates, whose sums tasks keep by array.
    """
    columns = list(columns)
    best = {c: 0.0 for c in columns}
    width = 4.0
    for _ in range(rounds):
        trials = {c: [best[c] + width * (i - 3) / 3 for i in range(7)] for c in columns}
        found = _power_sums(df, columns, trials)
        for i, c in enumerate(columns):
            scores = [_power_fit(lam, *found.get((i, j), (0, 0.0, 0.0, 0.0))) for j, lam in enumerate(trials[c])]
            best[c] = trials[c][int(np.argmax(scores))]
        width *= 0.4
    powered = df.select(*[yeo_johnson(q(c), best[c]).alias(c) for c in columns])
    return PowerScaler(best, fit_standard(powered, columns))


def _power_fit(lam: float, count: int, mean: float, squares: float, lift: float) -> float:
    """The log likelihood; minus infinity where there is none."""
    if not count or not squares > 0:
        return -math.inf
    fit = -count / 2 * math.log(squares / count) + (lam - 1) * lift
    return fit if math.isfinite(fit) else -math.inf


@dataclass(frozen=True)
class Projection:
    """Principal components of centred columns."""

    columns: list[str]
    means: list[float]
    components: list[list[float]]
    variance: list[float]

    def scores(self, prefix: str = "pc") -> list[Column]:
        """Projected columns: plain arithmetic, or one matrix product per batch if wide."""
        if len(self.columns) * len(self.components) > MAX_EXPRESSION_TERMS:
            rows = F.array(*[q(c).cast("double") for c in self.columns])
            image = _project(self.means, self.components)(rows)
            return [image[k].alias(f"{prefix}{k + 1}") for k in range(len(self.components))]
        out = []
        for k, weights in enumerate(self.components):
            terms = [
                (q(c).cast("double") - F.lit(m)) * F.lit(w)
                for c, m, w in zip(self.columns, self.means, weights)
            ]
            out.append(sum(terms[1:], terms[0]).alias(f"{prefix}{k + 1}"))
        return out

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        return df.select("*", *self.scores(prefix))


def _project(means: list[float], components: list[list[float]]):
    @F.pandas_udf("array<double>")
    def image(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        center, weights = np.asarray(means), np.asarray(components).T
        for batch in batches:
            rows = (np.vstack(batch.to_numpy()) - center) @ weights if len(batch) else []
            yield pd.Series(list(rows), dtype=object)

    return image


def fit_pca(df: DataFrame, columns: Iterable[str], k: int = 2) -> Projection:
    """Components with their largest weight made positive, so that signs are stable."""
    columns = list(columns)
    rows = _vectors(df, columns)
    means = [float(v) for v in rows.agg(Summarizer.mean(F.col("v"))).first()[0]]
    model = PCA(k=min(k, len(columns)), inputCol="v", outputCol="p").fit(rows)
    weights = model.pc.toArray().T
    signs = np.sign(weights[np.arange(len(weights)), np.abs(weights).argmax(axis=1)])
    return Projection(
        columns, means, (weights * signs[:, None]).tolist(), model.explainedVariance.tolist()
    )


def vector_columns(df: DataFrame, vector: str, size: int, prefix: str = "v") -> DataFrame:
    """An array column as ``size`` double columns."""
    kept = [q(c) for c in df.columns if c != vector]
    return df.select(
        *kept, *[q(vector)[i].cast("double").alias(f"{prefix}{i}") for i in range(size)]
    )


def hash_share(key: Sequence[str], seed: int) -> Column:
    """A uniform number in [0, 1) that depends only on the key and the seed."""
    return F.pmod(F.xxhash64(*[q(k) for k in key], F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)


def train_test_split(
    df: DataFrame, key: Sequence[str], test: float = 0.33, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """A split by hash: the same rows whatever the partitioning."""
    share = hash_share(key, seed)
    return df.where(share >= test), df.where(share < test)


def _class_sizes(df: DataFrame, target: str) -> dict:
    """Class counts, a number for each class of the target."""
    return {r[0]: r[1] for r in df.groupBy(q(target)).count().collect()}


def _cap_classes(
    df: DataFrame, target: str, key: Sequence[str], caps: dict, seed: int
) -> DataFrame:
    if not caps:
        return df
    capped = df.where(q(target).isin(list(caps)))
    kept, _ = hash_split(capped, target, key, caps, seed)
    rest = df.where(~F.coalesce(q(target).isin(list(caps)), F.lit(False)))
    return rest.unionByName(kept)


def undersample_majority(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    strategy: str = "not minority",
    seed: int = 42,
) -> DataFrame:
    """Cut classes to the size of the smallest one.

    ``majority`` cuts only the largest class, ``not majority`` all but the largest,
    ``not minority`` all but the smallest.
    """
    sizes = _class_sizes(df, target)
    least = min(sizes.values())
    largest = max(sizes, key=lambda c: (sizes[c], str(c)))
    chosen = {
        "majority": [largest],
        "not majority": [c for c in sizes if c != largest],
        "not minority": list(sizes),
    }[strategy]
    caps = {c: least for c in chosen if sizes[c] > least}
    return _cap_classes(df, target, key, caps, seed)


def undersample_class(
    df: DataFrame,
    target: str,
    label: object,
    key: Sequence[str],
    n: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Keep ``n`` rows of one class, a tenth of them by default; others stay whole."""
    if n is None:
        n = df.where(q(target) == label).count() // 10
    return _cap_classes(df, target, key, {label: n}, seed)


def prep_train_test(
    df: DataFrame,
    target: str,
    key: Sequence[str],
    drop: Iterable[str] = (),
    skip_classes: Iterable[str] = (),
    test: float = 0.33,
    seed: int = 42,
    balance: str | None = None,
    components: int = 0,
    method: str = "StandardScaler",
) -> tuple[DataFrame, DataFrame]:
    """Fill, select, balance, split, then scale and reduce with the training rows only."""
    from metricloom.operators.clean import drop_classes, drop_columns, fill_missing

    frame = drop_classes(drop_columns(fill_missing(df), drop), target, skip_classes)
    if balance:
        frame = undersample_majority(frame, target, key, balance, seed)
    train, test_rows = train_test_split(frame, key, test, seed)
    features = [c for c in frame.columns if c not in (*key, target)]
    scaler = SCALERS[method](train, features)
    train, test_rows = scaler.transform(train), scaler.transform(test_rows)
    if components:
        pca = fit_pca(train, features, components)
        keep = [q(c) for c in (*key, target)]
        train = train.select(*keep, *pca.scores())
        test_rows = test_rows.select(*keep, *pca.scores())
    return train, test_rows
