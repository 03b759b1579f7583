"""Analysis tables: correlation, rank statistics, densities and series extracts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.scalars import q
from metricloom.operators.clean import drop_null_rows
from metricloom.operators.ranking import _SAMPLE_PER_BLOCK, average_rank_table, range_search, running, with_range_block
from metricloom.operators.scale import fit_pca, fit_standard
from metricloom.session import stored

# Polynomial coefficients of Royston's 1995 approximation to the weights of
# the Shapiro-Wilk statistic, lowest power first.
_WEIGHT_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_WEIGHT_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
# Wichura's 1988 rational approximation to normal quantiles (AS 241), highest power
# first: numerator and denominator for the middle, and for the tails.
_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
     5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
)
_TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258,
     3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
_RANKS_PER_CHUNK = 65_536
_SCORE_SUMS = T.StructType(
    [T.StructField("m", T.DoubleType()), T.StructField("m2", T.DoubleType())]
)


FEW_COLUMNS = 8


def _pair_table(df: DataFrame, columns: Sequence[str], measure, lower: bool) -> DataFrame:
    """(x, y, value) of every column pair from one aggregation; ``measure`` is symmetric.

    Few columns are measured side by side. The pairs of many would be more expressions than a plan
    should have: there each row is spread into its pairs, which are grouped before the shuffle.
    """
    names = F.array(*[F.lit(c) for c in columns])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    if len(columns) <= FEW_COLUMNS:
        cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), measure(q(columns[i]), q(columns[j])).alias("value")) for i, j in pairs]
        half = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    else:
        values = F.array(*[q(c).cast("double") for c in columns])
        index = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
        spread = df.select(values.alias("_v"), F.explode(index).alias("_p")).select(
            "_p.i", "_p.j", F.col("_v")[F.col("_p.i")].alias("a"), F.col("_v")[F.col("_p.j")].alias("b")
        )
        half = spread.where("a IS NOT NULL AND b IS NOT NULL").groupBy("i", "j").agg(measure(F.col("a"), F.col("b")).alias("value"))
        # A pair without a common row has a value too, null.
        every = df.sparkSession.createDataFrame(pairs, "i int, j int")
        half = every.join(half, ["i", "j"], "left")
    if not lower:
        both = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
        half = half.select(F.inline(F.when(F.col("i") == F.col("j"), F.slice(both, 1, 1)).otherwise(both)), "value")
    return half.select(names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), "value")


def corr_pearson(df: DataFrame, columns: Sequence[str], lower: bool = False) -> DataFrame:
    """Pairwise-complete Pearson matrix."""
    return _pair_table(df, columns, F.corr, lower)


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _pair_table(df, columns, F.covar_samp, False)


def corr_spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix of average ranks, over rows complete in all columns."""
    complete = drop_null_rows(df.select(*[q(c) for c in columns]))
    ranks = stored(average_rank_table(complete, columns), "ranks")
    ranked = complete
    for i, c in enumerate(columns):
        own = ranks.where(F.col("feature") == i).select(F.col("value").alias(f"_v{i}"), F.col("rank").alias(f"_r{i}"))
        ranked = ranked.join(own, q(c).cast("double") == F.col(f"_v{i}"))
    names = [f"_r{i}" for i in range(len(columns))]
    table = _pair_table(ranked, names, F.corr, False)
    title = F.element_at(
        F.create_map(*[F.lit(v) for i, c in enumerate(columns) for v in (f"_r{i}", c)]), F.col("x")
    )
    other = F.element_at(
        F.create_map(*[F.lit(v) for i, c in enumerate(columns) for v in (f"_r{i}", c)]), F.col("y")
    )
    return table.select(title.alias("x"), other.alias("y"), "value")


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b, exact, in one row.

    Distinct (x, y) cells are cut into range blocks along y. Pairs inside a block are counted in one
    task by array. Pairs of different blocks need only the number of the block, so that cells are
    summed to (block, x), cut into range blocks along x and counted in the same way; what lies apart
    in both is counted from the sums of the block pairs. A value that is a bound has a block of its own,
    so a frequent one is in no task's way. Each step shuffles the cells once; no pairs are formed.
    """
    cells = stored(
        drop_null_rows(df.select(q(x).alias("x"), q(y).alias("y"))).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")),
        "kendall-cells",
    )
    size, total, tie_xy = cells.agg(F.count(F.lit(1)), F.sum("n"), _pairs_of("n")).first()
    if not size:
        return df.sparkSession.createDataFrame([(x, y, None)], "x string, y string, value double")
    blocks = max(8, math.ceil(size / _CELLS_PER_BLOCK))
    rows = cells.withColumn("_yblock", _own_blocks(cells, "y", blocks))
    inside, tie_y = _concordant(rows, "_yblock", "y", "x")
    sides = stored(rows.groupBy("_yblock", "x").agg(F.sum("n").alias("n")), "kendall-sides")
    sides = sides.withColumn("_xblock", _own_blocks(sides, "x", blocks))
    across, tie_x = _concordant(sides, "_xblock", "x", "_yblock")
    apart = np.array(sides.groupBy("_xblock", "_yblock").agg(F.sum("n")).collect(), dtype=np.int64)
    concordant = inside + across + concordant_pairs(apart[:, 0], apart[:, 1], apart[:, 2])
    pairs = total * (total - 1) / 2
    distinct_pairs = pairs - tie_x - tie_y + tie_xy
    spread = math.sqrt((pairs - tie_x) * (pairs - tie_y))
    value = float((2 * concordant - distinct_pairs) / spread) if spread else None
    return df.sparkSession.createDataFrame([(x, y, value)], "x string, y string, value double")


_CELLS_PER_BLOCK = 500_000
_MOST_BLOCKS = 256


def _pairs_of(n: str) -> Column:
    """Pairs inside groups of ``n``, summed without overflow."""
    count = F.col(n).cast("decimal(19,0)")
    return F.coalesce(F.sum((count * (count - 1)).cast("decimal(38,0)")), F.lit(0)).cast("double") / 2


def _own_blocks(df: DataFrame, column: str, blocks: int) -> Column:
    """A block number that grows with a column: even for the bounds themselves, odd between them.

    The bounds are values of the rows with the smallest hashes, so a frequent value is one.
    """
    blocks = min(blocks, _MOST_BLOCKS)
    sample = df.orderBy(F.xxhash64(*[q(c) for c in df.columns])).limit(_SAMPLE_PER_BLOCK * blocks).select(q(column)).collect()
    values = sorted(r[0] for r in sample if r[0] == r[0])
    bounds = sorted({values[i * len(values) // blocks] for i in range(blocks)}) if values else []
    kind = df.schema[column].dataType
    return range_search(q(column), [F.lit(b).cast(kind) for b in bounds])


def _concordant(rows: DataFrame, block: str, along: str, across: str) -> tuple[int, float]:
    """Pairs inside blocks that grow in both columns, and pairs tied in ``along``.

    A block of one value (an even one) has ties only.
    """
    ties = rows.groupBy(along).agg(F.sum("n").alias("g")).agg(_pairs_of("g")).first()[0]

    def count(part: pd.DataFrame) -> pd.DataFrame:
        found = concordant_pairs(part["a"].to_numpy(), part["b"].to_numpy(), part["n"].to_numpy())
        return pd.DataFrame({"pairs": [str(found)]})

    several = rows.where(F.col(block) % 2 == 1).select(F.col(block).alias("_at"), q(along).alias("a"), q(across).alias("b"), "n")
    counted = several.groupBy("_at").applyInPandas(count, "pairs string")
    return sum(int(r[0]) for r in counted.collect()), ties


def concordant_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> int:
    """Weighted pairs of cells of which one is smaller in both ``a`` and ``b``.

    By the bits of the ranks of the column with fewer values: two points differ first at some bit, and
    there the one with bit 0 is smaller. Among the points that agree above a bit, a running
    count of the bit-0 points along the other column gives the pairs.
    """
    codes = [np.unique(v, return_inverse=True)[1].ravel() for v in (a, b)]
    few, many = sorted(codes, key=lambda c: c.max(initial=0))
    order = np.argsort(many, kind="stable")
    few, many, n = few[order], many[order], np.asarray(n, np.int64)[order]
    pairs = 0
    for bit in range(int(few.max(initial=0)).bit_length()):
        order = np.argsort(few >> (bit + 1), kind="stable")
        shared, at, weight = few[order] >> (bit + 1), many[order], n[order]
        right = (few[order] >> bit & 1).astype(bool)
        left = np.where(right, 0, weight)
        before = np.cumsum(left) - left
        new_group = np.r_[True, shared[1:] != shared[:-1]]
        new_tie = new_group | np.r_[True, at[1:] != at[:-1]]
        # Since the start of the group, and without those at the same place.
        below = _first_of(before, new_tie) - _first_of(before, new_group)
        kind = object if float(weight.sum()) ** 2 >= 2.0**63 else np.int64
        pairs += int((below[right].astype(kind) * weight[right]).sum())
    return pairs


def _first_of(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each run's first value, in every place of the run."""
    return values[starts][np.cumsum(starts) - 1]


def corr_kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kendall matrix, lower triangle without the diagonal."""
    tables = [
        kendall_tau(df, columns[i], columns[j]) for i in range(len(columns)) for j in range(i)
    ]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def normal_quantiles(shares: np.ndarray) -> np.ndarray:
    """Standard normal quantiles of shares between 0 and 1."""
    middle = shares - 0.5
    inner = 0.180625 - middle * middle
    out = middle * np.polyval(_MIDDLE[0], inner) / np.polyval(_MIDDLE[1], inner)
    tail = np.abs(middle) > 0.425
    depth = np.sqrt(-np.log(np.minimum(shares[tail], 1 - shares[tail])))
    size = np.polyval(_TAIL[0], depth - 1.6) / np.polyval(_TAIL[1], depth - 1.6)
    for i in np.flatnonzero(depth > 5):  # shares below 1.4e-11
        size[i] = abs(NormalDist().inv_cdf(min(shares[tail][i], 1 - shares[tail][i])))
    out[tail] = np.copysign(size, middle[tail])
    return out


@F.pandas_udf(_SCORE_SUMS)
def _normal_scores(
    batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]],
) -> Iterator[pd.DataFrame]:
    """Sums of expected normal order scores, and of their squares, over a rank range."""
    for first, last, count in batches:
        lo, length = first.to_numpy(np.int64), (last - first + 1).to_numpy(np.int64)
        sums, squares = np.zeros(len(lo)), np.zeros(len(lo))
        # As many ranges at a time as hold no more ranks than the longest may.
        upto = length.cumsum()
        at = 0
        while at < len(lo):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] - length[at] + _RANKS_PER_CHUNK, "right")))
            here = length[at:end]
            starts = here.cumsum() - here
            ranks = np.repeat(lo[at:end] - starts, here) + np.arange(here.sum())
            scores = normal_quantiles((ranks - 0.375) / (np.repeat(count.to_numpy()[at:end], here) + 0.25))
            sums[at:end] = np.add.reduceat(scores, starts)
            squares[at:end] = np.add.reduceat(scores * scores, starts)
            at = end
        yield pd.DataFrame({"m": sums, "m2": squares})


def rank_shapiro(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shapiro-Wilk W per feature, highest first.

    Equal values share one row with a rank range; long ranges are cut into chunks, so no
    value is too frequent for one task.
    """
    long = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), q(c).cast("double").alias("value"))
                  for c in columns]
            )
        )
    ).where("value IS NOT NULL AND NOT isnan(value)")
    counts = stored(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), "values")
    placed = stored(
        running(
            with_range_block(counts, ["value"], "_vblock"),
            ["value"], {"upto": F.col("n")}, ["feature"], block="_vblock",
        ).drop("_vblock"),
        "placed",
    )
    moments = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("size"),
        (F.var_pop("value") * F.count(F.lit(1))).alias("ss"),
    )
    stats = {r["feature"]: r for r in moments.collect()}
    sizes = F.create_map(*[v for k, r in stats.items() for v in (F.lit(k), F.lit(r["size"]))])
    first = F.col("upto") - F.col("n") + 1
    chunks = placed.withColumn(
        "lo", F.explode(F.sequence(first, F.col("upto"), F.lit(_RANKS_PER_CHUNK)))
    ).withColumn("hi", F.least(F.col("lo") + _RANKS_PER_CHUNK - 1, F.col("upto")))
    scored = chunks.withColumn(
        "s", _normal_scores("lo", "hi", F.element_at(sizes, F.col("feature")))
    )
    sums = scored.groupBy("feature").agg(
        F.sum(F.col("s.m") * F.col("value")).alias("mx"), F.sum("s.m2").alias("m2")
    )
    size = F.element_at(sizes, F.col("feature"))
    ends = placed.groupBy("feature").agg(
        *[
            F.max(F.when((first <= rank) & (rank <= F.col("upto")), F.col("value"))).alias(name)
            for name, rank in (("x1", F.lit(1)), ("x2", F.lit(2)), ("y2", size - 1), ("y1", size))
        ]
    )
    rows = []
    for r in sums.join(ends, "feature").collect():
        size, ss = stats[r["feature"]]["size"], stats[r["feature"]]["ss"]
        rows.append((r["feature"], _shapiro_w(size, ss, r)))
    out = df.sparkSession.createDataFrame(rows, "feature string, w double")
    return out.orderBy(F.col("w").desc(), "feature")


def _shapiro_w(n: int, ss: float, r) -> float | None:
    if n < 3 or ss <= 0:
        return None
    if n == 3:
        return min((math.sqrt(0.5) * (r["y1"] - r["x1"])) ** 2 / ss, 1.0)

    def score(rank: int) -> float:
        return NormalDist().inv_cdf((rank - 0.375) / (n + 0.25))

    def curve(coefficients: tuple[float, ...]) -> float:
        return sum(c * n ** (-k / 2) for k, c in enumerate(coefficients))

    norm = math.sqrt(r["m2"])
    m1, m2 = -score(1), -score(2)
    last = curve(_WEIGHT_LAST) + m1 / norm
    rest, squares = r["mx"] - m1 * (r["y1"] - r["x1"]), r["m2"] - 2 * m1 * m1
    total, weight = last * (r["y1"] - r["x1"]), 2 * last * last
    if n > 5:
        following = curve(_WEIGHT_NEXT) + m2 / norm
        rest, squares = rest - m2 * (r["y2"] - r["x2"]), squares - 2 * m2 * m2
        total += following * (r["y2"] - r["x2"])
        weight += 2 * following * following
    total += rest / math.sqrt(squares / (1 - weight))
    return min(total * total / ss, 1.0)


def line_series(df: DataFrame, columns: Sequence[str], time: str = "time") -> DataFrame:
    return df.select(q(time), *[q(c) for c in columns]).orderBy(q(time))


def class_feature_series(
    df: DataFrame, columns: Sequence[str], target: str, time: str = "time"
) -> DataFrame:
    """Long (time, class, feature, value)."""
    return df.unpivot([time, target], list(columns), "feature", "value")


def feature_separation(
    df: DataFrame,
    columns: Sequence[str],
    anomalous: Column,
    bins: int = 50,
    first: int | None = None,
) -> DataFrame:
    """Density histograms of all features, or of the ``first``, normal and anomalous rows apart.

    Each group has its own range; the last bin includes its upper edge, and a group
    without spread gets the range value -0.5 .. value +0.5.
    """
    names = list(columns)[:first]
    long = df.withColumn("anomaly", anomalous).unpivot(["anomaly"], names, "feature", "value")
    long = long.where("value IS NOT NULL")
    ranges = long.groupBy("anomaly", "feature").agg(
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.count(F.lit(1)).alias("size"),
    )
    flat = F.col("low") == F.col("high")
    ranges = ranges.select(
        "anomaly", "feature", "size",
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )
    # Two groups of features at most: as many rows as the frame has columns, twice.
    placed = long.join(F.broadcast(ranges), ["anomaly", "feature"])
    width = (F.col("high") - F.col("low")) / bins
    spot = F.least(F.floor((F.col("value") - F.col("low")) / width), F.lit(bins - 1))
    return (
        placed.groupBy("anomaly", "feature", "low", "high", "size", spot.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("anomaly", "feature", "bin", "n", (F.col("n") / (F.col("size") * width)).alias("density"))
    )


def pca_projection(
    df: DataFrame, columns: Sequence[str], target: str, k: int = 2
) -> DataFrame:
    """Scaled features projected on ``k`` components, with the class."""
    scaled = fit_standard(df, columns).transform(df)
    return fit_pca(scaled, columns, k).transform(scaled).select(
        q(target), *[f"pc{i + 1}" for i in range(k)]
    )
