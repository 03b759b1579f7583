"""Points of a metric space in cells of bounded size, however many points there are.

Points are divided among pivots, which are points themselves (nearest wins). A cell with too many
points is divided again among pivots of its own, and so on, until all are small; a level takes
one pass over the points that are still in large cells. Whom a cell's points must be compared
with follows from the triangle inequality, from the top level down: only where a point may lie
within reach of a cell is it offered to the cells inside. No cell's number, size or content ever
comes to the driver below the first level, which has ``ROOT`` cells at most.

A cell and what is offered to it are cut into blocks (chunk of points x chunk of candidates), so no
task grows with the data even where cells cannot be divided well, as among points that are all
equally far apart; there, and only there, the number of blocks of a cell grows with the square
of its points. ``offered`` can be given a bound on its copies, beyond which it makes none; ``packs`` is
for such points.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from metricloom.functions.scalars import q
from metricloom.session import stored

BLOCK_ROWS = 1500
WIDE_ROWS, WIDE_VALUES = 16_384, 1 << 20  # most rows and numbers in a block of points with many coordinates
PAIRS = 4_000_000  # pairs that a task measures at a time
ROOT = 1024  # pivots of the first level; their coordinates go to every task
FAN = 64  # most pivots of a cell that is divided again
CHUNK = 20_000  # points that a task holds against the pivots of their cell
COPIED = 256  # numbers that a point's copies for other cells hold at most, on average
LEVELS = 7
_LEVEL_BITS, _FAN_BITS = 56, 6
_HOME = "struct<cell: long, gap: double, near: double>"


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances between two small blocks, one coordinate at a time."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = np.abs(a[:, i, None] - b[None, :, i])
        if metric == "euclidean":
            out += gap * gap
        elif metric == "manhattan":
            out += gap
        elif metric == "chebyshev":
            np.maximum(out, gap, out=out)
        else:
            raise ValueError(f"unknown metric {metric}")
    return np.sqrt(out) if metric == "euclidean" else out


def pairs_within(a: np.ndarray, b: np.ndarray, limit: float | np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """``distances(a, b) <= limit``, by one matrix product where points have many coordinates.

    Pairs that the product's rounding leaves open are measured one coordinate at a time, as there.
    """
    sides = (a * a).sum(axis=1), (b * b).sum(axis=1)
    most = sum(s.max(initial=0.0) for s in sides)
    if metric != "euclidean" or a.shape[1] < 8 or not math.isfinite(most):
        return distances(a, b, metric) <= limit
    limits = np.broadcast_to(np.asarray(limit, dtype=float), len(b))
    bounds = np.where(limits < 0, -np.inf, limits * limits)
    gap = a @ b.T
    gap *= -2
    gap += sides[0][:, None]
    gap += sides[1] - bounds
    near = gap <= 0
    slack = 16 * (a.shape[1] + 8) * np.finfo(float).eps * (most + np.where(np.isfinite(bounds), bounds, 0.0))
    i, j = np.nonzero(np.abs(gap) <= slack)
    square = np.zeros(len(i))
    for c in range(a.shape[1]):
        step = np.abs(a[i, c] - b[j, c])
        square += step * step
    near[i, j] = np.sqrt(square) <= limits[j]
    return near


def nearest_pairs(
    a: np.ndarray, b: np.ndarray, others: np.ndarray, limit: np.ndarray, k: int, metric: str = "euclidean"
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance): the ``k`` nearest rows of ``b`` no farther than each
    row's own ``limit``, nearest first, ties to the smaller of ``others``.

    Distances are those of ``distances``, but only pairs within the limit are measured one by one.
    """
    rows, columns, gaps = [], [], []
    for part in _strips(len(a), len(b)):
        j, i = np.nonzero(pairs_within(b, a[part], limit[part], metric))
        gap = _gaps(a[part], b, i, j, metric)
        order = np.lexsort((others[j], gap, i))
        i, j, gap = i[order], j[order], gap[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        rows.append(i[first] + part.start)
        columns.append(j[first])
        gaps.append(gap[first])
    return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in (rows, columns, gaps))


def kth_bounds(x: np.ndarray, k: int, metric: str = "euclidean") -> np.ndarray:
    """No less than each row's distance to its ``k``-th nearest other row, and no more but for rounding."""
    out = []
    sides = (x * x).sum(axis=1)
    most = 2 * sides.max(initial=0.0)
    by_product = metric == "euclidean" and x.shape[1] >= 8 and math.isfinite(most)
    for part in _strips(len(x), len(x)):
        if by_product:
            gap = x[part] @ x.T
            gap *= -2
            gap += sides[part, None]
            gap += sides
            # The point itself is the nearest one.
            found = np.partition(gap, k, axis=1)[:, k]
            out.append(np.sqrt(np.maximum(found, 0) + 16 * (x.shape[1] + 8) * np.finfo(float).eps * most))
        else:
            out.append(np.partition(distances(x[part], x, metric), k, axis=1)[:, k])
    return np.concatenate(out) if out else np.zeros(0)


def _strips(rows: int, width: int) -> Iterator[slice]:
    """Slices of rows that hold ``PAIRS`` pairs at most, or one row."""
    step = max(1, PAIRS // max(1, width))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def _gaps(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """``distances(a, b)[i, j]``."""
    out = np.zeros(len(i))
    for c in range(a.shape[1]):
        step = np.abs(a[i, c] - b[j, c])
        if metric == "chebyshev":
            np.maximum(out, step, out=out)
        else:
            out += step * step if metric == "euclidean" else step
    return np.sqrt(out) if metric == "euclidean" else out


def matrix(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy())


def block_rows_for(points: int, dims: int) -> int:
    """Rows of a block. Points with many coordinates are seldom ruled out: there, larger blocks send each
    point to fewer, and there are still a few dozen of them."""
    if dims < 8:
        return BLOCK_ROWS
    return max(BLOCK_ROWS, min(WIDE_ROWS, WIDE_VALUES // dims, math.ceil(points / 8)))


def _homes(x: np.ndarray, pivots: np.ndarray, metric: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest pivot, how far it is, and a bound on the distance to the ``k``-th other point."""
    near = np.full(len(x), np.inf)
    sides = (x * x).sum(axis=1), (pivots * pivots).sum(axis=1)
    if k == 0 and metric == "euclidean" and x.shape[1] >= 8 and math.isfinite(sum(s.max(initial=0.0) for s in sides)):
        # Which of two pivots at about the same distance it is does not matter, but how far it is does.
        cell = (sides[1] - 2 * (x @ pivots.T)).argmin(axis=1)
        return cell, _gaps(x, pivots, np.arange(len(x)), cell, metric), near
    gaps = distances(x, pivots, metric)
    cell = gaps.argmin(axis=1)
    gap = gaps[np.arange(len(x)), cell]
    if 0 < k < len(pivots):
        # Pivots are distinct points; a pivot at no distance is the point itself.
        least = np.partition(gaps, k, axis=1)[:, : k + 1]
        least.sort(axis=1)
        near = np.where(gap == 0, least[:, k], least[:, k - 1])
    return cell, gap, near


def _slack(limit: np.ndarray) -> np.ndarray:
    """A hair more than the bound, against rounding in the bound itself."""
    return limit * (1 + 1e-9) + 1e-12


class Cells:
    """The cells of ``points`` (id, x, w, all x different).

    ``points`` gets ``cell``, the cells it lies in from the top (``path``), the distances to their
    pivots (``gaps``) and ``near``: no less than the distance to the point's ``k``-th nearest
    other one, or infinite.
    """

    def __init__(self, points: DataFrame, metric: str, block_rows: int = BLOCK_ROWS, seed: int = 42, k: int = 0):
        self.metric, self.block_rows, self.seed, self.k = metric, block_rows, seed, k
        wanted = min(ROOT, max(1, math.ceil(points.count() / block_rows)))
        chosen = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(wanted)
        self.pivots = np.array([r[0] for r in chosen.select("x").collect()], dtype=float)
        placed = points.select("id", "x", "w", self._home()(F.col("x")).alias("_home"))
        self.points = stored(
            placed.select(
                "id", "x", "w", "_home.cell", F.array("_home.cell").alias("path"),
                F.array("_home.gap").alias("gaps"), "_home.near",
            ), "cells",
        )
        self.kids: list[DataFrame] = []
        while len(self.kids) < LEVELS and self._divide(len(self.kids)):
            pass

    def _home(self):
        pivots, metric, k = self.pivots, self.metric, self.k

        @F.pandas_udf(_HOME)
        def home(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cell, gap, near = _homes(matrix(batch), pivots, metric, k)
                yield pd.DataFrame({"cell": cell.astype("int64"), "gap": gap, "near": near})

        return home

    def _divide(self, level: int) -> bool:
        """Divide the large cells of a level; false where there are none."""
        points, metric, k = self.points, self.metric, self.k
        last = points.where(F.size("path") == level + 1)
        large = last.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * self.block_rows)
        large = stored(large.withColumn("_parts", F.ceil(F.col("_n") / CHUNK)), "large-cells")
        if not large.take(1):
            return False
        members = last.join(large, "cell")
        first = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(self.seed + level + 1)), "id")
        picked = members.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= FAN)
        picked = picked.where(F.col("_k") <= F.ceil(2 * F.col("_n") / self.block_rows))
        number = F.shiftleft(F.col("cell").bitwiseAND(F.lit((1 << _LEVEL_BITS) - 1)), _FAN_BITS) + F.col("_k") - 1
        kids = stored(picked.select("cell", (number + F.lit((level + 1) << _LEVEL_BITS)).alias("child"), "x"), "pivots")
        schema = StructType([*last.schema]).add("_child", "long").add("_gap", "double").add("_near", "double")

        def divide(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            if mine.empty:
                return pd.DataFrame({f: [] for f in schema.names})
            cell, gap, near = _homes(matrix(mine["x"]), matrix(theirs["x"]), metric, k)
            return mine.assign(_child=theirs["child"].to_numpy()[cell], _gap=gap, _near=near)[schema.names]

        divided = self._against(members, kids.join(large, "cell"), divide, schema).select(
            "id", "x", "w", F.col("_child").alias("cell"), F.array_append("path", F.col("_child")).alias("path"),
            F.array_append("gaps", F.col("_gap")).alias("gaps"), F.least("near", "_near").alias("near"),
        )
        rest = points.join(large, "cell", "left_anti").select(*divided.columns)
        self.points = stored(rest.unionByName(divided), "cells")
        self.kids.append(kids)
        return True

    @staticmethod
    def _against(rows: DataFrame, pivots: DataFrame, act: Callable, schema) -> DataFrame:
        """``act(rows, pivots)`` by cell, the rows of a cell in ``_parts`` chunks."""
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
        every = pivots.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        # New names for what may come from the same table on both sides.
        every = every.select(*[q(c).alias(c) for c in every.columns if c not in ("_n", "_parts")])
        dealt = dealt.drop("_n", "_parts")
        return dealt.groupBy("cell", "_part").cogroup(every.groupBy("cell", "_part")).applyInPandas(act, schema)

    def _limits(self, points: DataFrame, level: int, radius: Column) -> DataFrame:
        """How far from its pivot a cell of a level searches."""
        inside = points.where(F.size("path") > level)
        return inside.groupBy(F.get("path", F.lit(level)).alias("child")).agg(F.max(F.get("gaps", F.lit(level)) + radius).alias("_limit"))

    def few_offers(self, points: DataFrame, radius: Column) -> DataFrame | None:
        """``offered``, if its copies and those that ``blocks`` deals out hold a bounded number of numbers for
        each point on average; else none."""
        # Beside its coordinates a copy has about six more.
        most = max(1.0, COPIED / (6 + (len(self.pivots[0]) if len(self.pivots) else 0)))
        offered = self.offered(points, radius, most)
        if offered is None:
            return None
        rows, columns = (F.ceil(F.col(c) / self.block_rows) for c in ("_h", "_c"))
        dealt = self._sizes(points, offered).agg(F.sum(F.col("_h") * columns + F.col("_c") * rows)).first()[0] or 0
        # A cell of up to two blocks has its candidates twice.
        return offered if dealt <= 4 * most * points.count() else None

    def offered(self, points: DataFrame, radius: Column, most: float | None = None) -> DataFrame | None:
        """``points`` once for each cell (``_at``) some point of which may have them within its radius.

        None where that is more than ``most`` times a point, on average; they are counted before they are made.
        """
        limits = np.full(len(self.pivots), -1.0)
        for cell, limit in self._limits(points, 0, radius).collect():
            limits[cell] = _slack(limit)
        pivots, metric = self.pivots, self.metric

        @F.pandas_udf("array<long>")
        def within(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                hits = pairs_within(matrix(batch), pivots, limits, metric)
                yield pd.Series([np.flatnonzero(h) for h in hits])

        @F.pandas_udf("long")
        def offers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(pairs_within(matrix(batch), pivots, limits, metric).sum(axis=1))

        most = None if most is None else most * points.count()
        if most is not None and (points.agg(F.sum(offers(F.col("x")))).first()[0] or 0) > most:
            return None
        own = [c for c in points.columns if c not in ("cell", "path", "gaps", "near")]
        found = points.select(*[q(c) for c in own], F.explode(within(F.col("x"))).alias("cell"))
        found = stored(found, "offered")
        for level, kids in enumerate(self.kids, 1):
            reach = kids.join(self._limits(points, level, radius), "child")
            split = kids.select("cell").distinct()
            busy = found.join(split, "cell", "left_semi").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_parts"))
            busy = stored(busy, "busy-cells")
            schema = found.schema

            def descend(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
                if mine.empty or theirs.empty:
                    return pd.DataFrame({f: [] for f in schema.names})
                hits = pairs_within(matrix(mine["x"]), matrix(theirs["x"]), _slack(theirs["_limit"].to_numpy()), metric)
                i, j = np.nonzero(hits)
                return mine.iloc[i].assign(cell=theirs["child"].to_numpy()[j])[schema.names]

            def offers_below(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
                if mine.empty or theirs.empty:
                    return pd.DataFrame({"n": []})
                hits = pairs_within(matrix(mine["x"]), matrix(theirs["x"]), _slack(theirs["_limit"].to_numpy()), metric)
                return pd.DataFrame({"n": [hits.sum()]})

            sides = found.join(busy, "cell"), reach.join(busy, "cell")
            rest = found.join(split, "cell", "left_anti")
            if most is not None:
                below = self._against(*sides, offers_below, "n long").agg(F.sum("n")).first()[0] or 0
                if rest.count() + below > most:
                    return None
            found = stored(rest.unionByName(self._against(*sides, descend, schema)), "offered")
        return found.withColumnRenamed("cell", "_at")

    @staticmethod
    def _sizes(points: DataFrame, offered: DataFrame) -> DataFrame:
        """The points of each cell and what is offered to it."""
        sizes = points.groupBy(F.col("cell").alias("_at")).agg(F.count(F.lit(1)).alias("_h"))
        return sizes.join(offered.groupBy("_at").agg(F.count(F.lit(1)).alias("_c")), "_at")

    def blocks(
        self, points: DataFrame, radius: Column, act: Callable, schema: str, offered: DataFrame | None = None
    ) -> DataFrame:
        """Run ``act(points, candidates)`` on every block.

        ``points`` are those of these cells, with any columns added; ``radius`` bounds each
        point's search. What is ``offered`` to the cells is found, if it is not given.
        """
        offered = self.offered(points, radius) if offered is None else offered
        rows, columns = (F.ceil(F.col(c) / self.block_rows) for c in ("_h", "_c"))
        sizes = stored(self._sizes(points, offered).select("_at", rows.alias("_rows"), columns.alias("_columns")), "blocks")
        kept = [c for c in offered.columns if c != "_at"]
        zero = F.lit(0).cast("long")
        own = points.withColumn("_at", F.col("cell")).join(sizes, "_at").select(
            *[q(c) for c in kept], "_at", F.lit(0).alias("_role"), F.pmod(F.xxhash64("id"), "_rows").alias("_h"),
            F.explode(F.sequence(zero, F.col("_columns") - 1)).alias("_c"),
        )
        other = offered.join(sizes, "_at").select(
            *[q(c) for c in kept], "_at", F.lit(1).alias("_role"),
            F.explode(F.sequence(zero, F.col("_rows") - 1)).alias("_h"),
            F.pmod(F.xxhash64("id", F.lit(1)), "_columns").alias("_c"),
        )

        def run(block: pd.DataFrame) -> pd.DataFrame:
            mine, theirs = block[block["_role"] == 0], block[block["_role"] == 1]
            return act(mine.reset_index(drop=True), theirs.reset_index(drop=True))

        return own.unionByName(other).groupBy("_at", "_h", "_c").applyInPandas(run, schema)
