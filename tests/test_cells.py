"""Cells divided over several levels: exact, bounded, and in number in step with the points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.operators import cells as cl
from metricloom.operators import neighbours
from test_detectors import brute_dbscan


@pytest.fixture
def small(monkeypatch):
    """Few pivots per level, so that a thousand points need several levels."""
    for name, value in (("ROOT", 8), ("FAN", 8), ("CHUNK", 60)):
        monkeypatch.setattr(cl, name, value)


def frame(spark, x):
    columns = {f"c{i}": x[:, i] for i in range(x.shape[1])}
    return spark.createDataFrame(pd.DataFrame({"i": range(len(x)), **columns})).repartition(4), list(columns)


def clouds(dims, seed=4):
    rng = np.random.default_rng(seed)
    groups = [rng.normal(c, 0.4, (150, dims)) for c in (0, 2, 6)]
    return np.vstack([*groups, rng.uniform(-5, 10, (120, dims)), np.tile(groups[0][:1], (80, 1))])


@pytest.mark.parametrize("dims, eps", [(2, 0.4), (5, 1.2)])
def test_clusters_over_levels_equal_brute_force(spark, small, dims, eps):
    x = clouds(dims)
    df, names = frame(spark, x)
    got = neighbours.dbscan(df, names, "i", eps, 5, block_rows=12).toPandas().sort_values("i")
    assert got["cluster"].tolist() == brute_dbscan(x, eps, 5).tolist()


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_neighbours_over_levels_equal_brute_force(spark, small, metric):
    x = np.unique(clouds(3), axis=0)
    df, names = frame(spark, x)
    near = neighbours.nearest_neighbours(neighbours.merged_points(df, names, "i"), 4, metric, block_rows=12)
    got = {r.id: r.g for r in near.groupBy("id").agg(F.array_sort(F.collect_list("gap")).alias("g")).collect()}
    gaps = cl.distances(x, x, metric)
    assert len(got) == len(x)
    for i, row in enumerate(np.sort(gaps, axis=1)[:, 1:5]):
        assert np.allclose(got[i], row)


def test_cells_are_small_and_copies_do_not_count(spark, small):
    df, names = frame(spark, np.vstack([clouds(2), np.zeros((500, 2))]))
    cells = cl.Cells(neighbours.merged_points(df, names, "i"), "euclidean", 12)
    assert len(cells.kids) >= 1
    assert cells.points.groupBy("cell").count().agg(F.max("count")).first()[0] <= 24
    assert cells.points.count() == cells.points.select("id").distinct().count() == 571


def test_points_that_cannot_be_divided_are_still_compared(spark, small):
    """All equally far apart: every pivot keeps only itself."""
    x = np.eye(40) * 2
    df, names = frame(spark, x)
    near = neighbours.nearest_neighbours(neighbours.merged_points(df, names, "i"), 3, block_rows=5)
    got = near.groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("o")).collect()
    assert all(r.o == [n for n in range(5) if n != r.id][:3] for r in got) and len(got) == 40


def test_few_points(spark, small):
    for rows in (np.zeros((0, 2)), np.array([[1.0, 2.0]]), np.array([[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]])):
        schema = "i long, c0 double, c1 double"
        df = spark.createDataFrame([(n, *map(float, r)) for n, r in enumerate(rows)], schema)
        assert neighbours.dbscan(df, ["c0", "c1"], "i", 0.5, 2).count() == len(rows)
        scored = neighbours.abod_scores(df, ["c0", "c1"], "i", 3).where("score IS NOT NULL")
        # Two copies of its one neighbour give the last point a pair, and so an angle.
        assert [tuple(r) for r in scored.collect()] == ([(2, 3.0, 4.0, 0.0)] if len(rows) == 3 else [])


def test_candidates_of_a_point_do_not_grow(spark, monkeypatch):
    """On a plane, what a point is compared with stays the same from 3 000 to 24 000 points."""
    monkeypatch.setattr(cl, "ROOT", 16)
    met = []
    for count in (3_000, 24_000):
        x = np.random.default_rng(1).uniform(0, np.sqrt(count), (count, 2))
        df, names = frame(spark, x)
        cells = cl.Cells(neighbours.merged_points(df, names, "i"), "euclidean", 100, k=5)
        bounded = neighbours.bounded_points(cells)
        offered = cells.offered(bounded, F.col("near")).count() / count
        blocks = bounded.groupBy("cell").count().count() / count
        met.append((offered, blocks))
    assert met[1][0] < 1.3 * met[0][0] and met[1][1] < 1.5 * met[0][1]


def test_a_product_finds_the_same_pairs_as_distances_one_by_one():
    from metricloom.operators import cells

    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(300, 16)), rng.normal(size=(200, 16))
    b[:50] = a[:50]
    b[50:100] = a[50:100] + np.eye(16)[3]
    gaps = cells.distances(a, b)
    # Limits at which a pair lies exactly, none, and no limit.
    for limit in (0.0, 1.0, gaps[7, 9], np.where(np.arange(200) % 3, gaps[5], np.where(np.arange(200) % 2, -1.0, np.inf))):
        assert (cells.pairs_within(a, b, limit) == (gaps <= limit)).all()
    far = a * 1e200
    assert (cells.pairs_within(far, far, 1.0) == (cells.distances(far, far) <= 1.0)).all()


@pytest.mark.parametrize("dims, metric", [(16, "euclidean"), (3, "euclidean"), (16, "manhattan"), (16, "chebyshev")])
def test_nearest_pairs_are_those_of_distances_one_by_one(monkeypatch, dims, metric):
    monkeypatch.setattr(cl, "PAIRS", 500)
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3, (60, dims)).astype(float), rng.integers(0, 3, (80, dims)).astype(float)
    b[:20] = a[:20]
    others = rng.permutation(80)
    gaps = cl.distances(a, b, metric)
    limit = np.where(np.arange(60) % 3, np.inf, np.sort(gaps, axis=1)[:, 6])
    i, j, gap = cl.nearest_pairs(a, b, others, limit, 4, metric)
    want = [sorted((gaps[r, c], others[c]) for c in range(80) if gaps[r, c] <= limit[r])[:4] for r in range(60)]
    assert list(zip(i, gap, others[j])) == [(r, *w) for r in range(60) for w in want[r]]
    bounds = cl.kth_bounds(a, 3, metric)
    least = np.sort(cl.distances(a, a, metric), axis=1)[:, 3]
    assert (bounds >= least).all() and (bounds <= least + 1e-4).all()
    assert cl.block_rows_for(20_000, dims) == (cl.BLOCK_ROWS if dims < 8 else 2500)


def test_neighbours_of_points_with_many_coordinates(spark):
    x = np.random.default_rng(6).normal(size=(400, 16))
    df, names = frame(spark, x)
    near = neighbours.nearest_neighbours(neighbours.merged_points(df, names, "i"), 3)
    got = {r.id: [tuple(g) for g in r.g] for r in near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("gap", "other"))).alias("g")).collect()}
    gaps = cl.distances(x, x)
    np.fill_diagonal(gaps, np.inf)
    for i, row in enumerate(gaps):
        assert got[i] == [(row[j], j) for j in np.argsort(row, kind="stable")[:3]]
