"""Points that rule out nothing of one another: exact, and without copies on disk."""

from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from metricloom import session
from metricloom.operators import cells as cl
from metricloom.operators import neighbours, packs
from test_cells import clouds, frame
from test_detectors import brute_dbscan


@pytest.fixture
def few(monkeypatch):
    """A few points make a pack, and all of them meet."""
    monkeypatch.setattr(cl, "COPIED", 0)
    monkeypatch.setattr(packs, "PACK_ROWS", 60)
    monkeypatch.setattr(cl, "PAIRS", 500)


def scattered(count, dims, seed=8):
    x = np.random.default_rng(seed).normal(size=(count, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("dims, eps", [(2, 0.4), (16, 1.9)])
def test_clusters_of_packs_equal_brute_force(spark, few, dims, eps):
    """Tight groups, whose packs are crowded, and scattered points, whose pairs are kept."""
    x = clouds(dims)
    df, names = frame(spark, x)
    got = neighbours.dbscan(df, names, "i", eps, 5, block_rows=12).toPandas().sort_values("i")
    want = brute_dbscan(x, eps, 5)
    assert got["cluster"].tolist() == want.tolist() and want.max() > 0


def test_clusters_of_scattered_points_equal_brute_force(spark, few):
    x = np.vstack([scattered(500, 16), scattered(500, 16)[:30]])
    df, names = frame(spark, x)
    for eps in (0.8, 0.9):
        got = neighbours.dbscan(df, names, "i", eps, 3, block_rows=40).toPandas().sort_values("i")
        want = brute_dbscan(x, eps, 3)
        assert got["cluster"].tolist() == want.tolist() and want.max() > 0 and want.min() < 0


def test_packs_and_offers_agree_on_odd_keys_and_points(spark, few, monkeypatch):
    """Keys that are null or come twice; points at infinity; a reach below nothing."""
    x = np.round(clouds(2), 1)
    x[5], x[6, 0], x[7] = np.inf, -np.inf, np.nan
    keys = [None if n % 17 == 0 else n % 500 for n in range(len(x))]
    rows = [(k, *map(float, r)) for k, r in zip(keys, x, strict=True)]
    df = spark.createDataFrame(rows, "i long, c0 double, c1 double").repartition(4)
    for eps in (0.3, -1.0):
        found = []
        for copied in (0, 1 << 20):
            monkeypatch.setattr(cl, "COPIED", copied)
            got = neighbours.dbscan(df, ["c0", "c1"], "i", eps, 3, block_rows=50)
            found.append(sorted(map(str, got.collect())))
        assert found[0] == found[1]


def test_rows_written_grow_with_the_points_where_none_is_ruled_out(spark, monkeypatch, tmp_path):
    """Four times the points are about four times the rows on disk, not sixteen times."""
    written = []
    for count in (500, 2000):
        folder = tmp_path / str(count)
        monkeypatch.setattr(session, "checkpoint_root", lambda spark, to=str(folder): to)
        df, names = frame(spark, scattered(count, 32))
        neighbours.dbscan(df, names, "i", 0.6, 3, block_rows=50).write.format("noop").mode("overwrite").save()
        written.append(sum(pq.read_metadata(p).num_rows for p in Path(folder).rglob("*.parquet")))
    assert written[1] < 6 * written[0]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_each_two_packs_meet_once_and_give_the_pairs_of_distances(spark, few, metric):
    x = np.vstack([scattered(150, 16), scattered(40, 16, 9) * 0.2])
    points = spark.createDataFrame([(n, [float(v) for v in r], 1, n // 20) for n, r in enumerate(x)], "id int, x array<double>, w long, cell long")
    limit = 1.1 if metric == "euclidean" else float(np.quantile(cl.distances(x, x, metric), 0.1))
    made = packs.packed(points.repartition(3), 30, metric)

    def close(batches):
        for a, b, _, _ in packs.pairs_of_batches(batches):
            for i, j in packs.close_pairs(a, b, limit, metric):
                yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(i)), b.ids.take(pa.array(j))], names=["u", "v"])

    met = packs.meetings(made)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert made.select(F.max(F.size("ids"))).first()[0] <= 30
    got = sorted(tuple(sorted(r)) for r in met.mapInArrow(close, "u int, v int").collect())
    i, j = np.nonzero(np.triu(cl.distances(x, x, metric) <= limit, 1))
    assert got == list(zip(i.tolist(), j.tolist())) and len(got) > 100


def test_a_pair_on_the_limit_is_measured_exactly():
    """Single precision cannot tell these from pairs beyond the limit."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(300, 16)), rng.normal(size=(200, 16))
    gaps = cl.distances(a, b)
    for limit in (gaps[7, 9], np.nextafter(gaps[7, 9], 0), float(np.nextafter(gaps[250, 3], 9))):
        both = []
        for x in (a, b):
            table = pd.DataFrame({"id": range(len(x)), "x": list(x), "w": 1, "cell": np.arange(len(x)) // 70})
            pack = packs._pack(pa.Table.from_pandas(table), "euclidean")
            batch = pa.RecordBatch.from_arrays([*pack.columns, pa.array([len(both)])], names=[*pack.schema.names, "pack"])
            both.append(packs.Pack(batch, 0))
        assert packs._single_slack(*both, limit, "euclidean") is not None
        near = np.zeros(gaps.shape, bool)
        for i, j in packs.close_pairs(*both, limit, "euclidean"):
            near[i, j] = True
        assert (near == (gaps <= limit)).all()
