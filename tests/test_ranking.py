"""Global order: exactness under skew, and independence of the partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value."""
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25)])
    return values, spark.createDataFrame(pd.DataFrame({"i": range(6000), "x": values}))


def test_quantiles_are_exact_when_narrowed_down(skewed):
    values, df = skewed
    probabilities = [0.0, 0.1, 0.5, 0.55, 0.6, 0.999, 1.0]
    got = ranking.exact_quantiles(df.repartition(13), "x", probabilities, collect_limit=50)
    assert np.allclose(got, np.quantile(values, probabilities), rtol=0, atol=1e-12)


def test_quantiles_of_one_value(spark):
    df = spark.range(1000).select(F.lit(3.5).alias("x"))
    assert ranking.exact_quantiles(df, "x", [0.3], collect_limit=10) == [3.5]


def test_average_ranks(skewed):
    values, df = skewed
    got = ranking.average_ranks(df, "x", "r").toPandas().sort_values("i")
    assert np.allclose(got["r"], pd.Series(values).rank())


@pytest.mark.parametrize("descending", [False, True])
def test_running_by_group(spark, descending):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(list("ab"), 500), "k": rng.permutation(500), "v": rng.integers(0, 9, 500)})
    got = ranking.running(
        spark.createDataFrame(pdf), ["k"], {"s": F.col("v")}, ["g"], descending
    ).toPandas().sort_values("k")
    want = pdf.sort_values("k", ascending=not descending)
    want["s"] = want.groupby("g")["v"].cumsum()
    assert got["s"].tolist() == want.sort_values("k")["s"].tolist()


def test_row_numbers_of_text_and_ties(spark):
    pdf = pd.DataFrame({"a": ["x"] * 50 + ["b", "a"], "i": range(52)})
    got = ranking.row_numbers(spark.createDataFrame(pdf), ["a", "i"]).toPandas()
    want = pdf.sort_values(["a", "i"])["i"].tolist()
    assert got.sort_values("row_number")["i"].tolist() == want


def test_hash_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(3000).withColumn("c", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")))
    one = ranking.hash_ranks(df.repartition(1), ["c"], ["id"], 5)
    many = ranking.hash_ranks(df.repartition(17), ["c"], ["id"], 5)
    assert one.exceptAll(many).isEmpty()
    top = one.groupBy("c").agg(F.max("hash_rank").alias("m"), F.count("*").alias("n"),
                               F.count_distinct("hash_rank").alias("d"))
    assert top.where("m <> n OR d <> n").isEmpty()


def test_quantiles_of_all_columns_at_once(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 4000
    frame = pd.DataFrame({
        "a": rng.normal(size=n), "b": rng.integers(0, 7, n).astype(float), "c": np.full(n, 3.0),
        "d": np.where(np.arange(n) % 3 == 0, 1.5, rng.random(n)), "e": [None] * n, "f": rng.exponential(size=n),
    })
    frame.loc[::10, "a"] = np.nan
    frame.loc[:30, "f"] = np.inf
    frame.loc[31:90, "f"] = -np.inf
    df = spark.createDataFrame(frame, ", ".join(f"{c} double" for c in frame)).repartition(5)
    shares = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    monkeypatch.setattr(ranking, "_CELLS", 8)  # so that several rounds are needed
    for limit in (40, 100_000):
        got = dict(zip(frame, ranking.exact_quantiles_of(df, list(frame), shares, limit)))
        for c in frame:
            known = np.sort(frame[c].dropna().to_numpy(float))
            for share, value in zip(shares, got[c]):
                if not len(known):
                    assert np.isnan(value)
                    continue
                at = share * (len(known) - 1)
                low, high = known[int(np.floor(at))], known[int(np.ceil(at))]
                assert value == (low if low == high else pytest.approx(low + (high - low) * (at - np.floor(at))))


def test_number_of_jobs_does_not_follow_columns_or_quantiles(spark):
    df = spark.range(3000).select(*[((F.col("id") * (i + 7)) % 1009).cast("double").alias(f"c{i}") for i in range(6)])
    tracker = spark.sparkContext.statusTracker()

    def jobs(columns, shares):
        spark.sparkContext.setJobGroup(f"{columns}-{len(shares)}", "")
        ranking.exact_quantiles_of(df, [f"c{i}" for i in range(columns)], shares, 50)
        return len(tracker.getJobIdsForGroup(f"{columns}-{len(shares)}"))

    one = jobs(1, [0.5])
    assert jobs(6, [0.1, 0.25, 0.5, 0.75, 0.9]) <= one + 4


def test_rank_table_serves_all_columns(spark):
    rows = [(3.0, 5.0), (1.0, 5.0), (3.0, 5.0), (None, 1.0), (2.0, None)]
    got = ranking.average_rank_table(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1.0, 1.0), (0, 2.0, 2.0), (0, 3.0, 3.5), (1, 1.0, 1.0), (1, 5.0, 3.0)]


def test_hash_split_is_the_cut_of_hash_ranks(spark, monkeypatch):
    df = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 10 = 1 THEN 'b' WHEN id % 10 = 2 THEN NULL ELSE 'c' END AS c")
    sizes = {r[0]: r[1] for r in df.groupBy("c").count().collect()}
    wanted = {"a": 500, "b": 0, "c": sizes["c"]}
    ranks = ranking.hash_ranks(df, ["c"], ["id"], 9).collect()
    expected = sorted(r["id"] for r in ranks if r["c"] is not None and r["hash_rank"] <= wanted[r["c"]])
    everyone = sorted(r["id"] for r in ranks if r["c"] is not None)
    for bits, parts in ((16, 3), (2, 11)):
        monkeypatch.setattr(ranking, "_SPLIT_BITS", bits)
        first, rest = ranking.hash_split(df.repartition(parts), "c", ["id"], wanted, 9)
        assert first.columns == rest.columns == df.columns
        got, left = (sorted(r["id"] for r in part.collect()) for part in (first, rest))
        assert got == expected and sorted(got + left) == everyone


def test_hash_split_of_an_empty_frame(spark):
    empty = spark.createDataFrame([], "id long, c string")
    first, rest = ranking.hash_split(empty, "c", ["id"], {}, 1)
    assert first.count() == rest.count() == 0
