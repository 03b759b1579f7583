"""Edge semantics on literal frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from metricloom.functions import scalars as s
from metricloom.operators import buckets, clean, joins, points, scale, sets
from metricloom.sinks import writers
from metricloom.sources import files, responses


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_row_bounds_are_strict(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "time int")
    assert rows(clean.filter_rows(df, ld=4, gd=1)) == [(2,), (3,)]
    assert rows(clean.filter_rows(df, ld=4)) == [(1,), (2,), (3,)]
    assert clean.filter_rows(df).count() == 4


def test_unknown_columns_raise(spark):
    with pytest.raises(ValueError):
        clean.filter_columns(spark.range(1), ["nope"])


def test_low_variance_keeps_all_null_and_drops_single(spark):
    df = spark.createDataFrame(
        [(1.0, None, 2.0, math.nan), (1.0, None, None, 3.0), (1.0, None, 2.0, 3.0)],
        "same double, empty double, sparse double, nans double",
    )
    assert clean.drop_low_variance(df).columns == ["empty"]


def test_missing_columns_all_and_any(spark):
    df = spark.createDataFrame([(1.0, None, None), (2.0, 1.0, None)], "a double, b double, c double")
    assert clean.drop_missing_columns(df).columns == ["a", "b"]
    assert clean.drop_missing_columns(df, "any").columns == ["a"]


def test_names_with_dots_and_colons(spark):
    name = "node_load1_10.0.0.1:9100"
    df = spark.createDataFrame([(1, 2.0), (2, None)], f"time int, `{name}` double")
    assert clean.filter_wildcard(df, "load1", keep=True).columns == [name]
    assert rows(clean.fill_missing(df)) == [(1, 2.0), (2, 0.0)]
    assert rows(scale.scale(clean.drop_null_rows(df), [name], "StandardScaler")) == [(1, 0.0)]
    assert clean.drop_columns(df, name).columns == ["time"]


def test_row_stats_of_few_values(spark):
    df = spark.createDataFrame([(1.0, None, None), (1.0, 3.0, None), (None, None, None)], "a double, b double, c double")
    names = ["a", "b", "c"]
    out = buckets.row_stats(df, {"s": names}, {"m": names}, {"d": names}).collect()
    assert [tuple(r) for r in out] == [
        (None, 1.0, 1.0), (pytest.approx(math.sqrt(2)), 2.0, 2.0), (None, None, None)
    ]
    assert buckets.row_stats(df, mean={"m": names}, remove_filtered=False).columns == [*names, "m"]


def test_population_and_constant_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "a double, b double")
    got = rows(scale.scale(df, ["a", "b"], "StandardScaler"))
    values = np.array([1.0, 2.0, 4.0])
    want = (values - values.mean()) / values.std()
    assert np.allclose([r[0] for r in got], want) and {r[1] for r in got} == {0.0}
    assert {r[1] for r in rows(scale.scale(df, ["b"], "MinMaxScaler", low=-1.0))} == {-1.0}


def test_wide_scaling_equals_narrow(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(40, 20)), columns=[f"c{i}" for i in range(20)])
    pdf.loc[3, "c5"] = np.nan
    df = spark.createDataFrame(pdf)
    wide = scale.fit_standard(df, pdf.columns).params
    narrow = scale.fit_standard(df, ["c0", "c5"]).params
    for c in ("c0", "c5"):
        assert np.allclose(wide[c], narrow[c])


def test_intervals_against_brute_force(spark):
    rng = np.random.default_rng(4)
    starts = rng.integers(-50, 400, 120)
    spans = [(int(a), int(a + w), i, f"l{i % 7}") for i, (a, w) in enumerate(zip(starts, rng.integers(0, 90, 120)))]
    times = [float(t) for t in range(-60, 500)] + [t + 0.5 for t in range(-60, 500, 3)]
    df = spark.createDataFrame([(t,) for t in times] * 2, "time double")
    intervals = spark.createDataFrame(spans, "start long, stop long, seq int, label string")
    got = {r["time"]: r["target"] for r in joins.label_intervals(df, intervals).collect()}
    for t in times:
        hits = [(i, label) for a, b, i, label in spans if a <= t <= b]
        assert got[t] == (max(hits)[1] if hits else "0"), t


def test_no_intervals(spark):
    none = spark.createDataFrame([], "start long, stop long, seq int, label string")
    assert rows(joins.label_intervals(spark.createDataFrame([(1.0,)], "time double"), none)) == [(1.0, "0")]


def test_islands_cross_days(spark):
    at = [86_000, 86_399, 86_401, 90_000, 300_000]
    df = spark.createDataFrame([("a", t) for t in at + at[:1]], "type string, utc long")
    got = rows(points.anomaly_islands(df, 1000).drop("island"))
    assert got == [("a", 86_000, 86_401, 4), ("a", 90_000, 90_000, 1), ("a", 300_000, 300_000, 1)]


def test_frames_differ_by_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "i int, s string")
    b = spark.createDataFrame([("x", 1)], "s string, i int")
    assert not sets.frame_equal(a, b).first()[0]
    assert sets.frame_equal(a.distinct(), b).first()[0]


def test_durations(spark):
    df = spark.createDataFrame([("10s",), ("5m",), ("1h",), ("7d",), ("",), ("xm",)], "t string")
    assert [r[0] for r in df.select(s.duration_seconds(F.col("t"))).collect()] == [10, 300, 3600, 0, 0, 0]
    assert [s.seconds_of(t) for t in ("10s", "5m", "1h", "7d")] == [10, 300, 3600, 0]


def test_matrix_with_series_of_several_values(spark):
    body = (
        '{"data":{"result":[{"metric":{"__name__":"load","instance":"h:1"},"values":[[1.5,"2.0"],[2.5,"NaN"]]},'
        '{"metric":{"__name__":"net","device":"eth0","instance":"h:1"},"values":[[1.7,"3"]]}]}}'
    )
    long = responses.metric_matrix(spark.createDataFrame([(body,)], "body string"))
    wide = buckets.pivot_series(long, ["load_h:1", "net_eth0_h:1", "gone"])
    assert [tuple(r) for r in wide.orderBy("time").collect()][0] == (2, 2.0, 3.0, None)


def test_dicts_and_empty_csv(spark, tmp_path):
    df = files.from_dicts(spark, [{"a": 1}, {"a": 2, "b": "x"}], "a int, b string")
    assert [tuple(r) for r in df.collect()] == [(1, None), (2, "x")]
    with pytest.raises(ValueError):
        writers.write_csv(df.where("a > 5"), str(tmp_path / "none"))


def test_arff_document(spark, tmp_path):
    df = spark.createDataFrame([("a b", 1.5), (None, None)], "kind string, x double")
    path = tmp_path / "doc"
    writers.write_arff(df, str(path), "r")
    parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines == [
        "@relation r", "@attribute kind{?,a_b}", "@attribute x real", "@data", '"a_b",1.5', "?,?"
    ]


def test_annotations_without_type(spark):
    df = spark.createDataFrame([(5,)], "utc long")
    row = points.anomaly_annotations(df, "forest", "m").first()
    assert (row["time_from"], row["tag"]) == (5000, "forest_anomaly")


def test_top_hosts_and_alarm(spark):
    df = spark.createDataFrame([(0.0, "a", 1.0), (61.0, "b", 0.05), (62.0, "c", 0.2)], "time double, instance string, value double")
    ranked = buckets.bucket_top_hosts(df)
    assert buckets.busiest_host_alarm(ranked, 0.1).first()["instance"] == "c"
    assert buckets.busiest_host_alarm(ranked, 0.3).isEmpty()
