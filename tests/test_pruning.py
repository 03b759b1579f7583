"""Time bounds that reach the files."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from metricloom.operators.clean import stored_range
from metricloom.session import scratch_path

DAY = 86_400


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "bigint"])
def test_bounds_are_pushed_to_the_scan(spark, kind):
    path = scratch_path(spark, "times")
    at = F.col("id") * 60 if kind == "bigint" else F.timestamp_seconds(F.col("id") * 60).cast(kind)
    spark.range(10_000).select("id", at.alias("ts"), F.lit(1).alias("ts_other")).write.parquet(path)
    found = stored_range(spark.read.parquet(path), "ts", 120.0, 600.0)
    assert sorted(r.id for r in found.select("id").collect()) == list(range(2, 11))
    pushed = plan(found).split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed


def test_bounds_between_microseconds(spark):
    rows = spark.createDataFrame([(n, datetime(1970, 1, 1, 0, 0, 1, n)) for n in range(5)], "n int, ts timestamp_ntz")
    assert [r.n for r in stored_range(rows, "ts", 1.0000015, 1.0000035).collect()] == [2, 3]
    days = spark.createDataFrame([(n, date(1970, 1, n + 1)) for n in range(5)], "n int, d date")
    assert [r.n for r in stored_range(days, "d", 1.0, 3.5 * DAY).collect()] == [1, 2, 3]
    gaps = spark.createDataFrame([(1, None)], "n int, ts timestamp")
    assert stored_range(gaps, "ts").count() == 1 and stored_range(gaps, "ts", 0).count() == 0


@pytest.mark.parametrize("kind", ["date", "string"])
def test_other_days_are_not_read(spark, kind):
    path = scratch_path(spark, "days")
    ts = F.timestamp_seconds(F.col("id") * 3600)
    spark.range(240).select("id", ts.alias("ts"), F.to_date(ts).cast(kind).alias("day")).write.partitionBy("day").parquet(path)
    whole = spark.read.schema(f"id long, ts timestamp, day {kind}").parquet(path)
    found = stored_range(whole, "ts", 3 * DAY + 7200, 4 * DAY + 3600, "day")
    assert sorted(r.id for r in found.collect()) == list(range(74, 98))
    assert len({r.f for r in found.select(F.input_file_name().alias("f")).distinct().collect()}) <= 8 * 2
    filters = plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert ">=" in filters and "<=" in filters and "day" in filters
