"""Time-bucket aggregation and pivots from long samples to wide frames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import epoch_seconds, q, row_mean, row_median, row_std, seconds_of, time_bucket
from metricloom.operators.clean import stored_range

# Predicates and metric fields of the small monitoring profiles.
# Larger profiles are a parameter: see ``MetricProfile.from_columns``.
PROFILES = {
    "load": ({"collectd_type": "load"}, ["shortterm", "midterm", "longterm"]),
    "memory": ({"collectd_type": "memory"}, ["cached", "buffered", "used", "free"]),
    "interface": ({"plugin": "interface", "collectd_type": "if_octets"}, ["tx", "rx"]),
    "packets": ({"plugin": "interface", "collectd_type": "if_packets"}, ["tx", "rx"]),
    "node_manager": (
        {"serviceMetrics": "NodeManagerMetrics"},
        [
            "ContainersLaunched",
            "ContainersCompleted",
            "ContainersFailed",
            "ContainersKilled",
            "ContainersIniting",
            "ContainersRunning",
            "AllocatedGB",
            "AllocatedContainers",
            "AvailableGB",
            "AllocatedVCores",
            "AvailableVCores",
            "ContainerLaunchDurationNumOps",
            "ContainerLaunchDurationAvgTime",
        ],
    ),
}


@dataclass(frozen=True)
class MetricProfile:
    """Which documents carry a group of metrics, and in which fields."""

    terms: dict[str, str]
    fields: list[str]

    @staticmethod
    def named(name: str) -> MetricProfile:
        return MetricProfile(*PROFILES[name])

    @staticmethod
    def from_columns(df: DataFrame, terms: dict[str, str], prefix: str = "") -> MetricProfile:
        """Every numeric column below ``prefix``; serves the profiles of many fields."""
        kinds = ("double", "float", "bigint", "int", "smallint", "tinyint")
        names = [c for c, t in df.dtypes if t in kinds and c.startswith(prefix)]
        return MetricProfile(terms, names)


@dataclass(frozen=True)
class BucketQuery:
    """One date histogram with averaged fields."""

    interval: int
    fields: list[str]
    terms: dict[str, str] = field(default_factory=dict)
    gte: float | None = None
    lte: float | None = None
    by: tuple[str, ...] = ()
    ts: str | None = None
    bounds: tuple[float, float] | None = None

    @staticmethod
    def from_json(text: str, now: float | None = None) -> BucketQuery:
        """The query a user has written as a search body: its terms, time range and one date
        histogram of averages.

        ``now`` gives the instant that times like ``now-1h`` count from. Buckets without samples
        are asked for by a ``min_doc_count`` of 0 with bounds. What has no meaning here is an error.
        """
        body = json.loads(text)
        asked = body["query"]["filtered"]
        terms = {}
        for clause in re.split(r"\s+AND\s+", asked["query"]["query_string"]["query"].strip()):
            found = re.fullmatch(r'([^\s:"]+):"([^"]*)"', clause)
            if not found:
                raise ValueError(f"not a term: {clause}")
            terms[found[1]] = found[2]
        rules = asked.get("filter", {}).get("bool", {})
        if rules.get("must_not") or len(body["aggs"]) != 1:
            raise ValueError("one aggregation, and no excluded terms, are understood")
        (histogram,) = body["aggs"].values()
        dates = histogram["date_histogram"]
        low, high = None, None
        for rule in rules.get("must", []):
            ((column, span),) = rule["range"].items()
            if column != dates["field"]:
                raise ValueError(f"a range of {column}, but buckets of {dates['field']}")
            low, high = (_instant(span[side], now) if side in span else None for side in ("gte", "lte"))
        interval = seconds_of(dates["interval"])
        if interval <= 0:
            raise ValueError(f"not an interval: {dates['interval']}")
        bounds, ends = None, dates.get("extended_bounds")
        if dates.get("min_doc_count", 0) == 0 and ends:
            bounds = (_instant(ends["min"], now), _instant(ends["max"], now))
        means = histogram.get("aggs", {})
        fields = [means[name]["avg"]["field"] for name in sorted(means)]
        return BucketQuery(interval, fields, terms, low, high, (), dates["field"], bounds)


def _instant(value: object, now: float | None) -> float:
    """Epoch seconds of epoch milliseconds, or of ``now`` and ``now-`` a duration."""
    if not isinstance(value, str) or value.isdigit():
        return int(value) / 1000
    found = re.fullmatch(r"now(?:-(\d+[smh]))?", value)
    if not found or now is None:
        raise ValueError(f"not an instant: {value}")
    return now - (seconds_of(found[1]) if found[1] else 0)


def bucket_avg(
    df: DataFrame,
    interval: int,
    fields: Sequence[str],
    time: str = "time",
    by: Sequence[str] = (),
    gte: float | None = None,
    lte: float | None = None,
) -> DataFrame:
    """Average of each field per non-empty bucket of a numeric time; inclusive range."""
    if gte is not None:
        df = df.where(q(time) >= gte)
    if lte is not None:
        df = df.where(q(time) <= lte)
    return df.groupBy(time_bucket(q(time), interval).alias("key"), *[q(c) for c in by]).agg(
        *[F.avg(q(c)).alias(c) for c in fields]
    )


def run_bucket_query(df: DataFrame, query: BucketQuery, time: str = "time") -> DataFrame:
    """Averages by bucket of the numeric ``time``, or of the query's own stored timestamp.

    With bounds, the buckets between them that hold no sample have null averages.
    """
    for name, value in query.terms.items():
        df = df.where(q(name) == value)
    if query.ts is None:
        return bucket_avg(df, query.interval, query.fields, time, query.by, query.gte, query.lte)
    df = stored_range(df, query.ts, query.gte, query.lte)
    key = time_bucket(epoch_seconds(q(query.ts)), query.interval).alias("key")
    means = df.groupBy(key, *[q(c) for c in query.by]).agg(*[F.avg(q(c)).alias(c) for c in query.fields])
    if query.bounds is None:
        return means
    low, high = (int(b // query.interval * query.interval) for b in query.bounds)
    grid = df.sparkSession.range(low, high + 1, query.interval).withColumnRenamed("id", "key")
    return grid.join(means, "key", "full")


def bucket_avg_zoned(
    df: DataFrame, fields: Sequence[str], ts: str, zone: str, unit: str = "day"
) -> DataFrame:
    """Calendar buckets of a named zone (daylight saving included), keyed by UTC instant."""
    local = F.date_trunc(unit, F.from_utc_timestamp(q(ts), zone))
    key = F.to_utc_timestamp(local, zone)
    return df.groupBy(key.alias("key")).agg(*[F.avg(q(c)).alias(c) for c in fields])


def bucket_avg_by_term(
    df: DataFrame,
    interval: int,
    term: str,
    terms: Sequence[str],
    value: str = "value",
    time: str = "time",
) -> DataFrame:
    """Average per bucket and term, one column per listed term."""
    key = time_bucket(q(time), interval).alias("key")
    return (
        df.where(q(term).isin(list(terms)))
        .groupBy(key)
        .pivot(term, list(terms))
        .agg(F.avg(q(value)))
    )


def bucket_count_filled(
    df: DataFrame, interval: int, low: int, high: int, time: str = "time"
) -> DataFrame:
    """Sample count per bucket, of the samples from ``low`` to ``high`` (both included); buckets
    that overlap the range and hold none count 0."""
    spark = df.sparkSession
    first = low // interval * interval
    grid = spark.range(first, high + 1, interval).withColumnRenamed("id", "key")
    counts = (
        df.where((q(time) >= low) & (q(time) <= high))
        .groupBy(time_bucket(q(time), interval).alias("key"))
        .agg(F.count(F.lit(1)).alias("doc_count"))
    )
    return grid.join(counts, "key", "left").withColumn(
        "doc_count", F.coalesce("doc_count", F.lit(0).cast("long"))
    )


def bucket_top_hosts(
    df: DataFrame,
    host: str = "instance",
    value: str = "value",
    time: str = "time",
    interval: int = 60,
    top: int = 10,
) -> DataFrame:
    """Hosts of each bucket by falling average, at most ``top`` per bucket."""
    means = bucket_avg(df, interval, [value], time, by=[host])
    order = Window.partitionBy("key").orderBy(q(value).desc(), q(host))
    return means.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def busiest_host_alarm(ranked: DataFrame, limit: float, value: str = "value") -> DataFrame:
    """The first host of the latest bucket, if its average reaches ``limit``."""
    latest = latest_bucket(ranked.where(F.col("rank") == 1), "key")
    return latest.where(q(value) >= limit)


def latest_bucket(df: DataFrame, key: str = "key") -> DataFrame:
    """All rows of the last bucket."""
    last = df.agg(F.max(q(key)).alias("_last"))
    return df.join(F.broadcast(last), q(key) == F.col("_last")).drop("_last")


def pivot_series(
    samples: DataFrame,
    core: Sequence[str],
    series: str = "series",
    time: str = "time",
    value: str = "value",
) -> DataFrame:
    """One row per whole second (rounded up), one column per series of the core list.

    The list is explicit, so series absent from the data still give a null column and no
    extra job looks for them. Of several samples in a second the latest is kept.
    """
    second = F.ceil(q(time)).alias("time")
    return (
        samples.where(q(series).isin(list(core)))
        .groupBy(second)
        .pivot(series, list(core))
        .agg(F.max_by(q(value), F.struct(q(time), q(value))))
    )


def pivot_positions(
    samples: DataFrame,
    core: Sequence[str],
    position: str = "pos",
    series: str = "series",
    time: str = "time",
    value: str = "value",
) -> DataFrame:
    """Series of equal length side by side; a row's time is its mean time rounded up."""
    cells = [F.max(F.when(q(series) == s, q(value))).alias(s) for s in core]
    return (
        samples.where(q(series).isin(list(core)))
        .groupBy(q(position))
        .agg(F.ceil(F.avg(q(time))).alias("time"), *cells)
    )


def core_metrics(samples: DataFrame, series: str = "series") -> DataFrame:
    """The frozen list of series, one row each."""
    return samples.select(q(series).alias("core")).distinct()


def save_core(core: DataFrame, path: str) -> None:
    core.coalesce(1).write.mode("overwrite").json(path)


def load_core(spark, path: str) -> list[str]:
    """Series names become columns, so their number is bounded by what a frame can hold."""
    return sorted(r[0] for r in spark.read.schema("core string").json(path).collect())


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(q(target)).agg(F.count(F.lit(1)).alias("n"))


def row_stats(
    df: DataFrame,
    std: dict[str, Sequence[str]] | None = None,
    mean: dict[str, Sequence[str]] | None = None,
    median: dict[str, Sequence[str]] | None = None,
    remove_filtered: bool = True,
) -> DataFrame:
    """New columns from row-wise statistics over listed columns, missing values skipped."""
    made: list[Column] = []
    used: set[str] = set()
    for table, function in ((std, row_std), (mean, row_mean), (median, row_median)):
        for name, columns in (table or {}).items():
            made.append(function([q(c) for c in columns]).alias(name))
            used.update(columns)
    kept = [c for c in df.columns if not (remove_filtered and c in used)]
    return df.select(*[q(c) for c in kept], *made)


def data_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Row count, and per column the number of values and of distinct values."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    if approximate:
        cells = [F.struct(F.lit(c).alias("column"), F.count(q(c)).alias("n"),
                          distinct(q(c)).alias("n_unique")) for c in df.columns]
        return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    # One exact pass over (column, value) pairs: counts first, so copies combine map-side.
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("v"))
                  for c in df.columns])
    )
    counts = df.select(pairs.alias("p")).groupBy("p.column", "p.v").agg(
        F.count(F.lit(1)).alias("c")
    )
    return counts.groupBy("column").agg(
        F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("n"),
        F.count("v").alias("n_unique"),
    )


def mean_normalize(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(x - mean) / (max - min) per column."""
    columns = list(columns)
    row = df.agg(
        *[
            F.struct(
                F.avg(q(c)).alias("mean"), (F.max(q(c)) - F.min(q(c))).alias("spread")
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    new = {}
    for i, c in enumerate(columns):
        mean, spread = row[f"s{i}"]
        new[c] = (q(c) - F.lit(mean)) / F.nullif(F.lit(spread).cast("double"), F.lit(0.0))
    return df.select(*[new.get(c, q(c)).alias(c) for c in df.columns])
