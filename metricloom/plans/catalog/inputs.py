"""Stand-ins for monitoring inputs, derived from the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.scalars import epoch_seconds, q, series_name
from metricloom.operators.buckets import bucket_avg, bucket_avg_by_term
from metricloom.operators.clean import stored_range
from metricloom.operators.scale import vector_columns

METRICS = ["click", "error", "purchase", "signup", "view"]
NODES = ["node0", "node1", "node2", "node3"]
SERIES = [f"{m}_{n}" for m in METRICS for n in NODES]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HOUR = 3600
VECTOR = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str, gte: float | None = None, lte: float | None = None) -> DataFrame:
    """Long samples: one row per event; only those of a range are read."""
    events = stored_range(table(spark, sf, "events"), "ts", gte, lte)
    metric = q("event_type")
    instance = F.concat(F.lit("node"), F.pmod(q("user_id"), F.lit(4)).cast("string"))
    none = F.lit(None).cast("string")
    return events.select(
        "event_id",
        epoch_seconds(q("ts")).alias("time"),
        q("ts").cast("timestamp").alias("ts"),
        metric.alias("metric"),
        none.alias("device"),
        instance.alias("instance"),
        series_name(metric, none, instance).alias("series"),
        "value",
    )


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly averages, one column per series, with real gaps."""
    frame = bucket_avg_by_term(samples(spark, sf), HOUR, "series", SERIES)
    return frame.withColumnRenamed("key", "time")


def host_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Long per-host frame: hourly averages of three metrics per host."""
    s = samples(spark, sf)
    fields = [
        F.avg(F.when(q("metric") == m, q("value"))).alias(m) for m in ("click", "view", "error")
    ]
    key = (F.floor(q("time") / HOUR) * HOUR).cast("long").alias("key")
    return s.groupBy(key, q("instance").alias("host")).agg(*fields)


def faults(spark: SparkSession, sf: str) -> DataFrame:
    """Each error opens ten minutes of fault; later faults overrule earlier ones."""
    errors = samples(spark, sf).where(q("metric") == "error")
    start = F.floor("time").cast("long")
    return errors.select(
        F.col("event_id").cast("string").alias("uuid"),
        start.alias("start"),
        (start + 600).alias("stop"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("fault_"), q("instance")).alias("label"),
    )


def lineitem(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Numeric matrix with a row key; whole rows are unique, their parts are not."""
    rows = table(spark, sf, "lineitem")
    # A 64-bit hash of the whole row: fine for these tables; a real source brings a key.
    key = F.xxhash64(*[q(c) for c in rows.columns]).alias("row_key")
    return rows.select(key, *[q(c) for c in (*NUMBERS, *extra)])


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return vector_columns(rows, "embedding", VECTOR)


VECTOR_COLUMNS = [f"v{i}" for i in range(VECTOR)]

# --- the same inputs in SQL -------------------------------------------------------------

SQL_SAMPLES = """samples AS (
  SELECT event_id, epoch_us(ts) / 1e6 AS time, ts, event_type AS metric,
         'node' || CAST(user_id % 4 AS VARCHAR) AS instance,
         event_type || '_node' || CAST(user_id % 4 AS VARCHAR) AS series, value
  FROM events)"""

SQL_WIDE = (
    SQL_SAMPLES
    + """, wide AS (
  SELECT CAST(floor(time / 3600) * 3600 AS BIGINT) AS time,
"""
    + ",\n".join(f"    avg(value) FILTER (WHERE series = '{s}') AS {s}" for s in SERIES)
    + "\n  FROM samples GROUP BY 1)"
)

SQL_HOSTS = (
    SQL_SAMPLES
    + """, hosts AS (
  SELECT CAST(floor(time / 3600) * 3600 AS BIGINT) AS key, instance AS host,
         avg(value) FILTER (WHERE metric = 'click') AS click,
         avg(value) FILTER (WHERE metric = 'view') AS view,
         avg(value) FILTER (WHERE metric = 'error') AS error
  FROM samples GROUP BY 1, 2)"""
)

SQL_FAULTS = (
    SQL_SAMPLES
    + """, faults AS (
  SELECT CAST(event_id AS VARCHAR) AS uuid, CAST(floor(time) AS BIGINT) AS start,
         CAST(floor(time) AS BIGINT) + 600 AS stop, event_id AS seq,
         'fault_' || instance AS label
  FROM samples WHERE metric = 'error')"""
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and never minus zero, so that both engines print the same."""
    return df.select(
        *[
            (F.round(q(c), digits) + F.lit(0.0)).alias(c) if t == "double" else q(c)
            for c, t in df.dtypes
        ]
    )


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def sql_rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f'{r6(_quoted(c), digits)} AS {_quoted(c)}' for c in columns)


def _quoted(name: str) -> str:
    return '"' + name + '"'


__all__ = [n for n in dir() if not n.startswith("_")]
