"""Streaming queries: files as a stream, drained into the shared folder and read back."""

import math

from pyspark.sql import functions as F

from metricloom.functions.scalars import epoch_seconds, q, series_name
from metricloom.operators.outliers import fit_isolation_forest
from metricloom.operators.points import detect_outliers
from metricloom.plans import runs, stream_runs
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.learning import TARGET, rows_of
from metricloom.plans.catalog.points import RULES
from metricloom.plans.catalog.registry import ORACLES, query
from metricloom.session import scratch_path
from metricloom.sources import polled
from metricloom.streaming import streams as st


TASK_ROWS = 500_000


def live(spark, sf):
    """Samples as they arrive. Watermarks need an instant, so the zone-less time is cast."""
    raw = st.read_files(spark, sf, table(spark, sf, "events").schema, "events.parquet")
    ts = q("ts").cast("timestamp")
    instance = F.concat(F.lit("node"), F.pmod(q("user_id"), F.lit(4)).cast("string"))
    none = F.lit(None).cast("string")
    return raw.select(
        "event_id", ts.alias("ts"), epoch_seconds(ts).alias("time"), q("event_type").alias("metric"),
        instance.alias("instance"), series_name(q("event_type"), none, instance).alias("series"), "value",
    )


def drained(spark, stream, label):
    return st.drain(stream, scratch_path(spark, label))


CLOSED = "(SELECT max(epoch_us(ts)) - 600000000 FROM events)"


@query(
    "stream_metrics",
    f"WITH {SQL_SAMPLES} SELECT DISTINCT metric, instance, series, time, value FROM samples",
)
def stream_metrics(spark, sf):
    # The samples as a store has recorded them, polled every two hours for the last four.
    s = samples(spark, sf)
    folder = scratch_path(spark, "responses")
    polled.record_responses(s, folder, 6 * HOUR)
    origin = s.agg(F.floor(F.min("time") / (6 * HOUR)) * (6 * HOUR)).first()[0]
    polls = polled.read_polls(spark, polled.RecordedResponses(folder, 6 * HOUR), "4h", "2h", origin)
    once = st.stream_dedup(polled.polled_samples(polls), "5 hours")
    return drained(spark, once.select("metric", "instance", "series", "time", "value"), "stream-metrics")


@query(
    "stream_bucket_avg",
    f"""WITH {SQL_SAMPLES}, w AS (SELECT CAST(floor(time / 900) * 900 AS BIGINT) - 900 * k AS start, metric, value
          FROM samples, (SELECT unnest([0, 1, 2, 3]) AS k))
        SELECT start, start + 3600 AS stop, metric, {r6("avg(value)")} AS value FROM w
        WHERE (start + 3600) * 1000000 <= {CLOSED} GROUP BY 1, 2, 3""",
)
def stream_bucket_avg(spark, sf):
    means = st.stream_bucket_avg(live(spark, sf), "1 hour", "15 minutes", "10 minutes", ["metric"])
    return rounded(drained(spark, means, "stream-avg"))


@query("stream_point", ORACLES["point_threshold"])
def stream_point(spark, sf):
    return drained(spark, st.stream_points(live(spark, sf), RULES), "stream-point")


@query("stream_dedup", f"WITH {SQL_SAMPLES} SELECT event_id, series, time, value FROM samples")
def stream_dedup(spark, sf):
    # Every sample arrives twice, as from overlapping look-backs.
    twice = live(spark, sf).withColumn("poll", F.explode(F.array(F.lit(0), F.lit(1))))
    once = st.stream_dedup(twice, "10 minutes").select("event_id", "series", "time", "value")
    return drained(spark, once, "stream-dedup")


ALARM = 40

SQL_ALARMS = f"""{SQL_SAMPLES}, alarms AS (SELECT metric AS type, instance, epoch_us(ts) AS us FROM samples WHERE value > {ALARM}),
    closed AS (SELECT max(us) - 600000000 AS us FROM alarms)"""


@query(
    "stream_sessions",
    f"""WITH {SQL_ALARMS}, b AS (SELECT type, us, CASE WHEN us - lag(us) OVER w < 1800000000 THEN 0 ELSE 1 END AS opens
          FROM alarms WINDOW w AS (PARTITION BY type ORDER BY us)),
        i AS (SELECT type, us, sum(opens) OVER (PARTITION BY type ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM b)
        SELECT type, min(us) AS start_us, max(us) + 1800000000 AS stop_us, count(*) AS n FROM i
        GROUP BY type, island HAVING max(us) + 1800000000 <= (SELECT us FROM closed)""",
)
def stream_sessions(spark, sf):
    alarms = live(spark, sf).where(q("value") > ALARM).withColumn("type", q("metric"))
    return drained(spark, st.stream_sessions(alarms, "30 minutes", "10 minutes"), "stream-sessions")


@query(
    "stream_throttle",
    f"""WITH RECURSIVE {SQL_ALARMS}, ticks AS (SELECT DISTINCT instance AS watch, us // 60000000 * 60 + 60 AS tick FROM alarms),
        f AS (SELECT watch, min(tick) AS fired FROM ticks GROUP BY 1
          UNION ALL SELECT watch, fired FROM (SELECT f.watch, (SELECT min(t.tick) FROM ticks t WHERE t.watch = f.watch AND t.tick >= f.fired + 1800) AS fired FROM f)
            WHERE fired IS NOT NULL)
        SELECT watch, CAST(fired AS BIGINT) AS fired FROM f""",
)
def stream_throttle(spark, sf):
    alarms = table(spark, sf, "events").where(q("value") > ALARM).select(q("ts").cast("timestamp").alias("ts"), "user_id")
    folder = scratch_path(spark, "alarms")
    # Three polls; each brings the last minutes of the time before it late. The end of the last poll
    # is a row without a node, an hour on.
    first, last = alarms.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    place = (F.unix_seconds("ts") - F.pmod(q("user_id"), F.lit(300)) - F.lit(first)) * 3 / F.lit(last - first + 1)
    poll = F.greatest(F.lit(0), F.floor(place)).cast("int")
    for number in range(3):
        alarms.where(poll == number).coalesce(1).write.mode("append").parquet(folder)
    end = spark.range(1).select(F.timestamp_seconds(F.lit(last + 3600)).alias("ts"), F.lit(None).cast("long").alias("user_id"))
    end.write.mode("append").parquet(folder)
    arriving = st.read_files(st.stateful_session(spark), folder, alarms.schema, "*.parquet", files=1)
    node = F.concat(F.lit("node"), F.pmod(q("user_id"), F.lit(4)).cast("string"))
    fired = st.stream_throttle(arriving, node, 1800, "1 minute", "10 minutes")
    path = scratch_path(spark, "stream-throttle")
    st.drain(fired, path)
    return spark.read.schema(fired.schema).parquet(path).where(q("watch").isNotNull())


@query("stream_detect")
def stream_detect(spark, sf):
    rows = lineitem(spark, sf)
    forest = fit_isolation_forest(rows, NUMBERS, ["row_key"], 25, contamination=0.02)
    schema = table(spark, sf, "lineitem").schema
    raw = st.read_files(spark, sf, schema, "lineitem.parquet")
    key = F.xxhash64(*[q(c) for c in schema.names])
    arriving = raw.select(
        key.alias("row_key"), F.unix_seconds(q("l_shipdate").cast("timestamp")).alias("time"),
        *[q(c) for c in NUMBERS],
    )
    found = detect_outliers(forest.predict(arriving), keep=["row_key"])
    return drained(spark, found, "stream-detect")


@query("stream_detect_classes", "SELECT count(*) > 0 AS found, 0 AS missing, 0 AS extra FROM lineitem")
def stream_detect_classes(spark, sf):
    """The class records of a stream in three micro-batches against those of the whole table."""
    rows = rows_of(spark, sf).withColumn("time", F.pmod(q("row_key"), F.lit(2_000_000_000))).drop("row_key")
    spec = runs.RunSpec(scratch_path(spark, "run"), method="decision_tree", target=TARGET, scaler="StandardScaler", options={"maxDepth": 4})
    runs.train(rows, spec)
    rows = rows.drop(TARGET)
    folder, path = scratch_path(spark, "rows"), scratch_path(spark, "records")
    # Three micro-batches of as many files as bound what a task writes.
    files = max(1, math.ceil(rows.count() / (3 * TASK_ROWS)))
    rows.repartition(3 * files).write.parquet(folder)
    arriving = st.read_files(spark, folder, rows.schema, "*.parquet", files=files)
    stream_runs.detect_stream(arriving, stream_runs.Detection(spec, path)).awaitTermination()
    ours = ["utc", "hutc", "type", "method", "model", "interval"]
    streamed, whole = stream_runs.detections(spark, path).select(ours), runs.detect(rows, spec).select(ours)
    both = whole.withColumn("side", F.lit(1)).unionByName(streamed.withColumn("side", F.lit(-1)))
    # Hardly a record equals another, so grouping before the shuffle would hold all records of a task:
    # they are dealt first, a bounded number to a task.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(both.count() / TASK_ROWS))
    more = both.repartition(parts, *ours).groupBy(*ours).agg(F.sum("side").alias("more"))
    side = lambda sign: F.sum(F.greatest(F.lit(sign) * q("more"), F.lit(0))).cast("int")
    return more.agg((F.count(F.lit(1)) > 0).alias("found"), side(1).alias("missing"), side(-1).alias("extra"))


@query("training_run")
def training_run(spark, sf):
    spec = runs.RunSpec(
        scratch_path(spark, "run"), scaler="StandardScaler", checkpoint=True,
        options={"n_estimators": 25, "contamination": 0.05},
    )
    return runs.train(wide(spark, sf), spec)


@query("detection_run")
def detection_run(spark, sf):
    spec = runs.RunSpec(
        scratch_path(spark, "run"), scaler="MinMaxScaler",
        options={"n_estimators": 25, "contamination": 0.05},
    )
    frame = wide(spark, sf)
    runs.train(frame, spec)
    return runs.detect(frame, spec)
