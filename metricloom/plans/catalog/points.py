"""Threshold and anomaly record queries."""

from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators import points as p
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.registry import query

RULES = [("click", "upper", 60.0), ("r", "lower", 1.0), ("view", "upper", 75.5)]


@query(
    "point_threshold",
    f"""WITH {SQL_SAMPLES} SELECT 'point' AS type, metric, time, value, threshold, side AS threshold_type
        FROM samples JOIN (VALUES {", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in RULES)}) r(part, side, threshold)
        ON contains(metric, part) AND CASE side WHEN 'upper' THEN value > threshold ELSE value < threshold END""",
)
def point_threshold(spark, sf):
    return p.point_threshold(samples(spark, sf), RULES)


@query(
    "point_band",
    f"""WITH {SQL_SAMPLES} SELECT 'point' AS type, metric, time, value, threshold, side AS threshold_type
        FROM samples JOIN (VALUES ('click', 'lower', 2.5::DOUBLE), ('click', 'upper', 90.0::DOUBLE),
          ('view', 'lower', 3.0::DOUBLE)) r(part, side, threshold)
        ON contains(metric, part) AND CASE side WHEN 'upper' THEN value > threshold ELSE value < threshold END""",
)
def point_band(spark, sf):
    bands = {"click": {"gd": 2.5, "ld": 90.0}, "view": {"gd": 3.0}}
    return p.point_band(samples(spark, sf), bands)


@query(
    "detect_outliers",
    """SELECT epoch_us(ts) // 1000000 AS utc, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS hutc, event_id
       FROM events WHERE value > 100""",
)
def detect_outliers(spark, sf):
    flagged = F.when(q("value") > 100, -1).otherwise(1)
    scored = samples(spark, sf).withColumn("prediction", flagged)
    return p.detect_outliers(scored.withColumn("time", F.floor("time")), keep=["event_id"])


SQL_CLASSES = f"""{SQL_FAULTS}, classes AS (
      SELECT epoch_us(ts) // 1000000 AS utc, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS hutc,
        CASE WHEN value > 80 THEN 'cpu' ELSE 'mem' END AS type, event_id FROM samples WHERE value > 60)"""


def classes(spark, sf):
    kind = F.when(q("value") > 80, "cpu").when(q("value") > 60, "mem").otherwise("0")
    scored = samples(spark, sf).withColumn("prediction", kind)
    return p.detect_classes(scored.withColumn("time", F.floor("time")), keep=["event_id"])


@query("detect_classes", f"WITH {SQL_CLASSES} SELECT utc, hutc, type, event_id FROM classes")
def detect_classes(spark, sf):
    return classes(spark, sf)


@query(
    "anomaly_annotations",
    f"""WITH {SQL_CLASSES} SELECT utc * 1000 AS time_from, utc * 1000 AS time_to,
        type || '_rules_anomaly' AS tag, 'Anomalies detected with method rules, model: limits' AS text FROM classes""",
)
def anomaly_annotations(spark, sf):
    return p.anomaly_annotations(classes(spark, sf), "rules", "limits")


@query(
    "anomaly_islands",
    f"""WITH {SQL_CLASSES}, b AS (SELECT type, utc,
          CASE WHEN utc - lag(utc) OVER w <= 3600 THEN 0 ELSE 1 END AS opens FROM classes WINDOW w AS (PARTITION BY type ORDER BY utc)),
        i AS (SELECT type, utc, sum(opens) OVER (PARTITION BY type ORDER BY utc ROWS UNBOUNDED PRECEDING) AS island FROM b)
        SELECT type, CAST(island AS BIGINT) AS island, min(utc) AS time_from, max(utc) AS time_to, count(*) AS n
        FROM i GROUP BY 1, 2""",
)
def anomaly_islands(spark, sf):
    return p.anomaly_islands(classes(spark, sf), 3600)
