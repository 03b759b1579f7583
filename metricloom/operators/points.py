"""Threshold rules over samples, and anomaly records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import human_time, q
from metricloom.operators.ranking import running

# Default alarms, (metric part, side, threshold).
DEFAULT_RULES = [
    ("shortterm", "upper", 4.5),
    ("longterm", "upper", 3.0),
    ("midterm", "upper", 3.5),
    ("rx", "upper", 1e9),
    ("tx", "upper", 1e9),
    ("cached", "upper", 231313.0),
    ("buffered", "upper", 2e8),
    ("used", "upper", 1e9),
    ("free", "lower", 1e8),
]


def point_threshold(
    samples: DataFrame,
    rules: Sequence[tuple[str, str, float]],
    metric: str = "metric",
    time: str = "time",
    value: str = "value",
) -> DataFrame:
    """Samples strictly beyond a rule's threshold, for metrics whose name has its part.

    A rule is (part of name, ``upper`` or ``lower``, threshold). The rules travel with the
    plan as one bounded array, so samples are never shuffled.
    """
    if not rules:
        rules, samples = [("", "upper", 0.0)], samples.where(F.lit(False))
    table = F.array(
        *[
            F.struct(
                F.lit(part).alias("part"),
                F.lit(side).alias("side"),
                F.lit(float(limit)).alias("limit"),
            )
            for part, side, limit in rules
        ]
    )
    beyond = F.filter(
        table,
        lambda r: q(metric).contains(r["part"])
        & (
            ((r["side"] == "upper") & (q(value) > r["limit"]))
            | ((r["side"] == "lower") & (q(value) < r["limit"]))
        ),
    )
    return samples.withColumn("_rule", F.explode(beyond)).select(
        F.lit("point").alias("type"),
        q(metric).alias("metric"),
        q(time).alias("time"),
        q(value).alias("value"),
        F.col("_rule.limit").alias("threshold"),
        F.col("_rule.side").alias("threshold_type"),
    )


def point_band(
    samples: DataFrame, bands: Mapping[str, Mapping[str, float]], **names: str
) -> DataFrame:
    """Samples below ``gd`` or above ``ld`` of their metric's band."""
    rules = []
    for metric, band in bands.items():
        if "gd" in band:
            rules.append((metric, "lower", band["gd"]))
        if "ld" in band:
            rules.append((metric, "upper", band["ld"]))
    return point_threshold(samples, rules, **names)


def detect_outliers(
    scored: DataFrame,
    prediction: str = "prediction",
    time: str = "time",
    anomaly_label: int = -1,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Flagged rows as records; libraries that predict {0, 1} flag with 1, others with -1."""
    return scored.where(q(prediction) == anomaly_label).select(
        q(time).cast("long").alias("utc"),
        human_time(q(time)).alias("hutc"),
        *[q(c) for c in keep],
    )


def detect_classes(
    scored: DataFrame,
    prediction: str = "prediction",
    time: str = "time",
    normal: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows of another than the normal class, with that class as the type."""
    normal = F.lit("0") if normal is None else normal
    label = q(prediction).cast("string")
    return scored.where(label != normal).select(
        q(time).cast("long").alias("utc"),
        human_time(q(time)).alias("hutc"),
        label.alias("type"),
        *[q(c) for c in keep],
    )


def anomaly_annotations(anomalies: DataFrame, method: str, model: str) -> DataFrame:
    """One annotation per anomaly, in milliseconds, tagged by type (if any) and method."""
    at = F.col("utc").cast("long") * 1000
    kind = q("type") if "type" in anomalies.columns else F.lit(None).cast("string")
    return anomalies.select(
        at.alias("time_from"),
        at.alias("time_to"),
        F.concat_ws("_", kind, F.lit(method), F.lit("anomaly")).alias("tag"),
        F.lit(f"Anomalies detected with method {method}, model: {model}").alias("text"),
    )


def anomaly_islands(
    anomalies: DataFrame, gap: int, by: str = "type", time: str = "utc", block: int = 86_400
) -> DataFrame:
    """Merge anomalies of a type no more than ``gap`` seconds apart into one interval.

    Days are separate tasks: each looks back inside itself, and for its first anomaly at
    the last one of an earlier day, so a type that fills the data needs no single task.
    """
    moments = (
        anomalies.groupBy(q(by), q(time).cast("long").alias("at"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_day", F.floor(F.col("at") / block))
        .withColumn("_kind", F.struct(q(by)))
    )
    days = moments.groupBy("_kind", "_day").agg(F.max("at").alias("_last"))
    earlier = Window.partitionBy("_kind").orderBy("_day")
    days = days.select("_kind", "_day", F.lag("_last").over(earlier).alias("_carried"))
    inside = Window.partitionBy("_kind", "_day").orderBy("at")
    linked = moments.withColumn("_prev", F.lag("at").over(inside)).join(
        days, ["_kind", "_day"], "left"
    )
    previous = F.coalesce("_prev", "_carried")
    opens = (previous.isNull() | (F.col("at") - previous > gap)).cast("long")
    numbered = running(
        linked.select(q(by), "at", "n", "_day", opens.alias("_opens")),
        ["at"], {"island": F.col("_opens")}, [by], block="_day",
    )
    return numbered.groupBy(q(by), "island").agg(
        F.min("at").alias("time_from"),
        F.max("at").alias("time_to"),
        F.sum("n").alias("n"),
    )
