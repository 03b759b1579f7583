"""Joins of metric frames and labelling by time intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators.clean import fill_missing
from metricloom.operators.ranking import row_numbers


def join_key(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """Inner join on ``key``; names on both sides get ``_x`` and ``_y``."""
    clash = (set(left.columns) & set(right.columns)) - {key}
    a = left.select(*[q(c).alias(f"{c}_x" if c in clash else c) for c in left.columns])
    b = right.select(*[q(c).alias(f"{c}_y" if c in clash else c) for c in right.columns])
    return a.join(b, key, "inner")


def join_chain(frames: Sequence[DataFrame], key: str = "key") -> DataFrame:
    return reduce(lambda a, b: join_key(a, b, key), frames)


def join_chain_nodes(
    df: DataFrame,
    hosts: Sequence[str],
    fields: Sequence[str],
    host: str = "host",
    key: str = "key",
    first: str = "master",
    other: str = "slave",
) -> DataFrame:
    """Per-host frames side by side, for the keys every host has.

    One aggregation of the long frame (unique per key and host) in place of a join per
    host.
    """
    names = [first] + [f"{other}{i}" for i in range(1, len(hosts))]
    cells = [
        F.max(F.when(q(host) == h, q(c))).alias(f"{c}_{name}")
        for h, name in zip(hosts, names)
        for c in fields
    ]
    present = [F.max((q(host) == h).cast("int")).alias(f"_has{i}") for i, h in enumerate(hosts)]
    grouped = df.where(q(host).isin(list(hosts))).groupBy(q(key)).agg(*cells, *present)
    for i in range(len(hosts)):
        grouped = grouped.where(F.col(f"_has{i}") == 1)
    return grouped.drop(*[f"_has{i}" for i in range(len(hosts))])


def merge_final(frames: Sequence[DataFrame], key: str = "key") -> DataFrame:
    """Chain join, columns in name order, missing values 0."""
    joined = join_chain(frames, key)
    return fill_missing(joined.select(*[q(c) for c in sorted(joined.columns)]))


def join_positional(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> DataFrame:
    """Side by side by position along an order that is unique on each side."""
    clash = set(left.columns) & set(right.columns)
    a = row_numbers(left, left_order, "_pos")
    b = row_numbers(right, right_order, "_pos")
    a = a.select("_pos", *[q(c).alias(f"{c}_x" if c in clash else c) for c in left.columns])
    b = b.select("_pos", *[q(c).alias(f"{c}_y" if c in clash else c) for c in right.columns])
    return a.join(b, "_pos", "full").withColumnRenamed("_pos", "position")


def label_intervals(
    df: DataFrame,
    intervals: DataFrame,
    time: str = "time",
    target: str = "target",
    default: object = "0",
) -> DataFrame:
    """Label rows by the last listed interval (``seq``) that holds their time.

    ``intervals`` has ``start``, ``stop`` (whole seconds, both inclusive), ``seq`` and
    ``label``. Each interval is cut into aligned power-of-two spans, at most two per size,
    and a span keeps only its highest ``seq``. A time then looks up one span per size, so
    neither many nor overlapping intervals multiply rows.

    Coordinates are doubled: 2k is second k, 2k+1 stands for all times strictly between k
    and k+1.
    """
    spans = intervals.select(
        (2 * F.col("start").cast("double").cast("long")).alias("lo"),
        (2 * F.col("stop").cast("double").cast("long") + 1).alias("hi"),
        F.struct(F.col("seq"), F.col("label")).alias("mark"),
    ).where("lo < hi")
    widest = spans.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    if widest is None:
        return df.withColumn(target, F.lit(default))
    levels = F.sequence(F.lit(0), F.lit(int(widest).bit_length()))
    steps = spans.withColumn("level", F.explode(levels)).selectExpr(
        "level",
        "mark",
        "-shiftright(-lo, level) AS first",
        "shiftright(hi, level) AS past",
    )
    ends = F.array(
        F.when(F.col("first") % 2 != 0, F.col("first")),
        F.when(F.col("past") % 2 != 0, F.col("past") - 1),
    )
    nodes = (
        steps.where("first < past")
        .withColumn("node", F.explode(ends))
        .where("node IS NOT NULL")
        .groupBy("level", "node")
        .agg(F.max("mark").alias("mark"))
    )
    # Times share few coordinates, two a second, so those are looked up and not the times.
    value = q(time).cast("double")
    spot = F.floor(value) * 2 + (value != F.floor(value)).cast("int")
    spots = df.select(spot.alias("_spot")).where("_spot IS NOT NULL").distinct()
    probes = spots.select("_spot", F.explode(levels).alias("level")).selectExpr(
        "_spot", "level", "shiftright(_spot, level) AS node"
    )
    marks = (
        probes.join(nodes, ["level", "node"]).groupBy("_spot").agg(F.max("mark").alias("_mark"))
    )
    joined = df.join(marks, spot == F.col("_spot"), "left")
    label = F.coalesce(F.col("_mark.label"), F.lit(default))
    return joined.select(*[q(c) for c in df.columns if c != target], label.alias(target))


def fault_intervals(log: DataFrame, line: str = "line") -> DataFrame:
    """Start, stop and number of modifiers per fault; the last line of a status wins."""
    at = F.col("unixtime").cast("double")
    done = F.col("status").isin("Finished", "Finised")
    return (
        log.where("uuid IS NOT NULL")
        .groupBy("uuid")
        .agg(
            F.max("anomaly").alias("anomaly"),
            F.max_by(
                F.when(F.col("status") == "Started", at),
                F.when(F.col("status") == "Started", q(line)),
            ).alias("start"),
            F.max_by(F.when(done, at), F.when(done, q(line))).alias("stop"),
            F.count(F.when(F.col("status") == "Modifier", 1)).alias("modifiers"),
        )
    )


def fault_modifiers(log: DataFrame, line: str = "line") -> DataFrame:
    """The modifier times of every fault, one row each."""
    return log.where(F.col("status") == "Modifier").select(
        "uuid", q(line), F.col("unixtime").cast("double").alias("time")
    )


def align_nearest_second(base: DataFrame, other: DataFrame, time: str = "time") -> DataFrame:
    """Values of ``other`` on the rows of ``base`` with the same time rounded up."""
    clash = (set(base.columns) & set(other.columns)) - {time}
    b = other.select(
        F.ceil(q(time)).alias("_second"),
        *[q(c).alias(f"{c}_y" if c in clash else c) for c in other.columns if c != time],
    )
    return base.join(b, F.ceil(q(time)) == F.col("_second"), "left").drop("_second")
