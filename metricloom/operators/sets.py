"""Set operations on frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import filled, q


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def frame_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct first-column values found on one side only, with that side."""
    name = left.columns[0]
    a = left.select(q(name).alias("value"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = right.select(q(right.columns[0]).alias("value"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    sides = a.unionByName(b).groupBy("value").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return sides.where("l <> r").select(
        "value", F.when(F.col("l") == 1, "left").otherwise("right").alias("side")
    )


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with the surplus of copies on the left (negative: on the right).

    One aggregation over the tagged union, so copies combine before the shuffle.
    """
    columns = sorted(left.columns)
    a = left.select(*[q(c) for c in columns], F.lit(1).alias("_side"))
    b = right.select(*[q(c) for c in columns], F.lit(-1).alias("_side"))
    surplus = a.union(b).groupBy(*[q(c) for c in columns]).agg(F.sum("_side").alias("surplus"))
    return surplus.where("surplus <> 0")


def frame_equal(left: DataFrame, right: DataFrame, fill: bool = True) -> DataFrame:
    """One row: whether both hold the same rows, whatever the column order."""
    if sorted(left.columns) != sorted(right.columns):
        return left.sparkSession.range(1).select(F.lit(False).alias("equal"))
    if fill:
        left, right = filled(left, 1, "1"), filled(right, 1, "1")
    return multiset_diff(left, right).agg((F.count(F.lit(1)) == 0).alias("equal"))


