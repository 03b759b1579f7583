"""Sorting, top-k and upsampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import q


def latest_hits(df: DataFrame, time: str, tie: Sequence[str], size: int = 0) -> DataFrame:
    """Newest first; ``size`` 0 means all."""
    ordered = df.orderBy(q(time).desc(), *[q(c) for c in tie])
    return ordered.limit(size) if size else ordered


def rank_features(
    scores: DataFrame, score: str, name: str = "feature", top: int = 30
) -> DataFrame:
    return scores.orderBy(q(score).desc(), q(name)).limit(top)


def sort_columns(df: DataFrame) -> DataFrame:
    return df.select(*[q(c) for c in sorted(df.columns)])


def resample_repeat(df: DataFrame, ts: str, times: int = 10) -> DataFrame:
    """Each row ``times`` times, its seconds field replaced by the copy's index."""
    fraction = F.unix_micros(q(ts)) % 1_000_000
    minute = F.unix_micros(F.date_trunc("minute", q(ts)))
    moment = F.timestamp_micros(minute + F.col("sub_index") * 1_000_000 + fraction)
    copies = df.withColumn("sub_index", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn(ts, moment)
