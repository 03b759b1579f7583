"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.session import scratch_path

# Words are runs of anything but the ASCII white space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["SPACE", "WORD", "bind", "join_copies", "missing_columns", "q", "read_table", "small_batches", "words", "written"]


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While this lasts, Python tasks are handed a few hundred rows at a time, for whole texts
    are long; the session's own setting is put back."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: no lineage, column pruning on reading."""
    path = scratch_path(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HOT_KEYS = 10_000


def join_copies(rows: DataFrame, facts: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """``rows`` with what ``facts``, one row per key, tells about their key.

    ``copies`` of ``facts`` is the number of rows of a key. Keys with more than one in ``HOT_KEYS``
    of all ``total`` rows, of which there are fewer than ``HOT_KEYS``, are sent to the rows; only the
    other rows are shuffled, and none of their keys is large.
    """
    often = F.col(copies) > total / HOT_KEYS
    hot = F.broadcast(facts.where(often).drop(copies))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(facts.where(~often).drop(copies), key))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def missing_columns(df: DataFrame, *names: str) -> None:
    """Raise for absent columns, before any work is done."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"columns missing: {absent}")
