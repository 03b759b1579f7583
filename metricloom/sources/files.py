"""Tabular files and in-memory records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.scalars import q


def read_csv(
    spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV files with a header line; a folder, a glob or a list of them.

    Give a schema where it is known: inference reads the files twice.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(paths)


def read_metrics(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Any columnar or text format Spark reads."""
    return spark.read.format(format).options(**options).load(path)


def from_dicts(
    spark: SparkSession, rows: Iterable[Mapping[str, object]], schema: T.StructType | str
) -> DataFrame:
    """Driver-side records, for hand-made inputs."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame([[r.get(f) for f in wanted.names] for r in rows], wanted)


def from_maps(df: DataFrame, column: str, schema: Mapping[str, str]) -> DataFrame:
    """Distributed records: a map column as typed columns; absent keys are null."""
    cells = [
        F.try_element_at(q(column), F.lit(k)).try_cast(t).alias(k) for k, t in schema.items()
    ]
    return df.select(*[q(c) for c in df.columns if c != column], *cells)
