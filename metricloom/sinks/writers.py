"""Sinks for frames and anomaly records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.scalars import nominal_text, q, string_columns
from metricloom.operators.clean import distinct_values


def write_csv(df: DataFrame, path: str, key: str | None = None) -> None:
    """CSV with a header, the key column first; an empty frame is an error."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    if key is not None:
        df = df.select(q(key), *[q(c) for c in df.columns if c != key])
    df.write.mode("overwrite").option("header", True).csv(path)


def to_dict_rows(df: DataFrame, key: str) -> DataFrame:
    """The mapping column -> key -> value in long form, one row per cell."""
    columns = [c for c in df.columns if c != key]
    return df.unpivot([key], columns, "column", "value")


def arff_lines(
    df: DataFrame, relation: str = "metrics", clean_text: bool = True, clean_null: bool = True
) -> DataFrame:
    """An ARFF document as text rows: header rows first, then one row per data row.

    Text columns (and a column named class) are nominal and list their values, all else is
    real. Missing values are ``?``.
    """
    spark = df.sparkSession
    nominal = set(string_columns(df, exclude=())) | {
        c for c in df.columns if c in ("Class", "CLASS", "class")
    }

    def text(name: str) -> Column:
        value = q(name).cast("string")
        if name in nominal and clean_text:
            value = nominal_text(value)
        return F.coalesce(value, F.lit("?")) if clean_null else F.coalesce(value, F.lit("nan"))

    listed: dict[str, list[str]] = {name: [] for name in nominal}
    if nominal:
        # The header lists every value of the nominal columns, found in one pass.
        for name, value in distinct_values(df, {n: text(n) for n in sorted(nominal)}).collect():
            listed[name].append(value)
    header = [f"@relation {relation}"]
    for name in df.columns:
        if name not in nominal:
            header.append(f"@attribute {name} real")
            continue
        values = ",".join(sorted(listed[name])).replace("[", "").replace("]", "")
        header.append(f"@attribute {name}{{{values}}}")
    header.append("@data")
    strings = set(string_columns(df, exclude=()))

    def cell(name: str) -> Column:
        if name not in strings:
            return text(name)
        return F.when(text(name) == "?", "?").otherwise(F.concat(F.lit('"'), text(name), F.lit('"')))

    top = spark.createDataFrame([(line,) for line in header], "value string").coalesce(1)
    return top.union(df.select(F.concat_ws(",", *[cell(c) for c in df.columns]).alias("value")))


def write_arff(df: DataFrame, path: str, relation: str = "metrics") -> None:
    """Part files that, read in name order, make up the ARFF document."""
    arff_lines(df, relation).write.mode("overwrite").text(path)


def anomaly_records(
    anomalies: DataFrame,
    method: str,
    model: str,
    interval: str,
    now: Column | None = None,
) -> DataFrame:
    """Anomalies with what found them and the report time, in milliseconds."""
    stamp = F.date_format(
        F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    )
    return anomalies.select(
        "*",
        F.lit(method).alias("method"),
        F.lit(model).alias("model"),
        F.lit(interval).alias("interval"),
        stamp.alias("reporttimestamp"),
    )


def kafka_payload(records: DataFrame, key: Sequence[str] = ("method", "model")) -> DataFrame:
    """One JSON message per record, keyed so that a model's records stay in order."""
    return records.select(
        F.concat_ws("/", *[q(c) for c in key]).alias("key"),
        F.to_json(F.struct(*[q(c) for c in records.columns])).alias("value"),
    )


def write_kafka(records: DataFrame, servers: str, topic: str) -> None:
    """Needs the Kafka connector on the class path."""
    (
        kafka_payload(records)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def append_anomalies(records: DataFrame, path: str, format: str = "parquet") -> None:
    """Append records to the anomaly store."""
    records.write.mode("append").format(format).save(path)


def stage_name(detect: bool = False, stage: str | None = None) -> str:
    """Name of a stage's frame: fetched, filtered or augmented, in training or detection."""
    return "metrics" + ("_detect" if detect else "") + (f"_{stage}" if stage else "")


def stage_checkpoint(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a stage's frame and read it back, which also cuts its lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
