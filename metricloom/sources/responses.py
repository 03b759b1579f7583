"""JSON responses of metric stores, one document per row of a text column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.scalars import q, series_name

_MATRIX = "data struct<result: array<struct<metric: map<string,string>, values: array<array<string>>>>>"


def read_json_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, so that a document may span lines."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def metric_matrix(responses: DataFrame, body: str = "body") -> DataFrame:
    """Range-vector responses as long samples (time, pos, metric, device, instance, series, value).

    Values arrive as text and are cast here.
    """
    kept = [q(c) for c in responses.columns if c != body]
    series = responses.select(
        *kept, F.explode(F.from_json(q(body), _MATRIX)["data"]["result"]).alias("_s")
    )
    points = series.select(
        *kept, F.col("_s.metric").alias("_m"), F.posexplode("_s.values").alias("pos", "_v")
    )
    name, device, instance = (
        F.try_element_at("_m", F.lit(k)) for k in ("__name__", "device", "instance")
    )
    return points.select(
        *kept,
        F.col("_v")[0].cast("double").alias("time"),
        "pos",
        name.alias("metric"),
        device.alias("device"),
        instance.alias("instance"),
        series_name(name, device, instance).alias("series"),
        F.col("_v")[1].try_cast("double").alias("value"),
    )


def documents(
    responses: DataFrame,
    schema: str,
    fields: Sequence[str] | None = None,
    body: str = "body",
) -> DataFrame:
    """Search hits as rows of their ``_source``; ``fields`` keeps only those listed."""
    shape = f"hits struct<hits: array<struct<_source: struct<{schema}>>>>"
    hits = responses.select(F.explode(F.from_json(q(body), shape)["hits"]["hits"]).alias("hit"))
    rows = hits.select("hit._source.*")
    return rows.select(*[q(c) for c in fields]) if fields else rows


def bucket_response(
    responses: DataFrame, agg: str, names: Mapping[str, str], body: str = "body"
) -> DataFrame:
    """Flat date histogram: one row per bucket, aggregation ids renamed to fields."""
    cells = ", ".join(f"`{i}`: struct<value: double>" for i in names)
    shape = f"aggregations struct<`{agg}`: struct<buckets: array<struct<key: bigint, {cells}>>>>"
    buckets = _buckets(responses, body, shape, agg)
    return buckets.select(
        F.col("b.key").alias("key"), *[F.col(f"b.`{i}`.value").alias(n) for i, n in names.items()]
    )


def term_bucket_response(
    responses: DataFrame, agg: str, term_agg: str, terms: Sequence[str], body: str = "body"
) -> DataFrame:
    """Date histogram of a terms aggregation: terms become columns."""
    inner = f"`{term_agg}`: struct<buckets: array<struct<key: string, `1`: struct<value: double>>>>"
    shape = f"aggregations struct<`{agg}`: struct<buckets: array<struct<key: bigint, {inner}>>>>"
    found = F.col(f"b.`{term_agg}`.buckets")

    def value(term: str) -> Column:
        hits = F.filter(found, lambda t: t["key"] == term)
        return F.get(hits, F.lit(0))["1"]["value"].alias(term)

    buckets = _buckets(responses, body, shape, agg)
    return buckets.select(F.col("b.key").alias("key"), *[value(t) for t in terms])


def _buckets(responses: DataFrame, body: str, shape: str, agg: str) -> DataFrame:
    parsed = F.from_json(q(body), shape)["aggregations"][agg]["buckets"]
    return responses.select(F.explode(parsed).alias("b"))
