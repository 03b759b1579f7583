"""Source and sink queries. Documents are rendered from the tables and parsed back."""

from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.points import SQL_CLASSES, classes
from metricloom.plans.catalog.registry import query
from metricloom.session import scratch_path
from metricloom.sinks import writers as w
from metricloom.sources import fault_logs, files, responses

SAMPLE_SQL = f"WITH {SQL_SAMPLES} SELECT event_id, time, metric, instance, series, value FROM samples"


def plain(spark, sf):
    return samples(spark, sf).select("event_id", "time", "metric", "instance", "series", "value")


@query("src_csv", SAMPLE_SQL)
def src_csv(spark, sf):
    frame, path = plain(spark, sf), scratch_path(spark, "csv")
    w.write_csv(frame, path)
    return files.read_csv(spark, path, frame.schema)


@query("src_csv_inferred", SAMPLE_SQL)
def src_csv_inferred(spark, sf):
    path = scratch_path(spark, "csv")
    w.write_csv(plain(spark, sf), path)
    return files.read_csv(spark, [path]).withColumn("event_id", q("event_id").cast("long"))


@query(
    "src_metric_matrix",
    f"""WITH {SQL_SAMPLES} SELECT event_id, time + pos AS time, CAST(pos AS INTEGER) AS pos, metric,
        CASE WHEN metric = 'view' THEN 'eth0' END AS device, instance,
        CASE WHEN metric = 'view' THEN 'view_eth0_' || instance ELSE series END AS series, value + pos AS value
        FROM samples, (SELECT unnest([0, 1]) AS pos)""",
)
def src_metric_matrix(spark, sf):
    s = samples(spark, sf)
    labels = F.map_from_arrays(
        F.array(F.lit("__name__"), F.lit("instance"), F.lit("device")),
        F.array(q("metric"), q("instance"), F.when(q("metric") == "view", "eth0")),
    )
    labels = F.map_filter(labels, lambda _, v: v.isNotNull())
    pair = '[%s,"%s"]'
    values = F.concat_ws(
        ",",
        *[
            F.format_string(pair, (q("time") + i).cast("decimal(20,6)").cast("string"),
                            (q("value") + i).cast("string"))
            for i in (0, 1)
        ],
    )
    body = F.format_string(
        '{"status":"success","data":{"resultType":"matrix","result":[{"metric":%s,"values":[%s]}]}}',
        F.to_json(labels), values,
    )
    return responses.metric_matrix(s.select("event_id", body.alias("body")))


@query(
    "src_documents",
    """SELECT event_id AS ms, event_type AS method, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def src_documents(spark, sf):
    events = table(spark, sf, "events")
    source = F.struct(
        q("event_id").alias("ms"), q("event_type").alias("method"), q("user_id").alias("ship"),
        F.from_json(q("props"), "k bigint")["k"].alias("k"),
    )
    hit = F.struct(F.struct(F.array(F.struct(source.alias("_source"))).alias("hits")).alias("hits"))
    bodies = events.select(F.to_json(hit).alias("body"))
    return responses.documents(
        bodies, "ms: bigint, method: string, ship: bigint, k: bigint", ["ms", "method", "k"]
    )


HOURS = f"""WITH {SQL_HOSTS} SELECT key * 1000 AS key, {r6("avg(click)")} AS tx, {r6("avg(view)")} AS rx
    FROM hosts GROUP BY 1"""


def _hours(spark, sf):
    return host_frame(spark, sf).groupBy("key").agg(F.avg("click").alias("tx"), F.avg("view").alias("rx"))


def _document(agg, bucket):
    return F.to_json(
        F.struct(F.struct(F.struct(F.array(bucket).alias("buckets")).alias(agg)).alias("aggregations"))
    ).alias("body")


@query("src_agg_response", HOURS)
def src_agg_response(spark, sf):
    bucket = F.struct(
        (q("key") * 1000).alias("key"), F.lit("x").alias("key_as_string"), F.lit(1).alias("doc_count"),
        F.struct(q("tx").alias("value")).alias("1"), F.struct(q("rx").alias("value")).alias("2"),
    )
    bodies = _hours(spark, sf).select(_document("3", bucket))
    return rounded(responses.bucket_response(bodies, "3", {"1": "tx", "2": "rx"}))


@query("src_term_response", HOURS)
def src_term_response(spark, sf):
    terms = F.array(
        *[F.struct(F.lit(t).alias("key"), F.struct(q(t).alias("value")).alias("1")) for t in ("rx", "tx")]
    )
    bucket = F.struct((q("key") * 1000).alias("key"), F.struct(terms.alias("buckets")).alias("3"))
    bodies = _hours(spark, sf).select(_document("2", bucket))
    return rounded(responses.term_bucket_response(bodies, "2", "3", ["tx", "rx"]))


@query("src_dicts", f"WITH {SQL_SAMPLES} SELECT event_id, metric, value, NULL::BIGINT AS core FROM samples")
def src_dicts(spark, sf):
    pairs = F.create_map(
        F.lit("metric"), q("metric"), F.lit("value"), q("value").cast("string"),
    )
    maps = samples(spark, sf).select("event_id", pairs.alias("m"))
    return files.from_maps(maps, "m", {"metric": "string", "value": "double", "core": "bigint"})


SQL_LOGS = f"""{SQL_FAULTS}, logs AS (SELECT seq, 0 AS n, CAST(start AS VARCHAR) AS unixtime, 'Started' AS status, 'dummy' AS anomaly, 'p=1' AS settings, uuid FROM faults
        UNION ALL SELECT seq, 1, CAST(start + 60 AS VARCHAR), 'Modifier', 'dummy', NULL, uuid FROM faults
        UNION ALL SELECT seq, 2, CAST(stop AS VARCHAR), CASE WHEN seq % 3 = 0 THEN 'Finised' ELSE 'Finished' END, 'dummy', 'p=1', uuid FROM faults
        UNION ALL SELECT seq, 3, NULL, NULL, NULL, NULL, NULL FROM faults)"""


def _log_lines(spark, sf):
    f = faults(spark, sf)
    done = F.when(q("seq") % 3 == 0, "Finised").otherwise("Finished")
    form = "%d  anomalies.py:77 \tINFO     %s dummy with options p=1 and uuid %s"
    lines = F.array(
        F.format_string(form, q("start"), F.lit("Started"), q("uuid")),
        F.format_string(
            "%d  anomalies.py:80 \tINFO     Modifier dummy of uuid %s for 3", q("start") + 60, q("uuid")
        ),
        F.format_string(form, q("stop"), done, q("uuid")),
        F.lit("no such format"),
    )
    return f.select("seq", F.posexplode(lines).alias("n", "value"))


@query("src_fault_logs", f"WITH {SQL_LOGS} SELECT seq, n, unixtime, status, anomaly, settings, uuid FROM logs")
def src_fault_logs(spark, sf):
    parsed = fault_logs.parse_fault_logs(_log_lines(spark, sf))
    return parsed.select("seq", "n", "unixtime", "status", "anomaly", "settings", "uuid")


@query("sink_csv", SAMPLE_SQL)
def sink_csv(spark, sf):
    frame, path = plain(spark, sf), scratch_path(spark, "csv")
    w.write_csv(frame, path, key="time")
    order = ["time", *[c for c in frame.columns if c != "time"]]
    return files.read_csv(spark, path, frame.select(order).schema)


@query(
    "sink_dict",
    f"""WITH {SQL_WIDE} SELECT time, "column", {r6("value")} AS value FROM wide
        UNPIVOT INCLUDE NULLS (value FOR "column" IN ({", ".join(SERIES)}))""",
)
def sink_dict(spark, sf):
    return rounded(w.to_dict_rows(wide(spark, sf), "time"))


@query(
    "sink_arff",
    """SELECT value, count(*) AS n FROM (
        SELECT unnest(['@relation orders', '@attribute o_orderkey real', '@attribute o_custkey real',
          '@attribute o_orderpriority{1_URGENT,2_HIGH,3_MEDIUM,4_NOT_SPECIFIED,5_LOW}', '@data']) AS value
        UNION ALL SELECT o_orderkey || ',' || CASE WHEN o_custkey % 7 = 0 THEN '?' ELSE CAST(o_custkey AS VARCHAR) END
          || ',"' || regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g') || '"' FROM orders) GROUP BY 1""",
)
def sink_arff(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(q("o_custkey") % 7 != 0, q("o_custkey")).alias("o_custkey"), "o_orderpriority"
    )
    path = scratch_path(spark, "arff")
    w.write_arff(orders, path, "orders")
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


STAMP = "2024-02-01T00:00:00.000Z"


def _records(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return w.anomaly_records(classes(spark, sf).drop("event_id"), "rules", "limits", "10m", now)


@query(
    "sink_kafka",
    f"""WITH {SQL_CLASSES} SELECT 'rules/limits' AS key, '{{"utc":' || utc || ',"hutc":"' || hutc || '","type":"' || type
        || '","method":"rules","model":"limits","interval":"10m","reporttimestamp":"{STAMP}"}}' AS value FROM classes""",
)
def sink_kafka(spark, sf):
    return w.kafka_payload(_records(spark, sf))


@query(
    "sink_anomaly_index",
    f"""WITH {SQL_CLASSES} SELECT utc, hutc, type, 'rules' AS method, 'limits' AS model, '10m' AS interval,
        '{STAMP}' AS reporttimestamp FROM classes""",
)
def sink_anomaly_index(spark, sf):
    records, path = _records(spark, sf), scratch_path(spark, "anomalies")
    w.append_anomalies(records.where("type = 'cpu'"), path)
    w.append_anomalies(records.where("type <> 'cpu'"), path)
    return spark.read.schema(records.schema).parquet(path)


@query("stage_checkpoint", f"WITH {SQL_WIDE} SELECT time, {sql_rounded(SERIES)} FROM wide")
def stage_checkpoint(spark, sf):
    folder = scratch_path(spark, "stages")
    return rounded(w.stage_checkpoint(wide(spark, sf), folder, w.stage_name(True, "filtered")))
