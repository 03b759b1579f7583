"""Aggregation queries."""

from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators import buckets as b
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.registry import query

LOW, HIGH = 1704067200, 1706659199


@query(
    "bucket_avg",
    f"""WITH {SQL_SAMPLES} SELECT CAST(floor(time / 300) * 300 AS BIGINT) AS key, metric, instance,
        {r6("avg(value)")} AS value FROM samples GROUP BY 1, 2, 3""",
)
def bucket_avg_query(spark, sf):
    frame = b.bucket_avg(samples(spark, sf, LOW), 300, ["value"], by=["metric", "instance"], gte=LOW)
    return rounded(frame)


@query(
    "bucket_avg_zoned",
    f"""SELECT epoch_ms(timezone('Europe/Helsinki', date_trunc('day', timezone('Europe/Helsinki', ts::TIMESTAMPTZ)))) AS key,
        {r6("avg(value)")} AS value FROM events GROUP BY 1""",
)
def bucket_avg_zoned(spark, sf):
    days = b.bucket_avg_zoned(samples(spark, sf), ["value"], "ts", "Europe/Helsinki")
    return rounded(days.withColumn("key", F.unix_millis("key")))


@query(
    "bucket_avg_by_term",
    f"""WITH {SQL_SAMPLES} SELECT CAST(floor(time / 3600) * 3600 AS BIGINT) AS key,
        {", ".join(f"{r6(f'avg(value) FILTER (WHERE metric = {chr(39)}{m}{chr(39)})')} AS {m}" for m in METRICS)}
        FROM samples GROUP BY 1""",
)
def bucket_avg_by_term_query(spark, sf):
    return rounded(b.bucket_avg_by_term(samples(spark, sf), HOUR, "metric", METRICS))


@query(
    "bucket_count_filled",
    f"""WITH {SQL_SAMPLES} SELECT k AS key, count(time) AS doc_count
        FROM range({LOW}, {HIGH} + 1, 60) g(k)
        LEFT JOIN samples ON CAST(floor(time / 60) * 60 AS BIGINT) = k GROUP BY 1""",
)
def bucket_count_filled(spark, sf):
    return b.bucket_count_filled(samples(spark, sf), 60, LOW, HIGH)


@query(
    "bucket_count_bounds",
    f"""WITH {SQL_SAMPLES} SELECT k AS key, count(time) AS doc_count
        FROM range({LOW}, {LOW} + 86400, 600) g(k)
        LEFT JOIN samples ON CAST(floor(time / 600) * 600 AS BIGINT) = k
          AND time BETWEEN {LOW} + 250 AND {LOW} + 86350 GROUP BY 1""",
)
def bucket_count_bounds(spark, sf):
    """Bounds inside buckets: only samples between them count."""
    return b.bucket_count_filled(samples(spark, sf), 600, LOW + 250, LOW + 86350)


SQL_TOP = f"""{SQL_SAMPLES}, m AS (
      SELECT CAST(floor(time / 600) * 600 AS BIGINT) AS key, instance, avg(value) AS value
      FROM samples GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value DESC, instance) AS rank FROM m)"""


@query(
    "bucket_top_node",
    f"""WITH {SQL_TOP} SELECT key, instance, {r6("value")} AS value, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE rank <= 3""",
)
def bucket_top_node(spark, sf):
    return rounded(b.bucket_top_hosts(samples(spark, sf), interval=600, top=3))


@query(
    "busiest_node_alarm",
    f"""WITH {SQL_TOP} SELECT key, instance, {r6("value")} AS value, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE rank = 1 AND key = (SELECT max(key) FROM ranked) AND value >= 0.1""",
)
def busiest_node_alarm(spark, sf):
    return rounded(b.busiest_host_alarm(b.bucket_top_hosts(samples(spark, sf), interval=600), 0.1))


@query(
    "pivot_series",
    f"""WITH {SQL_SAMPLES} SELECT CAST(ceil(time) AS BIGINT) AS time,
        {", ".join(f"max_by(value, time) FILTER (WHERE series = '{s}') AS {s}" for s in SERIES)}
        FROM samples GROUP BY 1""",
)
def pivot_series(spark, sf):
    return b.pivot_series(samples(spark, sf), SERIES)


@query(
    "pivot_positions",
    f"""WITH {SQL_HOSTS} SELECT key // 3600 AS pos, CAST(ceil(avg(key + CASE host WHEN 'node0' THEN 0.25 ELSE 0.5 END)) AS BIGINT) AS time,
        {", ".join(f"{r6(f'max(click) FILTER (WHERE host = {chr(39)}{n}{chr(39)})')} AS {n}" for n in NODES)}
        FROM hosts GROUP BY 1""",
)
def pivot_positions(spark, sf):
    hosts = host_frame(spark, sf)
    late = F.when(q("host") == "node0", 0.25).otherwise(0.5)
    frame = hosts.select(
        F.floor(q("key") / HOUR).alias("pos"), (q("key") + late).alias("time"),
        q("host").alias("series"), q("click").alias("value"),
    )
    return rounded(b.pivot_positions(frame, NODES))


@query(
    "core_metrics",
    f"""WITH {SQL_WIDE} SELECT time, {sql_rounded(["click_node0", "view_node3"])},
        NULL::DOUBLE AS gone_node9 FROM wide WHERE click_node0 IS NOT NULL OR view_node3 IS NOT NULL""",
)
def core_metrics(spark, sf):
    # A frozen list with a series the data lack: it still gives a column.
    core = ["click_node0", "view_node3", "gone_node9"]
    frame = b.bucket_avg_by_term(samples(spark, sf), HOUR, "series", core)
    return rounded(frame.withColumnRenamed("key", "time"))


@query("core_list", f"WITH {SQL_SAMPLES} SELECT DISTINCT series AS core FROM samples")
def core_list(spark, sf):
    return b.core_metrics(samples(spark, sf))


@query("class_distribution", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def class_distribution(spark, sf):
    return b.class_distribution(table(spark, sf, "lineitem"), "l_returnflag")


CLICKS, VIEWS = SERIES[:4], SERIES[16:]


def _list(names):
    return "[" + ", ".join(names) + "]"


@query(
    "row_stats",
    f"""WITH {SQL_WIDE}, w AS (SELECT *, list_filter({_list(CLICKS)}, lambda x: x IS NOT NULL) AS c,
          list_filter({_list(VIEWS)}, lambda x: x IS NOT NULL) AS v FROM wide)
        SELECT time, {sql_rounded(SERIES[4:16])},
          {r6("CASE WHEN len(c) > 1 THEN list_stddev_samp(c) END")} AS click_std,
          {r6("list_avg(c)")} AS click_mean, {r6("list_median(v)")} AS view_median FROM w""",
)
def row_stats(spark, sf):
    return rounded(
        b.row_stats(
            wide(spark, sf), std={"click_std": CLICKS}, mean={"click_mean": CLICKS},
            median={"view_median": VIEWS},
        )
    )


@query(
    "data_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) AS n, count(DISTINCT {c}) AS n_unique FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    ),
)
def data_profile(spark, sf):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return b.data_profile(table(spark, sf, "orders").select(*names))


@query(
    "mean_normalize",
    "SELECT "
    + ", ".join(
        f"{r6(f'({c} - avg({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())')} AS {c}"
        for c in NUMBERS
    )
    + " FROM lineitem",
)
def mean_normalize(spark, sf):
    return rounded(b.mean_normalize(lineitem(spark, sf).select(*NUMBERS), NUMBERS))


@query(
    "user_query",
    f"""SELECT CAST(floor(epoch_us(ts) / 1e6 / 900) * 900 AS BIGINT) AS key, {r6("avg(value)")} AS value,
        {r6("avg(user_id)")} AS user_id FROM events WHERE event_type = 'view' GROUP BY 1""",
)
def user_query(spark, sf):
    events = table(spark, sf, "events").withColumn("time", epoch_seconds(q("ts")))
    wanted = b.BucketQuery(900, ["value", "user_id"], {"event_type": "view"})
    return rounded(b.run_bucket_query(events, wanted))


# A search body as users write it: terms, a range of the stored time, averages by bucket.
BODY = """{"size": 0, "query": {"filtered": {
  "query": {"query_string": {"query": "event_type:\\"click\\"", "analyze_wildcard": true}},
  "filter": {"bool": {"must": [{"range": {"ts": {"gte": "now-48h", "lte": "now", "format": "epoch_millis"}}}], "must_not": []}}}},
  "aggs": {"2": {"date_histogram": {"field": "ts", "interval": "30m", "min_doc_count": 0, "extended_bounds": {"min": "now-72h", "max": "now"}},
    "aggs": {"1": {"avg": {"field": "value"}}, "3": {"avg": {"field": "user_id"}}}}}}"""


@query(
    "user_query_json",
    f"""WITH t AS (SELECT epoch_us(ts) / 1e6 AS time, value, user_id, event_type FROM events), n AS (SELECT max(time) AS now FROM t),
        m AS (SELECT CAST(floor(time / 1800) * 1800 AS BIGINT) AS key, {r6("avg(value)")} AS value, {r6("avg(user_id)")} AS user_id
          FROM t, n WHERE event_type = 'click' AND time >= now - 172800 GROUP BY 1),
        g AS (SELECT unnest(range(CAST(floor((now - 259200) / 1800) * 1800 AS BIGINT), CAST(floor(now / 1800) * 1800 AS BIGINT) + 1, 1800)) AS key FROM n)
        SELECT key, value, user_id FROM g LEFT JOIN m USING (key)""",
)
def user_query_json(spark, sf):
    events = table(spark, sf, "events")
    now = events.agg(epoch_seconds(F.max("ts"))).first()[0]
    return rounded(b.run_bucket_query(events, b.BucketQuery.from_json(BODY, now)))
