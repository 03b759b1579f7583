"""Projection, filter, cleaning and scalar queries."""

from pyspark.sql import functions as F

from metricloom.functions import scalars as s
from metricloom.functions.scalars import q
from metricloom.operators import clean
from metricloom.operators.points import point_threshold
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.registry import query

WIDE_OUT = sql_rounded(SERIES)

# A frame with a constant column, an all-null one and one with a single value and nulls.
EDGE = ["click_node0", "view_node1"]
SQL_EDGE = (
    SQL_WIDE
    + """, edge AS (SELECT time, click_node0, view_node1, 7.0::DOUBLE AS constant,
  NULL::DOUBLE AS empty, CASE WHEN time % 7200 = 0 THEN 3.0::DOUBLE END AS sparse FROM wide)"""
)


def edge(spark, sf):
    frame = wide(spark, sf).select("time", *EDGE)
    return frame.select(
        "*",
        F.lit(7.0).alias("constant"),
        F.lit(None).cast("double").alias("empty"),
        F.when(q("time") % 7200 == 0, 3.0).alias("sparse"),
    )


@query(
    "flagship_alarms",
    f"""WITH {SQL_WIDE}, long AS (
      SELECT time, series AS metric, coalesce(value, 0) AS value
      FROM (SELECT time, {", ".join(f"coalesce({c}, 0) AS {c}" for c in SERIES)} FROM wide)
      UNPIVOT (value FOR series IN ({", ".join(SERIES)})))
    SELECT 'point' AS type, metric, time, {r6("value")} AS value, threshold, 'upper' AS threshold_type
    FROM long JOIN (VALUES ('error', 80.0::DOUBLE), ('purchase', 90.0::DOUBLE)) r(part, threshold)
      ON contains(metric, part) AND value > threshold""",
)
def flagship_alarms(spark, sf):
    filled = clean.fill_missing(wide(spark, sf))
    long = filled.unpivot(["time"], SERIES, "metric", "value")
    rules = [("error", "upper", 80.0), ("purchase", "upper", 90.0)]
    return rounded(point_threshold(long, rules))


@query("filter_columns", f"WITH {SQL_WIDE} SELECT {sql_rounded(['view_node2', 'click_node1'])}, time FROM wide")
def filter_columns(spark, sf):
    return rounded(clean.filter_columns(wide(spark, sf), "view_node2;click_node1;time"))


@query(
    "filter_rows",
    f"""WITH {SQL_WIDE} SELECT time, {sql_rounded(['click_node0'])} FROM wide
        WHERE time > 1704412800 AND time < 1705276800""",
)
def filter_rows(spark, sf):
    bounds = clean.row_bounds("ld:1705276800;gd:1704412800")
    return rounded(clean.filter_rows(wide(spark, sf).select("time", "click_node0"), **bounds))


@query("drop_columns", f"WITH {SQL_WIDE} SELECT time, {sql_rounded(SERIES[2:])} FROM wide")
def drop_columns(spark, sf):
    return rounded(clean.drop_columns(wide(spark, sf), SERIES[:2]))


@query(
    "filter_wildcard",
    f"WITH {SQL_WIDE} SELECT {sql_rounded([c for c in SERIES if c.endswith('_node3')])} FROM wide",
)
def filter_wildcard(spark, sf):
    return rounded(clean.filter_wildcard(wide(spark, sf), "_node3$", keep=True))


@query("drop_low_variance", f"WITH {SQL_EDGE} SELECT time, {sql_rounded(EDGE)}, empty FROM edge")
def drop_low_variance(spark, sf):
    return rounded(clean.drop_low_variance(edge(spark, sf)))


@query(
    "fill_missing",
    f"WITH {SQL_WIDE} SELECT time, {', '.join(f'{r6(f'coalesce({c}, 0)')} AS {c}' for c in SERIES)} FROM wide",
)
def fill_missing(spark, sf):
    return rounded(clean.fill_missing(wide(spark, sf)))


@query(
    "drop_missing_columns",
    f"WITH {SQL_EDGE} SELECT time, {sql_rounded(EDGE)}, constant, sparse FROM edge",
)
def drop_missing_columns(spark, sf):
    return rounded(clean.drop_missing_columns(edge(spark, sf)))


@query(
    "drop_null_rows",
    f"WITH {SQL_WIDE} SELECT time, {sql_rounded(EDGE)} FROM wide WHERE click_node0 IS NOT NULL AND view_node1 IS NOT NULL",
)
def drop_null_rows(spark, sf):
    return rounded(clean.drop_null_rows(wide(spark, sf).select("time", *EDGE)))


@query("variance_threshold", "SELECT l_quantity, l_extendedprice FROM lineitem")
def variance_threshold(spark, sf):
    return clean.variance_threshold(lineitem(spark, sf).select(*NUMBERS), 0.8, keep=())


@query(
    "split_target",
    "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag AS target FROM lineitem",
)
def split_target(spark, sf):
    frame = lineitem(spark, sf, "l_returnflag").drop("row_key")
    features, target = clean.split_target(frame, "l_returnflag")
    return frame.select(*[q(c) for c in features], q(target).alias("target"))


@query(
    "one_hot",
    """SELECT l_quantity, """
    + ", ".join(
        f"""CAST({c} = '{v}' AS DOUBLE) AS "{c}={v}" """
        for c, vs in (("l_linestatus", "FO"), ("l_returnflag", "ANR"))
        for v in vs
    )
    + " FROM lineitem",
)
def one_hot(spark, sf):
    return clean.one_hot(
        table(spark, sf, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")
    )


@query(
    "ordinal_encode",
    """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders""",
)
def ordinal_encode(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return clean.ordinal_encode(orders, "o_orderpriority", "code").select("o_orderkey", "code")


@query(
    "factorize",
    """WITH f AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1),
       c AS (SELECT o_custkey, row_number() OVER (ORDER BY first) - 1 AS code FROM f)
       SELECT o_orderkey, o_custkey, code FROM orders JOIN c USING (o_custkey)""",
)
def factorize(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return clean.factorize(orders, "o_custkey", "o_orderkey", "code")[0]


@query(
    "binarize_target",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
       CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END AS target FROM lineitem""",
)
def binarize_target(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    return clean.binarize_target(rows, "l_returnflag", "N").drop("l_returnflag")


@query(
    "remap_classes",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN '0' WHEN 'view' THEN 'click'
       ELSE event_type END AS event_type FROM events""",
)
def remap_classes(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return clean.remap_classes(events, "event_type", {"signup": "0", "view": "click"})


@query("drop_classes", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'signup')")
def drop_classes(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return clean.drop_classes(events, "event_type", ["view", "signup"])


@query("distinct_terms", f"WITH {SQL_SAMPLES} SELECT DISTINCT instance, metric FROM samples")
def distinct_terms(spark, sf):
    return clean.distinct_terms(samples(spark, sf), "instance", "metric")


@query(
    "term_query",
    f"""WITH {SQL_SAMPLES} SELECT event_id, value FROM samples
    WHERE metric = 'click' AND instance = 'node1' AND time BETWEEN 1704412800 AND 1705276800""",
)
def term_query(spark, sf):
    terms = {"metric": "click", "instance": "node1"}
    hits = clean.term_query(samples(spark, sf, 1704412800, 1705276800), terms, "time", 1704412800, 1705276800)
    return hits.select("event_id", "value")


@query(
    "udf_augment",
    f"""WITH {SQL_WIDE} SELECT time, {sql_rounded(EDGE)},
    {r6("click_node0 + view_node1")} AS sum_load FROM wide""",
)
def udf_augment(spark, sf):
    method = clean.add_columns(("click_node0", "view_node1"), "sum_load")
    return rounded(clean.augment(wide(spark, sf).select("time", *EDGE), method))


# --- scalar functions over whole tables ---------------------------------------------------


@query(
    "parse_duration",
    """WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id || 's' WHEN 1 THEN user_id || 'm'
         WHEN 2 THEN user_id || 'h' ELSE user_id || 'd' END AS text, user_id FROM events)
       SELECT event_id, CAST(user_id * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600
         ELSE 0 END AS BIGINT) AS seconds FROM d""",
)
def parse_duration(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in "smhd"]), (q("event_id") % 4 + 1).cast("int"))
    text = F.concat(q("user_id").cast("string"), unit)
    return table(spark, sf, "events").select("event_id", s.duration_seconds(text).alias("seconds"))


@query(
    "parse_thresholds",
    """SELECT event_id, r.metric AS metric, r.bound AS bound, r.threshold AS threshold FROM events,
       LATERAL (VALUES (event_type, 'gd', value), ('load', 'ld', CAST(user_id AS DOUBLE))) r(metric, bound, threshold)
       WHERE event_id % 5 <> 0""",
)
def parse_thresholds(spark, sf):
    text = F.when(
        q("event_id") % 5 != 0,
        F.format_string("%s:gd:%s;load:ld:%d", q("event_type"), q("value").cast("string"), q("user_id")),
    ).otherwise("default")
    rules = table(spark, sf, "events").select("event_id", s.parse_thresholds(text).alias("rules"))
    return rules.select("event_id", F.inline("rules"))


@query(
    "decode_one_hot",
    f"SELECT event_id, CAST(CASE event_type {' '.join(f'WHEN {chr(39)}{m}{chr(39)} THEN {i}' for i, m in enumerate(METRICS[:4]))} ELSE 0 END AS BIGINT) AS code FROM events",
)
def decode_one_hot(spark, sf):
    flags = F.array(*[(q("event_type") == m).cast("double") for m in METRICS[:4]])
    return table(spark, sf, "events").select("event_id", s.decode_one_hot(flags).alias("code"))


@query("series_name", f"WITH {SQL_SAMPLES} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN metric || '_eth0_' || instance ELSE series END AS name FROM samples")
def series_name(spark, sf):
    device = F.when(q("event_id") % 2 == 0, F.lit("eth0"))
    name = s.series_name(q("metric"), device, q("instance"))
    return samples(spark, sf).select("event_id", name.alias("name"))


@query(
    "human_time",
    """SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS hutc FROM events""",
)
def human_time(spark, sf):
    # Half the times in milliseconds, half in seconds: both must read the same.
    seconds = F.floor("time")
    mixed = F.when(q("event_id") % 2 == 0, seconds).otherwise(seconds * 1000)
    return samples(spark, sf).select("event_id", s.human_time(mixed).alias("hutc"))
