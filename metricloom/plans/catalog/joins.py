"""Join, set and order queries."""

from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators import joins as j
from metricloom.operators import order as o
from metricloom.operators import sets as u
from metricloom.operators.buckets import latest_bucket
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.registry import query

FIELDS = ["click", "view", "error"]


def node(spark, sf, host, *fields):
    frame = host_frame(spark, sf).where(q("host") == host)
    return frame.select("key", *[q(c) for c in fields])


@query(
    "join_key",
    f"""WITH {SQL_HOSTS} SELECT key, {r6("a.click")} AS click_x, {r6("b.click")} AS click_y,
        {r6("a.view")} AS view, {r6("b.error")} AS error
        FROM hosts a JOIN hosts b USING (key) WHERE a.host = 'node0' AND b.host = 'node1'""",
)
def join_key(spark, sf):
    left, right = node(spark, sf, "node0", "click", "view"), node(spark, sf, "node1", "click", "error")
    return rounded(j.join_key(left, right))


@query(
    "join_chain",
    f"""WITH {SQL_HOSTS} SELECT key, {r6("a.click")} AS click, {r6("b.view")} AS view,
        {r6("c.error")} AS error FROM hosts a JOIN hosts b USING (key) JOIN hosts c USING (key)
        WHERE a.host = 'node0' AND b.host = 'node1' AND c.host = 'node2'""",
)
def join_chain(spark, sf):
    return rounded(j.join_chain([node(spark, sf, f"node{i}", c) for i, c in enumerate(FIELDS)]))


NODE_NAMES = ["master", "slave1", "slave2", "slave3"]


@query(
    "join_chain_nodes",
    f"""WITH {SQL_HOSTS} SELECT key, """
    + ", ".join(f"{r6(f'h{i}.{c}')} AS {c}_{n}" for i, n in enumerate(NODE_NAMES) for c in FIELDS)
    + " FROM hosts h0 JOIN hosts h1 USING (key) JOIN hosts h2 USING (key) JOIN hosts h3 USING (key) WHERE "
    + " AND ".join(f"h{i}.host = 'node{i}'" for i in range(4)),
)
def join_chain_nodes(spark, sf):
    return rounded(j.join_chain_nodes(host_frame(spark, sf), NODES, FIELDS))


@query(
    "merge_final",
    f"""WITH {SQL_HOSTS} SELECT key, """
    + ", ".join(f"{r6(f'coalesce(h{i}.{c}, 0)')} AS {c}" for i, c in enumerate(FIELDS))
    + " FROM hosts h0 JOIN hosts h1 USING (key) JOIN hosts h2 USING (key) WHERE "
    + " AND ".join(f"h{i}.host = 'node{i}'" for i in range(3)),
)
def merge_final(spark, sf):
    return rounded(j.merge_final([node(spark, sf, f"node{i}", c) for i, c in enumerate(FIELDS)]))


@query(
    "join_positional",
    """WITH a AS (SELECT *, row_number() OVER (ORDER BY event_id) AS position FROM events),
       b AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders)
       SELECT position, event_id, value, o_orderkey FROM a FULL JOIN b USING (position)""",
)
def join_positional(spark, sf):
    left = table(spark, sf, "events").select("event_id", "value")
    right = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    both = j.join_positional(left, right, ["event_id"], ["o_totalprice", "o_orderkey"])
    return both.drop("o_totalprice")


@query(
    "label_intervals",
    f"""WITH {SQL_FAULTS}, m AS (
      SELECT s.event_id, max_by(f.label, f.seq) AS label FROM samples s
      JOIN faults f ON s.time >= f.start AND s.time <= f.stop GROUP BY 1)
    SELECT event_id, coalesce(label, '0') AS target FROM samples LEFT JOIN m USING (event_id)""",
)
def label_intervals(spark, sf):
    rows = samples(spark, sf).select("event_id", "time")
    labelled = j.label_intervals(rows, faults(spark, sf))
    return labelled.select("event_id", "target")


def fault_log(spark, sf):
    """Fault log rows: a start, a modifier and an end per fault, one in three misspelt."""
    f = faults(spark, sf)
    lines = F.array(
        F.struct(F.lit("Started").alias("status"), q("start").alias("at"), F.lit(0).alias("n")),
        F.struct(F.lit("Modifier").alias("status"), (q("start") + 60).alias("at"), F.lit(1).alias("n")),
        F.struct(
            F.when(q("seq") % 3 == 0, "Finised").otherwise("Finished").alias("status"),
            q("stop").alias("at"), F.lit(2).alias("n"),
        ),
    )
    return f.select("uuid", "seq", q("label").alias("anomaly"), F.inline(lines))


@query(
    "fault_intervals",
    f"""WITH {SQL_FAULTS} SELECT uuid, label AS anomaly, CAST(start AS DOUBLE) AS start,
        CAST(stop AS DOUBLE) AS stop, 1::BIGINT AS modifiers FROM faults""",
)
def fault_intervals(spark, sf):
    log = fault_log(spark, sf).select(
        "uuid", "anomaly", "status", q("at").cast("string").alias("unixtime"),
        (q("seq") * 3 + q("n")).alias("line"),
    )
    return j.fault_intervals(log)


@query(
    "fault_modifiers",
    f"""WITH {SQL_FAULTS} SELECT uuid, seq * 3 + 1 AS line, CAST(start + 60 AS DOUBLE) AS time FROM faults""",
)
def fault_modifiers(spark, sf):
    log = fault_log(spark, sf).select(
        "uuid", "anomaly", "status", q("at").cast("string").alias("unixtime"),
        (q("seq") * 3 + q("n")).alias("line"),
    )
    return j.fault_modifiers(log)


@query(
    "align_nearest_second",
    f"""WITH {SQL_SAMPLES}, b AS (SELECT ceil(time) AS second, max(value) AS other FROM samples
          WHERE instance = 'node1' GROUP BY 1)
        SELECT event_id, time, other FROM samples LEFT JOIN b ON ceil(time) = second""",
)
def align_nearest_second(spark, sf):
    s = samples(spark, sf)
    other = s.where(q("instance") == "node1").groupBy(F.ceil("time").alias("time")).agg(
        F.max("value").alias("other")
    )
    return j.align_nearest_second(s.select("event_id", "time"), other)


@query(
    "union_all",
    f"""WITH {SQL_HOSTS} SELECT key, {r6("click")} AS click, NULL::DOUBLE AS view FROM hosts WHERE host = 'node0'
        UNION ALL SELECT key, {r6("click")}, {r6("view")} FROM hosts WHERE host = 'node1'
        UNION ALL SELECT key, NULL, {r6("view")} FROM hosts WHERE host = 'node2'""",
)
def union_all(spark, sf):
    frames = [
        node(spark, sf, "node0", "click"), node(spark, sf, "node1", "click", "view"),
        node(spark, sf, "node2", "view"),
    ]
    return rounded(u.union_all(frames))


@query(
    "frame_diff",
    """SELECT o_custkey AS value, 'left' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
         EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
       UNION ALL SELECT o_custkey, 'right' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
         EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def frame_diff(spark, sf):
    orders = table(spark, sf, "orders")
    left = orders.where("o_orderstatus = 'F'").select("o_custkey")
    return u.frame_diff(left, orders.where("o_orderstatus = 'O'").select("o_custkey"))


@query("frame_equal", "SELECT true AS equal")
def frame_equal(spark, sf):
    left = lineitem(spark, sf).select(*NUMBERS)
    return u.frame_equal(left, left.select(*reversed(NUMBERS)).repartition(7))


@query("frame_unequal", "SELECT false AS equal")
def frame_unequal(spark, sf):
    """One value of one row differs."""
    left = lineitem(spark, sf)
    first = left.agg(F.min("row_key")).first()[0]
    other = left.withColumn("l_tax", F.when(q("row_key") == first, q("l_tax") + 1).otherwise(q("l_tax")))
    return u.frame_equal(left, other)


@query(
    "multiset_diff",
    """SELECT l_quantity, l_discount, CAST(sum(s) AS BIGINT) AS surplus FROM (
         SELECT l_quantity, l_discount, 1 AS s FROM lineitem WHERE l_returnflag = 'A'
         UNION ALL SELECT l_quantity, l_discount, -1 FROM lineitem WHERE l_returnflag = 'R')
       GROUP BY 1, 2 HAVING sum(s) <> 0""",
)
def multiset_diff(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_returnflag")
    left, right = (rows.where(q("l_returnflag") == c).drop("l_returnflag") for c in "AR")
    return u.multiset_diff(left, right)


@query(
    "latest_hits",
    """SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 500""",
)
def latest_hits(spark, sf):
    hits = o.latest_hits(table(spark, sf, "events"), "ts", ["event_id"], 500)
    return hits.select("event_id", "user_id", "event_type", "value")


@query(
    "rank_features",
    f"""SELECT feature, {r6("score")} AS score FROM (
        {" UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS score FROM lineitem" for c in NUMBERS)})
        ORDER BY score DESC, feature LIMIT 30""",
)
def rank_features(spark, sf):
    cells = [F.struct(F.lit(c).alias("feature"), F.var_pop(c).alias("score")) for c in NUMBERS]
    scores = lineitem(spark, sf).agg(F.array(*cells).alias("a")).select(F.inline("a"))
    return rounded(o.rank_features(scores, "score"))


@query("sort_columns", f"WITH {SQL_WIDE} SELECT time, {sql_rounded(SERIES)} FROM wide")
def sort_columns(spark, sf):
    return rounded(o.sort_columns(wide(spark, sf)))


@query(
    "resample_repeat",
    """SELECT event_id, value, n AS sub_index, epoch_us(date_trunc('minute', ts)) + n * 1000000
         + epoch_us(ts) % 1000000 AS at_us
       FROM events, (SELECT CAST(range AS INTEGER) AS n FROM range(10))""",
)
def resample_repeat(spark, sf):
    rows = samples(spark, sf).select("event_id", "ts", "value")
    repeated = o.resample_repeat(rows, "ts", 10)
    return repeated.select("event_id", "value", "sub_index", F.unix_micros("ts").alias("at_us"))


@query(
    "latest_bucket",
    f"""WITH {SQL_HOSTS} SELECT key, host, {r6("click")} AS click FROM hosts
        WHERE key = (SELECT max(key) FROM hosts)""",
)
def latest_bucket_query(spark, sf):
    return rounded(latest_bucket(host_frame(spark, sf).select("key", "host", "click")))
