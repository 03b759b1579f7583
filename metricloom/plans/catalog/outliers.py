"""Outlier detection queries."""

from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators import neighbours, outliers, training_labels
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.registry import query
from metricloom.session import scratch_path, spread


def forest_of(rows, **options):
    options = {"n_estimators": 50, "contamination": 0.05, **options}
    return outliers.fit_isolation_forest(rows, NUMBERS, ["row_key"], **options)


@query("isolation_forest")
def isolation_forest(spark, sf):
    rows = spread(lineitem(spark, sf), "row_key")
    return forest_of(rows).predict(rows)


@query("isolation_forest_sampled")
def isolation_forest_sampled(spark, sf):
    rows = spread(lineitem(spark, sf), "row_key")
    forest = forest_of(rows, max_samples=64, max_features=0.5, bootstrap=True, n_estimators=20)
    return forest.predict(rows).where("prediction = -1")


# Rows far off in every number, one in about a thousand, are those flagged by trees over all rows.
@query(
    "isolation_forest_planted",
    f"""SELECT {", ".join(f"CASE WHEN l_orderkey % 1000 = 7 THEN {c} + (1 + l_orderkey % 7) * 1e6 ELSE {c} END AS {c}" for c in NUMBERS)}
        FROM lineitem WHERE l_orderkey % 1000 = 7""",
)
def isolation_forest_planted(spark, sf):
    rows = spread(lineitem(spark, sf, "l_orderkey"), "row_key")
    planted = q("l_orderkey") % 1000 == 7
    far = (1 + q("l_orderkey") % 7) * 1e6
    rows = rows.select("row_key", planted.alias("planted"), *[F.when(planted, q(c) + far).otherwise(q(c)).alias(c) for c in NUMBERS])
    n, odd = rows.agg(F.count(F.lit(1)), F.count_if("planted")).first()
    forest = forest_of(rows, n_estimators=30, max_samples=1.0, contamination=(odd - 0.5) / n)
    return forest.predict(rows).where("prediction = -1").select(*NUMBERS)


def _bins(c: str) -> str:
    return f"""SELECT '{c}' AS f, least(floor(({c} - low) / width), 9) AS bin, -log2(count(*) / (any_value(size) * any_value(width)) + 0.1) AS s
        FROM (SELECT {c}, min({c}) OVER () AS low, (max({c}) OVER () - min({c}) OVER ()) / 10 AS width, count(*) OVER () AS size FROM lineitem) GROUP BY 2"""


def _ends(c: str) -> str:
    return f"(SELECT min({c}) AS low, (max({c}) - min({c})) / 10 AS width FROM lineitem) {c}_e"


@query(
    "hbos",
    f"""WITH bins AS ({" UNION ALL ".join(_bins(c) for c in NUMBERS)})
    SELECT {", ".join(NUMBERS)}, {r6(" + ".join(f"{c}_b.s" for c in NUMBERS))} AS score FROM lineitem
    CROSS JOIN {" CROSS JOIN ".join(_ends(c) for c in NUMBERS)}
    {" ".join(f"JOIN bins {c}_b ON {c}_b.f = '{c}' AND {c}_b.bin = least(floor(({c} - {c}_e.low) / {c}_e.width), 9)" for c in NUMBERS)}""",
)
def hbos(spark, sf):
    rows = lineitem(spark, sf).drop("row_key")
    return rounded(outliers.fit_hbos(rows, NUMBERS).score(rows))


@query("hbos_flags")
def hbos_flags(spark, sf):
    rows = lineitem(spark, sf)
    scored = outliers.fit_hbos(rows, NUMBERS).score(rows)
    return outliers.flag_top(scored, 0.05).where("prediction = 1")


@query("cblof")
def cblof(spark, sf):
    rows = lineitem(spark, sf)
    return outliers.flag_top(outliers.fit_cblof(rows, NUMBERS).score(rows), 0.05)


@query("reconstruction_error")
def reconstruction_error(spark, sf):
    scored = outliers.reconstruction_error(vectors(spark, sf), VECTOR_COLUMNS, 8)
    scored = scored.select("vec_id", "score")
    return outliers.flag_top(scored, 0.1, store=True)


# Squared scores of the pairs of each point's five nearest; the vectors are all different.
@query(
    "abod_fast",
    f"""WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
       n AS (SELECT a.vec_id, b.vec_id AS other, list_transform(range(len(a.x)), lambda i: b.x[i + 1] - a.x[i + 1]) AS leg
         FROM p AS a JOIN p AS b ON a.vec_id <> b.vec_id
         QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) <= 5),
       s AS (SELECT a.vec_id, -var_pop(list_dot_product(a.leg, b.leg) / list_dot_product(a.leg, a.leg) / list_dot_product(b.leg, b.leg)) AS score
         FROM n AS a JOIN n AS b ON a.vec_id = b.vec_id AND a.other < b.other GROUP BY 1)
       SELECT vec_id, {r6("score", 9)} AS score, CASE WHEN score > (SELECT quantile_cont(score, 0.9) FROM s) THEN 1 ELSE 0 END AS prediction FROM s""",
)
def abod_fast(spark, sf):
    rows = table(spark, sf, "embeddings")
    scored = neighbours.abod_scores(rows, ["embedding"], "vec_id", 5)
    return rounded(outliers.flag_top(scored.select("vec_id", "score"), 0.1, store=True), 9)


GRID = ["l_quantity", "l_discount"]


@query(
    "dbscan",
    """WITH RECURSIVE p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
       near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p AS a, p AS b WHERE list_distance(a.x, b.x) <= 1.0),
       core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= 3),
       reach AS (SELECT a, a AS b FROM core
         UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b JOIN core ON core.a = near.b),
       numbered AS (SELECT a, dense_rank() OVER (ORDER BY head) - 1 AS cluster FROM (SELECT a, min(b) AS head FROM reach GROUP BY 1)),
       border AS (SELECT near.a, min(cluster) AS cluster FROM near JOIN numbered ON numbered.a = near.b GROUP BY 1)
       SELECT vec_id, CAST(coalesce(n.cluster, b.cluster, -1) AS INTEGER) AS cluster
       FROM p LEFT JOIN numbered AS n ON n.a = vec_id LEFT JOIN border AS b ON b.a = vec_id""",
)
def dbscan(spark, sf):
    rows = table(spark, sf, "embeddings")
    clusters = neighbours.dbscan(rows, ["embedding"], "vec_id", eps=1.0, min_samples=3)
    return clusters.select("vec_id", "cluster")


# Quantities are whole numbers and discounts whole cents, far nearer than eps: clusters
# are the runs of quantities, and all distinct points are core.
@query(
    "dbscan_runs",
    """WITH v AS (SELECT DISTINCT l_quantity AS x FROM lineitem),
       b AS (SELECT x, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 1 THEN 0 ELSE 1 END AS opens FROM v),
       i AS (SELECT x, sum(opens) OVER (ORDER BY x) - 1 AS c FROM b)
       SELECT l_quantity, CAST(c AS INTEGER) AS cluster, count(*) AS n FROM lineitem JOIN i ON l_quantity = x GROUP BY 1, 2""",
)
def dbscan_runs(spark, sf):
    rows = lineitem(spark, sf)
    clusters = neighbours.dbscan(rows, GRID, "row_key", eps=1.05, min_samples=5)
    return clusters.groupBy("l_quantity", "cluster").agg(F.count(F.lit(1)).alias("n"))


def _hours(spark, sf):
    return host_frame(spark, sf).groupBy("key").agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("click", "view", "error")]
    )


@query("generate_training_labels")
def training_labels_query(spark, sf):
    return training_labels.generate_training_labels(
        _hours(spark, sf), ["click", "view", "error"], "key", eps=0.6, min_samples=3,
        n_estimators=50,
    )


@query("generate_training_labels_anomalies")
def training_labels_anomalies(spark, sf):
    return training_labels.generate_training_labels(
        _hours(spark, sf), ["click", "view", "error"], "key", eps=1.0, min_samples=3,
        n_estimators=50, only_anomalies=True,
    )


@query("append_predictions")
def append_predictions(spark, sf):
    rows = spread(lineitem(spark, sf), "row_key")
    return training_labels.append_predictions(rows, forest_of(rows), scratch_path(spark, "labelled"))
