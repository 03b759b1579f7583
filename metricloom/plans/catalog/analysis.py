"""Analysis queries."""

from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators import analysis as a
from metricloom.operators.joins import label_intervals
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.registry import query


def _pairs(template: str, columns, lower=False, source="lineitem", head="") -> str:
    cells = [
        f"SELECT '{x}' AS x, '{y}' AS y, {r6(template.format(x=x, y=y))} AS value FROM {source}"
        for i, x in enumerate(columns)
        for j, y in enumerate(columns)
        if not lower or j <= i
    ]
    return head + " UNION ALL ".join(cells)


@query("corr_pearson", _pairs("corr({x}, {y})", SERIES, source="wide", head=f"WITH {SQL_WIDE} "))
def corr_pearson(spark, sf):
    return rounded(a.corr_pearson(wide(spark, sf), SERIES))


@query("corr_lower", _pairs("corr({x}, {y})", NUMBERS, lower=True))
def corr_lower(spark, sf):
    return rounded(a.corr_pearson(lineitem(spark, sf), NUMBERS, lower=True))


# Prices in thousands, so that six places hold what both engines agree on.
THOUSANDS = "WITH t AS (SELECT * REPLACE (l_extendedprice / 1000 AS l_extendedprice) FROM lineitem) "


@query("covariance_matrix", _pairs("covar_samp({x}, {y})", NUMBERS, source="t", head=THOUSANDS))
def covariance_matrix(spark, sf):
    rows = lineitem(spark, sf).withColumn("l_extendedprice", q("l_extendedprice") / 1000)
    return rounded(a.covariance_matrix(rows, NUMBERS))


RANKS = "WITH r AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in NUMBERS
) + " FROM lineitem) "


@query("corr_spearman", _pairs("corr({x}, {y})", NUMBERS, source="r", head=RANKS))
def corr_spearman(spark, sf):
    return rounded(a.corr_spearman(lineitem(spark, sf), NUMBERS))


def _kendall(x: str, y: str) -> str:
    """Tau-b from pairs of (x, y) cells; both columns have few distinct values."""
    return f"""SELECT '{x}' AS x, '{y}' AS y, {r6(f'''
      (SELECT sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y}) * a.n * b.n) / 2
         FROM (SELECT {x}, {y}, count(*) AS n FROM lineitem GROUP BY 1, 2) a,
              (SELECT {x}, {y}, count(*) AS n FROM lineitem GROUP BY 1, 2) b)
      / sqrt((SELECT (sum(n) * (sum(n) - 1) - sum(n * (n - 1))) / 2.0::DOUBLE FROM (SELECT count(*) AS n FROM lineitem GROUP BY {x}))
           * (SELECT (sum(n) * (sum(n) - 1) - sum(n * (n - 1))) / 2.0::DOUBLE FROM (SELECT count(*) AS n FROM lineitem GROUP BY {y})))''')} AS value"""


FEW = ["l_quantity", "l_discount", "l_tax"]


@query(
    "corr_kendall",
    " UNION ALL ".join(_kendall(FEW[i], FEW[j]) for i in range(3) for j in range(i)),
)
def corr_kendall(spark, sf):
    return rounded(a.corr_kendall(lineitem(spark, sf), FEW))


@query("corr_kendall_prices")
def corr_kendall_prices(spark, sf):
    return a.kendall_tau(lineitem(spark, sf), "l_extendedprice", "l_quantity")


@query("rank_shapiro")
def rank_shapiro(spark, sf):
    return a.rank_shapiro(lineitem(spark, sf), NUMBERS)


@query("line_series", f"WITH {SQL_WIDE} SELECT time, {sql_rounded(SERIES)} FROM wide ORDER BY time")
def line_series(spark, sf):
    return rounded(a.line_series(wide(spark, sf), SERIES))


@query(
    "class_feature_series",
    f"""WITH {SQL_WIDE} SELECT time, target, feature, {r6("value")} AS value FROM (
        SELECT time, CASE WHEN time % 86400 < 21600 THEN 'night' ELSE 'day' END AS target, {", ".join(SERIES)} FROM wide)
        UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(SERIES)}))""",
)
def class_feature_series(spark, sf):
    part = F.when(q("time") % 86400 < 21600, "night").otherwise("day")
    frame = wide(spark, sf).withColumn("target", part)
    return rounded(a.class_feature_series(frame, SERIES, "target"))


@query(
    "feature_separation",
    f"""WITH long AS (SELECT l_returnflag = 'R' AS anomaly, feature, value FROM lineitem
          UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))),
        r AS (SELECT *, min(value) OVER w AS low, max(value) OVER w AS high, count(*) OVER w AS size
          FROM long WINDOW w AS (PARTITION BY anomaly, feature)),
        b AS (SELECT *, (high - low) / 50 AS width FROM r)
        SELECT anomaly, feature, CAST(least(floor((value - low) / width), 49) AS BIGINT) AS bin,
          count(*) AS n, {r6("count(*) / (any_value(size) * any_value(width))")} AS density
        FROM b GROUP BY 1, 2, 3""",
)
def feature_separation(spark, sf):
    rows = lineitem(spark, sf, "l_returnflag")
    return rounded(a.feature_separation(rows, NUMBERS, q("l_returnflag") == "R"))


@query("pca_projection")
def pca_projection(spark, sf):
    return a.pca_projection(vectors(spark, sf), VECTOR_COLUMNS, "label", 3)


@query(
    "labelled_series",
    f"""WITH {SQL_FAULTS}, {SQL_WIDE[len(SQL_SAMPLES) + 2:]}, m AS (
      SELECT w.time, max_by(f.label, f.seq) AS label FROM wide w
      JOIN faults f ON w.time BETWEEN f.start AND f.stop GROUP BY 1), l AS (
      SELECT w.time, coalesce(label, '0') AS target, {", ".join(SERIES)} FROM wide w LEFT JOIN m USING (time))
    SELECT time, target, feature, {r6("value")} AS value FROM l
      UNPIVOT INCLUDE NULLS (value FOR feature IN ({", ".join(SERIES)}))""",
)
def labelled_series(spark, sf):
    """Wide series with the fault of their hour, as the class-wise plots read them."""
    frame = label_intervals(wide(spark, sf), faults(spark, sf))
    return rounded(a.class_feature_series(frame, SERIES, "target"))
