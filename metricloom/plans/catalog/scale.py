"""Scaling, reduction, splitting and balancing queries."""

from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators import scale as s
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.registry import query
from metricloom.session import scratch_path, spread


def _each(template: str, columns=NUMBERS) -> str:
    cells = ", ".join(f"{r6(template.replace('#', c))} AS {c}" for c in columns)
    return f"SELECT {cells} FROM lineitem"


def _numbers(spark, sf):
    return lineitem(spark, sf).select(*NUMBERS)


STANDARD = _each("(# - avg(#) OVER ()) / stddev_pop(#) OVER ()")


@query("scale_standard", STANDARD)
def scale_standard(spark, sf):
    return rounded(s.scale(_numbers(spark, sf), NUMBERS, "StandardScaler"))


@query("scale_minmax", _each("(# - min(#) OVER ()) / (max(#) OVER () - min(#) OVER ())"))
def scale_minmax(spark, sf):
    return rounded(s.scale(_numbers(spark, sf), NUMBERS, "MinMaxScaler"))


@query("scale_maxabs", _each("# / max(abs(#)) OVER ()"))
def scale_maxabs(spark, sf):
    return rounded(s.scale(_numbers(spark, sf), NUMBERS, "MaxAbsScaler"))


QUARTILES = ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.5) AS {c}2, quantile_cont({c}, 0.75) AS {c}3"
    for c in NUMBERS
)


@query(
    "scale_robust",
    f"WITH p AS (SELECT {QUARTILES} FROM lineitem) SELECT "
    + ", ".join(f"{r6(f'({c} - {c}2) / ({c}3 - {c}1)')} AS {c}" for c in NUMBERS)
    + " FROM lineitem, p",
)
def scale_robust(spark, sf):
    return rounded(s.scale(_numbers(spark, sf), NUMBERS, "RobustScaler"))


@query(
    "normalize_rows",
    "SELECT "
    + ", ".join(
        f"{r6(f'{c} / sqrt({" + ".join(f'{d} * {d}' for d in NUMBERS)})')} AS {c}" for c in NUMBERS
    )
    + " FROM lineitem",
)
def normalize_rows(spark, sf):
    return rounded(s.normalize_rows(_numbers(spark, sf), NUMBERS, "l2"))


# The position of a value is the mean of its left and right position on the grid of
# quantiles; on the strictly growing grid of prices both agree.
@query(
    "quantile_transform",
    f"""WITH g AS (SELECT unnest(range(11)) AS i,
          unnest(quantile_cont(l_extendedprice, [{", ".join(str(i / 10) for i in range(11))}])) AS x FROM lineitem),
        s AS (SELECT a.i, a.x AS x0, b.x AS x1 FROM g a JOIN g b ON b.i = a.i + 1)
        SELECT l_extendedprice AS raw, {r6("CASE WHEN l_extendedprice >= (SELECT max(x) FROM g) THEN 1.0 ELSE (i + (l_extendedprice - x0) / (x1 - x0)) / 10 END")} AS l_extendedprice
        FROM lineitem JOIN s ON (l_extendedprice >= x0 AND l_extendedprice < x1)
          OR (i = 9 AND l_extendedprice = x1)""",
)
def quantile_transform(spark, sf):
    prices = _numbers(spark, sf).select("l_extendedprice", q("l_extendedprice").alias("raw"))
    return rounded(s.fit_quantile(prices, ["l_extendedprice"], 11).transform(prices))


@query("power_transform")
def power_transform(spark, sf):
    numbers = spread(_numbers(spark, sf))
    return s.fit_power(numbers, ["l_quantity", "l_extendedprice"]).transform(numbers)


@query("scaler_state", STANDARD)
def scaler_state(spark, sf):
    numbers, path = _numbers(spark, sf), scratch_path(spark, "scaler")
    s.fit_standard(numbers, NUMBERS).save(spark, path)
    return rounded(s.apply_saved(numbers, path))


@query("scaler_missing", f"SELECT {', '.join(NUMBERS)} FROM lineitem")
def scaler_missing(spark, sf):
    return s.apply_saved(_numbers(spark, sf), scratch_path(spark, "no-scaler"))


@query("pca")
def pca(spark, sf):
    frame = vectors(spark, sf)
    return s.fit_pca(frame, VECTOR_COLUMNS, 3).transform(frame).select("vec_id", "pc1", "pc2", "pc3")


@query("pca_variance", f"""SELECT {r6("regr_sxx(l_tax, l_tax) / count(*)")} AS variance FROM lineitem""")
def pca_variance(spark, sf):
    # On one column the component is the centred column itself.
    frame = _numbers(spark, sf)
    score = s.fit_pca(frame, ["l_tax"], 1).transform(frame)
    return rounded(score.agg(F.var_pop("pc1").alias("variance")))


@query("train_test_split")
def train_test_split(spark, sf):
    train, test = s.train_test_split(lineitem(spark, sf), ["row_key"], 0.33)
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "undersample_majority",
    """SELECT l_returnflag, (SELECT min(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)) AS n
       FROM lineitem GROUP BY 1""",
)
def undersample_majority(spark, sf):
    rows = lineitem(spark, sf, "l_returnflag")
    even = s.undersample_majority(rows, "l_returnflag", ["row_key"])
    return even.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "undersample_minority",
    """SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN count(*) // 10 ELSE count(*) END AS n
       FROM lineitem GROUP BY 1""",
)
def undersample_minority(spark, sf):
    rows = lineitem(spark, sf, "l_returnflag")
    fewer = s.undersample_class(rows, "l_returnflag", "A", ["row_key"])
    return fewer.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("prep_train_test")
def prep_train_test(spark, sf):
    rows = lineitem(spark, sf, "l_returnflag")
    train, test = s.prep_train_test(
        rows, "l_returnflag", ["row_key"], drop=["l_tax"], balance="not minority", components=2
    )
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
