"""Fitted models on tasks with a known answer, and what every fitted model must keep, with SQL."""

from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.learning import explain, grids, selection, store, supervised, tree_shapley
from metricloom.operators import outliers, training_labels
from metricloom.operators import scale as s
from metricloom.operators.analysis import pca_projection
from metricloom.operators.ranking import running
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.learning import CLASSES, TARGET, rows_of
from metricloom.plans.catalog.outliers import _bins, _ends
from metricloom.plans.catalog.registry import query
from metricloom.session import scratch_path, spread

# --- components in closed form ------------------------------------------------------------

# Two columns that go together: their components are an angle, after scaling half a right one.
PAIR = ["x", "y"]
SQL_PAIR = "pair AS (SELECT l_returnflag, l_quantity AS x, l_quantity + 200 * l_tax AS y FROM lineitem)"
SQL_SCALED = SQL_PAIR + """, scaled AS (SELECT l_returnflag, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x,
    (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM pair)"""


def _pair(spark, sf):
    rows = lineitem(spark, sf, "l_returnflag")
    return rows.select("l_returnflag", q("l_quantity").alias("x"), (q("l_quantity") + 200 * q("l_tax")).alias("y"))


@query(
    "pca_pair",
    f"""WITH {SQL_PAIR}, m AS (SELECT avg(x) AS mx, avg(y) AS my, atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)) / 2 AS t FROM pair)
        SELECT {r6("x")} AS x, {r6("y")} AS y, {r6("cos(t) * (x - mx) + sin(t) * (y - my)")} AS pc1, {r6("sin(t) * (x - mx) - cos(t) * (y - my)")} AS pc2 FROM pair, m""",
)
def pca_pair(spark, sf):
    pair = _pair(spark, sf)
    return rounded(s.fit_pca(pair, PAIR, 2).transform(pair).drop("l_returnflag"))


@query(
    "pca_projection_pair",
    f"WITH {SQL_SCALED} SELECT l_returnflag, {r6('(x + y) / sqrt(2)')} AS pc1, {r6('abs(x - y) / sqrt(2)')} AS pc2 FROM scaled",
)
def pca_projection_pair(spark, sf):
    flat = pca_projection(_pair(spark, sf), PAIR, "l_returnflag")
    return rounded(flat.withColumn("pc2", F.abs("pc2")))


@query("reconstruction_error_pair", f"WITH {SQL_SCALED} SELECT l_returnflag, {r6('abs(x - y) / sqrt(2)', 5)} AS score FROM scaled")
def reconstruction_error_pair(spark, sf):
    scored = outliers.reconstruction_error(_pair(spark, sf), PAIR, 1)
    return rounded(scored.select("l_returnflag", "score"), 5)


# --- scaling and splitting ----------------------------------------------------------------


@query("train_test_parts", "SELECT count(*) AS n, true AS near, CAST(0 AS BIGINT) AS shared FROM lineitem")
def train_test_parts(spark, sf):
    """Every row is in one part, and the test part is about as large as asked."""
    train, test = s.train_test_split(lineitem(spark, sf), ["row_key"], 0.33)
    both = train.select("row_key", F.lit(0).alias("t")).unionByName(test.select("row_key", F.lit(1).alias("t")))
    keys = both.groupBy("row_key").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    n, tested = F.sum("n"), F.sum("t")
    near = F.abs(tested - n * 0.33) <= 6 * F.sqrt(n * 0.33 * 0.67)
    return keys.agg(n.alias("n"), near.alias("near"), F.count_if((q("t") > 0) & (q("t") < q("n"))).alias("shared"))


@query(
    "prep_train_test_scaled",
    f"""SELECT {", ".join(f"CAST(0 AS DOUBLE) AS mean_{i}, CAST(1 AS DOUBLE) AS variance_{i}" for i in range(3))},
        count(*) AS n FROM lineitem WHERE l_returnflag <> 'N'""",
)
def prep_train_test_scaled(spark, sf):
    """Training rows are standard; the rows of the class to be skipped are gone."""
    rows = lineitem(spark, sf, "l_returnflag")
    train, test = s.prep_train_test(rows, "l_returnflag", ["row_key"], drop=["l_tax"], skip_classes=["N"])
    cells = []
    for i, c in enumerate(NUMBERS[:3]):
        cells += [F.avg(q(c)).alias(f"mean_{i}"), F.var_pop(q(c)).alias(f"variance_{i}")]
    n = test.agg(F.count(F.lit(1)).alias("tested"))
    return rounded(train.agg(*cells, F.count(F.lit(1)).alias("n")).crossJoin(n).withColumn("n", q("n") + q("tested")).drop("tested"))


@query(
    "power_transform_standard",
    f"""SELECT {", ".join(f"CAST(0 AS DOUBLE) AS mean_{c}, CAST(1 AS DOUBLE) AS variance_{c}" for c in NUMBERS)},
        CAST(0 AS BIGINT) AS falls, count(*) AS n FROM lineitem""",
)
def power_transform_standard(spark, sf):
    """All columns get mean 0 and variance 1, and keep their order."""
    numbers = spread(lineitem(spark, sf).select(*NUMBERS))
    raw = [q(c).alias(f"raw_{c}") for c in NUMBERS]
    out = s.fit_power(numbers, NUMBERS).transform(numbers.select(*NUMBERS, *raw))
    # Values in ascending order before and after, one row for each distinct value of a column.
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("c"), q(f"raw_{c}").alias("raw"), q(c).alias("to")) for c in NUMBERS]))
    steps = running(out.select(pairs).distinct(), ["raw"], {"at": F.lit(1).cast("long")}, by=["c"])
    back = running(steps, ["to"], {"then": F.lit(1).cast("long")}, by=["c"])
    falls = back.agg(F.count_if(q("at") != q("then")).alias("falls"))
    cells = []
    for c in NUMBERS:
        cells += [F.avg(q(c)).alias(f"mean_{c}"), F.var_pop(q(c)).alias(f"variance_{c}")]
    return rounded(out.agg(*cells, F.count(F.lit(1)).alias("n")).crossJoin(falls))


# --- detectors ----------------------------------------------------------------------------


@query(
    "hbos_flagged",
    f"""WITH bins AS ({" UNION ALL ".join(_bins(c) for c in NUMBERS)}),
    scored AS (SELECT {", ".join(NUMBERS)}, {" + ".join(f"{c}_b.s" for c in NUMBERS)} AS score FROM lineitem
      CROSS JOIN {" CROSS JOIN ".join(_ends(c) for c in NUMBERS)}
      {" ".join(f"JOIN bins {c}_b ON {c}_b.f = '{c}' AND {c}_b.bin = least(floor(({c} - {c}_e.low) / {c}_e.width), 9)" for c in NUMBERS)})
    SELECT {", ".join(NUMBERS)}, {r6("score")} AS score FROM scored WHERE score > (SELECT quantile_cont(score, 0.95) FROM scored)""",
)
def hbos_flagged(spark, sf):
    rows = lineitem(spark, sf).drop("row_key")
    scored = outliers.fit_hbos(rows, NUMBERS).score(rows)
    return rounded(outliers.flag_top(scored, 0.05).where("prediction = 1").drop("prediction"))


def _far(spark, sf):
    """Line items, one in about a thousand far off in all numbers."""
    rows = spread(lineitem(spark, sf, "l_orderkey"), "row_key")
    planted = q("l_orderkey") % 1000 == 7
    far = (1 + q("l_orderkey") % 7) * 1e6
    return rows.select("row_key", planted.cast("int").alias("planted"), *[F.when(planted, q(c) + far).otherwise(q(c)).alias(c) for c in NUMBERS])


def _far_forest(rows):
    n, odd = rows.agg(F.count(F.lit(1)), F.sum("planted")).first()
    return outliers.fit_isolation_forest(
        rows, NUMBERS, ["row_key"], 15, max_samples=1.0, contamination=(odd - 0.5) / n
    )


PLANTED = """SELECT CAST(l_orderkey % 1000 = 7 AS INTEGER) AS planted,
    CASE WHEN l_orderkey % 1000 = 7 THEN -1 ELSE 1 END AS found, count(*) AS n FROM lineitem GROUP BY 1, 2"""


@query("append_predictions_planted", PLANTED)
def append_predictions_planted(spark, sf):
    rows = _far(spark, sf)
    labelled = training_labels.append_predictions(rows, _far_forest(rows), scratch_path(spark, "labelled"))
    return labelled.groupBy("planted", q("ano").alias("found")).agg(F.count(F.lit(1)).alias("n"))


@query("model_store_forest_planted", PLANTED)
def model_store_forest_planted(spark, sf):
    rows, path = _far(spark, sf), store.model_path(scratch_path(spark, "models"), "isolation_forest", "far")
    store.save_forest(spark, _far_forest(rows), path)
    judged = store.load_forest(spark, path).predict(rows)
    return judged.groupBy("planted", q("prediction").alias("found")).agg(F.count(F.lit(1)).alias("n"))


# Two groups far off, near to themselves: each is a class, numbered by its first key; others are 0.
@query(
    "generate_training_labels_planted",
    """WITH g AS (SELECT o_orderkey, CASE o_orderkey % 500 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS kind FROM orders),
       h AS (SELECT kind, row_number() OVER (ORDER BY min(o_orderkey)) AS target FROM g WHERE kind > 0 GROUP BY 1)
       SELECT o_orderkey, CAST(coalesce(target, 0) AS INTEGER) AS target FROM g LEFT JOIN h USING (kind)""",
)
def generate_training_labels_planted(spark, sf):
    orders = table(spark, sf, "orders")
    kind = q("o_orderkey") % 500
    moved = F.when(kind == 3, F.lit(1e8)).when(kind == 4, F.lit(-1e8)).otherwise(F.lit(0.0))
    rows = spread(orders.select("o_orderkey", (q("o_totalprice") + moved).alias("price"), (q("o_custkey") + moved).alias("customer")), "o_orderkey")
    n, odd = rows.agg(F.count(F.lit(1)), F.count_if(F.abs("price") > 5e7)).first()
    labelled = training_labels.generate_training_labels(
        rows, ["price", "customer"], "o_orderkey", eps=0.5, min_samples=2,
        contamination=(odd - 0.5) / n, n_estimators=20, max_samples=1.0,
    )
    return labelled.select("o_orderkey", q("target").cast("int").alias("target"))


# --- classifiers --------------------------------------------------------------------------

WHOLE = "SELECT count(*) AS n, count(*) AS whole, count(*) AS chosen, true AS better FROM lineitem"
MODELS = {
    "random_forest": {"numTrees": 10, "maxDepth": 5},
    "decision_tree": {"maxDepth": 5},
    "adaboost": {"n_estimators": 3, "max_depth": 2},
    "mlp": {"hidden": (8,), "maxIter": 15},
}


def _whole(name):
    def run(spark, sf):
        rows = rows_of(spark, sf)
        rows = s.fit_standard(rows, NUMBERS).transform(rows) if name == "mlp" else rows
        judged = supervised.fit_classifier(rows, NUMBERS, TARGET, name, **MODELS[name]).append(rows)
        probs = F.array(*[q(f"prob_{i}") for i in range(len(CLASSES))])
        total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
        own = F.element_at(probs, F.array_position(F.array(*[F.lit(c) for c in CLASSES]), q("pred")).cast("int"))
        most = F.greatest(*[F.count_if(q(TARGET) == c) for c in CLASSES])
        return judged.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) < 1e-9).alias("whole"),
            F.count_if(own >= F.array_max(probs) - 1e-12).alias("chosen"),
            (F.count_if(q("pred") == q(TARGET)) > most).alias("better"),
        )

    run.__doc__ = "Probabilities add up to one, the class is the likeliest, and more is right than by the largest class."
    return run


for _name in MODELS:
    query(f"clf_{_name}_probabilities", WHOLE)(_whole(_name))

# A class by rule, which a tree of two levels can tell without error.
USEFUL = ["l_quantity", "l_discount"]
SQL_RULE = "CASE WHEN l_quantity <= 25 THEN 'low' WHEN l_discount <= 0.05 THEN 'mid' ELSE 'top' END"
EXACT = {"maxDepth": 2, "maxBins": 128}


def _ruled(spark, sf):
    rows = spread(lineitem(spark, sf), "row_key")
    return rows.withColumn("rule", F.expr(SQL_RULE))


def _rule_splits(spark, sf, k=2):
    return selection.fold_pairs(selection.stratified_folds(_ruled(spark, sf), "rule", ["row_key"], k), k)


SQL_FOUND = f"SELECT l_quantity, l_discount, {SQL_RULE} AS pred, count(*) AS n FROM lineitem GROUP BY ALL"


def _found(judged):
    return judged.groupBy("l_quantity", "l_discount", "pred").agg(F.count(F.lit(1)).alias("n"))


@query("clf_decision_tree_rule", SQL_FOUND)
def clf_decision_tree_rule(spark, sf):
    rows = _ruled(spark, sf)
    return _found(supervised.fit_classifier(rows, NUMBERS, "rule", "decision_tree", **EXACT).append(rows))


@query("model_store_rule", SQL_FOUND)
def model_store_rule(spark, sf):
    rows = _ruled(spark, sf)
    path = store.model_path(scratch_path(spark, "models"), "decision_tree", "rule")
    store.save_classifier(spark, supervised.fit_classifier(rows, NUMBERS, "rule", "decision_tree", **EXACT), path)
    return _found(store.load_classifier(spark, path).append(rows))


@query("cross_validate_rule", "SELECT unnest(range(3)) AS fold, CAST(1 AS DOUBLE) AS test_accuracy, CAST(1 AS DOUBLE) AS train_mcc")
def cross_validate_rule(spark, sf):
    rows, _ = selection.cross_validate(
        _rule_splits(spark, sf, 3), NUMBERS, "rule", "decision_tree", EXACT, train_scores=True
    )
    return selection.score_table(spark, [{k: r[k] for k in ("fold", "test_accuracy", "train_mcc")} for r in rows])


ONE = "CAST(1 AS DOUBLE)"


@query("learning_curve_rule", f"SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE]) AS size, {ONE} AS train_score, {ONE} AS test_score")
def learning_curve_rule(spark, sf):
    splits = _rule_splits(spark, sf)
    return selection.score_table(spark, selection.learning_curve(splits, ["row_key"], [0.5, 1.0], NUMBERS, "rule", "decision_tree", EXACT))


@query(
    "validation_curve_rule",
    "SELECT 'maxDepth' AS param, unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS value, unnest([false, true]) AS right_on_all",
)
def validation_curve_rule(spark, sf):
    curve = selection.validation_curve(_rule_splits(spark, sf), "maxDepth", [1, 2], NUMBERS, "rule", "decision_tree", {"maxBins": 128})
    return selection.score_table(spark, [{"param": r["param"], "value": r["value"], "right_on_all": r["test_score"] == 1.0} for r in curve])


@query("rfe_rule", "SELECT unnest(['l_quantity', 'l_discount', 'l_extendedprice', 'l_tax']) AS feature, unnest([true, true, false, false]) AS mask")
def rfe_rule(spark, sf):
    found = selection.rfe(_rule_splits(spark, sf), NUMBERS, "rule", "decision_tree", EXACT)
    return selection.score_table(spark, [{"feature": r["feature"], "mask": r["mask"]} for r in found])


@query(
    "feature_importance_rule",
    "SELECT unnest(['l_quantity', 'l_discount', 'l_extendedprice', 'l_tax']) AS feature, unnest([true, true, false, false]) AS used, true AS adds_up",
)
def feature_importance_rule(spark, sf):
    model = supervised.fit_classifier(_ruled(spark, sf), NUMBERS, "rule", "decision_tree", **EXACT)
    found = selection.feature_importance(model)
    total = abs(sum(r["importance"] for r in found) - 1) < 1e-9
    return selection.score_table(spark, [{"feature": r["feature"], "used": r["importance"] > 0, "adds_up": total} for r in found])


DEPTHS = {"maxDepth": [1, 2], "maxBins": [128]}


def _searched(name, run, sql):
    def go(spark, sf):
        search = selection.Search(_rule_splits(spark, sf), NUMBERS, "rule", "decision_tree")
        table_rows = [{"settings": r["settings"], "right_on_all": r["f1_weighted"] == 1.0} for r in run(search)]
        return selection.score_table(spark, table_rows).where("right_on_all")

    query(name, sql)(go)


BEST = "SELECT 'maxBins=128, maxDepth=2' AS settings, true AS right_on_all"
_searched("hpo_grid_rule", lambda search: selection.hpo_grid(search, DEPTHS), BEST)
_searched("hpo_random_rule", lambda search: selection.hpo_random(search, DEPTHS, 2), BEST)
_searched("hpo_evolution_rule", lambda search: selection.hpo_evolution(search, DEPTHS, population=4, generations=2), BEST)


@query("model_search_rule", f"SELECT unnest(['StandardScaler', 'none']) AS scaler, 'decision_tree' AS model, {ONE} AS f1_weighted")
def model_search_rule(spark, sf):
    found = selection.model_search(
        _rule_splits(spark, sf), NUMBERS, "rule", [None, "StandardScaler"], [0],
        {"decision_tree": {"maxDepth": [1, 2], "maxBins": [128]}}, n_iter=4,
    )
    kept = [{k: r[k] for k in ("scaler", "model", "f1_weighted")} for r in found if "maxDepth=2" in r["settings"]]
    return selection.score_table(spark, kept)


@query("decision_grid_rule", "SELECT a / 20.0::DOUBLE AS l_discount, b * 2.5::DOUBLE AS l_quantity, CASE WHEN b * 2.5 <= 25 THEN 'low' WHEN a <= 1 THEN 'mid' ELSE 'top' END AS pred FROM range(21) AS x(a), range(21) AS y(b)")
def decision_grid_rule(spark, sf):
    """The mesh answered by a tree that has learnt the rule; its cuts lie between the values met."""
    rows = _ruled(spark, sf)
    model = supervised.fit_classifier(rows, USEFUL, "rule", "decision_tree", **EXACT)
    mesh = grids.decision_grid(spark, model.append, USEFUL, (0.0, 50.0), (0.0, 1.0), 21)
    return rounded(mesh.select(*USEFUL, "pred"))


# --- explanations -------------------------------------------------------------------------

# A tree of one cut gives its feature 1 - p above it and -p below, p being the share above.
SQL_PHI = """phi AS (SELECT f.feature, above, CASE WHEN f.feature <> 'l_quantity' THEN 0 WHEN above THEN 1 - p ELSE -p END AS phi
    FROM (SELECT l_quantity > 25 AS above, avg(CAST(l_quantity > 25 AS INTEGER)) OVER () AS p FROM lineitem),
      (SELECT unnest(['l_quantity', 'l_discount', 'l_extendedprice', 'l_tax']) AS feature) AS f)"""


def _phi(spark, sf):
    rows = spread(lineitem(spark, sf), "row_key").withColumn("above", (q("l_quantity") > 25).cast("string"))
    model = supervised.fit_classifier(rows, NUMBERS, "above", "decision_tree", maxDepth=1, maxBins=128)
    explained = tree_shapley.tree_shapley(rows, ["row_key", "above"], tree_shapley.of_classifier(model, "true"))
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(q("analysis")[f], F.lit(0.0)).alias("phi")) for f in NUMBERS]))
    return explained.select((q("above") == "true").alias("above"), cells)


@query("shap_importance_rule", f"WITH {SQL_PHI} SELECT feature, {r6('avg(abs(phi))')} AS importance FROM phi GROUP BY 1")
def shap_importance_rule(spark, sf):
    return rounded(explain.outlier_importance(_phi(spark, sf)))


@query("shap_class_importance_rule", f"WITH {SQL_PHI} SELECT above, feature, {r6('sum(phi)', 4)} AS importance FROM phi GROUP BY 1, 2")
def shap_class_importance_rule(spark, sf):
    return rounded(explain.class_importance(_phi(spark, sf), "above"), 4)


@query("shap_rows_add_up", "SELECT CAST(0 AS DOUBLE) AS gap, count(*) FILTER (WHERE l_orderkey % 1000 = 7) AS n FROM lineitem")
def shap_rows_add_up(spark, sf):
    """Values of sampled coalitions, with the base value, are the model's own score."""
    rows = _far(spark, sf)
    forest = _far_forest(rows)
    flagged = forest.predict(rows).where("prediction = -1").withColumnRenamed("score", "said").drop("prediction")
    background = explain.background_rows(rows, NUMBERS, ["row_key"], 8)
    values = explain.shapley_rows(flagged, NUMBERS, "row_key", forest.score, background, 2)
    sums = values.groupBy("row_key", "base_value").agg(F.sum("phi").alias("phi"))
    gaps = sums.join(flagged.select("row_key", "said"), "row_key")
    gap = F.round(F.max(F.abs(q("phi") + q("base_value") - q("said"))), 9) + F.lit(0.0)
    return gaps.agg(gap.alias("gap"), F.count(F.lit(1)).alias("n"))
