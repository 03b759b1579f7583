"""Evaluation queries on rule-based predictions, so that SQL can follow them."""

from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.learning import evaluate as e
from metricloom.learning import selection
from metricloom.plans.catalog.inputs import *  # noqa: F403
from metricloom.plans.catalog.registry import query

CLASSES = ["A", "N", "R"]

SQL_JUDGED = """judged AS (SELECT l_returnflag AS label, l_extendedprice, l_quantity / 50 AS score,
    CASE WHEN l_quantity <= 15 THEN 'A' WHEN l_quantity <= 35 THEN 'N' ELSE 'R' END AS prediction FROM lineitem)"""

SQL_PER = (
    SQL_JUDGED
    + """, per AS (SELECT c AS class,
    count(*) FILTER (WHERE label = c AND prediction = c) AS tp, count(*) FILTER (WHERE label <> c AND prediction = c) AS fp,
    count(*) FILTER (WHERE label = c AND prediction <> c) AS fn, count(*) FILTER (WHERE label <> c AND prediction <> c) AS tn,
    count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS predicted, count(*) AS total
    FROM judged, (SELECT unnest(['A', 'N', 'R']) AS c) GROUP BY 1),
  rates AS (SELECT *, tp / predicted AS precision, tp / support AS recall, 2 * tp / (predicted + support) AS f1,
    tn / (tn + fp) AS spe FROM per)"""
)


def judged(spark, sf):
    rows = table(spark, sf, "lineitem")
    guess = F.when(q("l_quantity") <= 15, "A").when(q("l_quantity") <= 35, "N").otherwise("R")
    return rows.select(
        q("l_returnflag").alias("label"), "l_extendedprice", (q("l_quantity") / 50).alias("score"),
        guess.alias("prediction"),
    )


@query("confusion_counts", f"WITH {SQL_JUDGED} SELECT label, prediction, count(*) AS n FROM judged GROUP BY 1, 2")
def confusion_counts(spark, sf):
    return e.confusion(judged(spark, sf), "label", "prediction")


@query(
    "confusion_matrix",
    f"""WITH {SQL_JUDGED} SELECT label, {", ".join(f"count(*) FILTER (WHERE prediction = '{c}') AS {c}" for c in CLASSES)}
        FROM judged GROUP BY 1""",
)
def confusion_matrix(spark, sf):
    return e.confusion_matrix(judged(spark, sf), "label", "prediction", CLASSES)


@query("confusion_multilabel", f"WITH {SQL_PER} SELECT class, tn, fp, fn, tp FROM per")
def confusion_multilabel(spark, sf):
    return e.multilabel_confusion(judged(spark, sf), "label", "prediction")


@query(
    "scores",
    f"""WITH {SQL_PER}, s AS (SELECT sum(tp)::DOUBLE AS c, max(total)::DOUBLE AS n,
          sum(support::DOUBLE * predicted) AS pe, sum(predicted::DOUBLE * predicted) AS pp, sum(support::DOUBLE * support) AS ss,
          avg(recall) AS bal, sum(f1 * support) / max(total) AS f1w, avg(tp / (support + predicted - tp)) AS jm,
          sum(tp / (support + predicted - tp) * support) / max(total) AS jw FROM rates)
        SELECT {r6("c / n")} AS accuracy, {r6("bal")} AS balanced_accuracy, {r6("f1w")} AS f1_weighted,
          {r6("c / (2 * n - c)")} AS jaccard_micro, {r6("jm")} AS jaccard_macro, {r6("jw")} AS jaccard_weighted,
          {r6("(c / n - pe / n / n) / (1 - pe / n / n)")} AS kappa,
          {r6("(c * n - pe) / sqrt((n * n - pp) * (n * n - ss))")} AS mcc FROM s""",
)
def scores(spark, sf):
    return rounded(e.scores(judged(spark, sf), "label", "prediction"))


@query("brier", f"WITH {SQL_JUDGED} SELECT {r6('avg(pow(score - (label = chr(82))::INT, 2))')} AS brier FROM judged")
def brier(spark, sf):
    return rounded(e.brier_score(judged(spark, sf), q("label") == "R", "score"))


@query(
    "classification_report",
    f"""WITH {SQL_PER} SELECT class, {sql_rounded(["precision", "recall", "f1"])}, support FROM rates
        UNION ALL SELECT 'accuracy', {", ".join([r6("sum(tp) / sum(support)")] * 3)}, CAST(sum(support) AS BIGINT) FROM rates
        UNION ALL SELECT 'macro avg', {", ".join(r6(f"avg({c})") for c in ("precision", "recall", "f1"))}, CAST(sum(support) AS BIGINT) FROM rates
        UNION ALL SELECT 'weighted avg', {", ".join(r6(f"sum({c} * support) / sum(support)") for c in ("precision", "recall", "f1"))},
          CAST(sum(support) AS BIGINT) FROM rates""",
)
def classification_report(spark, sf):
    return rounded(e.classification_report(judged(spark, sf), "label", "prediction"))


@query(
    "imbalanced_report",
    f"""WITH {SQL_PER} SELECT class, {r6("precision")} AS pre, {r6("recall")} AS rec, {r6("spe")} AS spe, {r6("f1")} AS f1,
        {r6("sqrt(recall * spe)")} AS geo, {r6("(1 + 0.1 * (recall - spe)) * recall * spe")} AS iba, support AS sup FROM rates""",
)
def imbalanced_report(spark, sf):
    return rounded(e.imbalanced_report(judged(spark, sf), "label", "prediction"))


def _swept(score: str) -> str:
    return f"""{SQL_JUDGED}, d AS (SELECT {score} AS threshold, count(*) AS n, count(*) FILTER (WHERE label = 'R') AS pos
        FROM judged GROUP BY 1),
      w AS (SELECT threshold, n, pos, sum(pos) OVER o AS tp, sum(n) OVER o AS flagged, sum(pos) OVER () AS p, sum(n) OVER () AS t
        FROM d WINDOW o AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""


@query(
    "pr_curve",
    f"""WITH {_swept("l_extendedprice")} SELECT threshold, {r6("tp / flagged")} AS precision, {r6("tp / p")} AS recall FROM w""",
)
def pr_curve(spark, sf):
    return rounded(e.pr_curve(judged(spark, sf), q("label") == "R", "l_extendedprice"))


@query(
    "roc_curve",
    f"""WITH {_swept("score")} SELECT {r6("threshold")} AS threshold, {r6("(flagged - tp) / (t - p)")} AS fpr, {r6("tp / p")} AS tpr FROM w""",
)
def roc_curve(spark, sf):
    return rounded(e.roc_curve(judged(spark, sf), q("label") == "R", "score"))


@query(
    "ranking_scores",
    f"""WITH {_swept("score")}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM judged)
        SELECT (SELECT {r6("(sum(rk) FILTER (WHERE label = 'R') - count(*) FILTER (WHERE label = 'R') * (count(*) FILTER (WHERE label = 'R') + 1) / 2) / (count(*) FILTER (WHERE label = 'R') * count(*) FILTER (WHERE label <> 'R'))")} FROM r) AS roc_auc,
          (SELECT {r6("sum(pos / p * tp / flagged)")} FROM w) AS average_precision""",
)
def ranking_scores(spark, sf):
    return rounded(e.ranking_scores(judged(spark, sf), q("label") == "R", "score"))


def _auc(c: str, score: str) -> str:
    return f"""SELECT count(*) FILTER (WHERE label = '{c}') AS size, (sum(rk) FILTER (WHERE label = '{c}') - size * (size + 1) / 2) / (size * (count(*) - size)) AS auc
        FROM (SELECT label, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS rk FROM judged)"""


@query(
    "roc_auc_ovr",
    f"""WITH {SQL_JUDGED}, a AS ({_auc("A", "1 - score")} UNION ALL {_auc("N", "1 - abs(score - 0.5)")} UNION ALL {_auc("R", "score")})
        SELECT {r6("sum(auc * size) / sum(size)")} AS roc_auc_ovr_weighted FROM a""",
)
def roc_auc_ovr(spark, sf):
    rows = judged(spark, sf).select(
        "label", (1 - q("score")).alias("pa"), (1 - F.abs(q("score") - 0.5)).alias("pn"),
        q("score").alias("pr"),
    )
    return rounded(e.roc_auc_ovr(rows, "label", {"A": "pa", "N": "pn", "R": "pr"}))


@query(
    "cv_folds",
    """SELECT l_returnflag, CAST(f AS INTEGER) AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS n
       FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), (SELECT range AS f FROM range(5))""",
)
def cv_folds(spark, sf):
    rows = lineitem(spark, sf, "l_returnflag")
    folds = selection.stratified_folds(rows, "l_returnflag", ["row_key"], 5)
    return folds.groupBy("l_returnflag", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cv_kfold",
    """SELECT CAST(f AS INTEGER) AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS n
       FROM (SELECT count(*) AS n FROM lineitem), (SELECT range AS f FROM range(5))""",
)
def cv_kfold(spark, sf):
    folds = selection.k_folds(lineitem(spark, sf), ["row_key"], 5)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cv_shuffle",
    """SELECT s AS split, l_returnflag, CAST(round(n * 0.25) AS BIGINT) AS n
       FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), (SELECT unnest([0, 1]) AS s)""",
)
def cv_shuffle(spark, sf):
    rows = lineitem(spark, sf, "l_returnflag")
    splits = selection.shuffle_splits(rows, "l_returnflag", ["row_key"], 2, 0.25)
    a, b = (test.withColumn("split", F.lit(i)) for i, (_, test) in enumerate(splits))
    return a.unionByName(b).groupBy("split", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "model_compare",
    f"""WITH {SQL_JUDGED}, t AS (SELECT 'rule' AS model, avg((label = prediction)::INT) AS score FROM judged
          UNION ALL SELECT 'always_n', avg((label = 'N')::INT) FROM judged)
        SELECT model, {r6("score")} AS score FROM t ORDER BY score DESC, model LIMIT 1""",
)
def model_compare(spark, sf):
    rows = judged(spark, sf)
    rates = rows.agg(
        F.avg((q("label") == q("prediction")).cast("int")).alias("rule"),
        F.avg((q("label") == "N").cast("int")).alias("always_n"),
    )
    named = rates.unpivot([], ["rule", "always_n"], "model", "score")
    return rounded(selection.model_compare(named, "model", "score"))


FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _phi(spark, sf):
    """A table shaped like Shapley values: one number per row and feature."""
    rows = lineitem(spark, sf, "l_returnflag").select("l_returnflag", *FEATURES)
    cells = [(q(c) - m).alias(c) for c, m in zip(FEATURES, (25.0, 50000.0, 0.05))]
    return rows.select("l_returnflag", *cells).unpivot(["l_returnflag"], FEATURES, "feature", "phi")


SQL_PHI = """phi AS (SELECT l_returnflag, feature, phi FROM (SELECT l_returnflag, l_quantity - 25 AS l_quantity,
    l_extendedprice - 50000 AS l_extendedprice, l_discount - 0.05::DOUBLE AS l_discount FROM lineitem)
    UNPIVOT (phi FOR feature IN (l_quantity, l_extendedprice, l_discount)))"""


@query("shap_importance", f"WITH {SQL_PHI} SELECT feature, {r6('avg(abs(phi))')} AS importance FROM phi GROUP BY 1")
def shap_importance(spark, sf):
    from metricloom.learning.explain import outlier_importance

    return rounded(outlier_importance(_phi(spark, sf)))


@query(
    "shap_class_importance",
    f"WITH {SQL_PHI} SELECT l_returnflag, feature, {r6('sum(phi)', 3)} AS importance FROM phi GROUP BY 1, 2",
)
def shap_class_importance(spark, sf):
    from metricloom.learning.explain import class_importance

    return rounded(class_importance(_phi(spark, sf), "l_returnflag"), 3)
