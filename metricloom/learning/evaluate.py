"""Scores of predictions. Hard-label scores all come from one count of (label, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators.ranking import running


def confusion(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(
        *[q(c) for c in by],
        q(label).cast("string").alias("label"),
        q(prediction).cast("string").alias("prediction"),
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, classes: Sequence[str]
) -> DataFrame:
    """One row per true class, one column per predicted class."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("prediction") == c, F.col("n"))), F.lit(0)).alias(c)
        for c in classes
    ]
    return confusion(df, label, prediction).groupBy("label").agg(*cells)


def class_counts(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """Per class tp, fp, fn, tn, support and predicted count."""
    groups = [q(c) for c in by]
    cells = confusion(df, label, prediction, by)
    sides = F.inline(
        F.array(
            F.struct(F.col("label").alias("class"), F.col("n").alias("sup"), F.lit(0).alias("prd"),
                     F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).alias("sup"), F.col("n").alias("prd"),
                     F.lit(0).cast("long").alias("hit")),
        )
    )
    per = cells.select(*groups, sides).groupBy(*groups, "class").agg(
        F.sum("hit").alias("tp"), F.sum("sup").alias("support"), F.sum("prd").alias("predicted")
    )
    # One row per class: few enough for one window.
    total = F.sum("support").over(Window.partitionBy(*(groups or [F.lit(0)])))
    fp, fn = F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    return per.withColumn("total", total).select(
        *groups, "class", "tp", fp.alias("fp"), fn.alias("fn"),
        (F.col("total") - F.col("tp") - fp - fn).alias("tn"), "support", "predicted", "total",
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def _prf() -> tuple[Column, Column, Column]:
    tp = F.col("tp")
    return (
        _ratio(tp, F.col("predicted")),
        _ratio(tp, F.col("support")),
        _ratio(2 * tp, F.col("predicted") + F.col("support")),
    )


def multilabel_confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return class_counts(df, label, prediction).select("class", "tn", "fp", "fn", "tp")


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class, then accuracy, macro and support-weighted averages."""
    precision, recall, f1 = _prf()
    per = class_counts(df, label, prediction).select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        "support", "tp",
    )
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = per.agg(*[F.avg(n).alias(n) for n in names], total.alias("support"))
    weighted = per.agg(
        *[(F.sum(F.col(n) * F.col("support")) / total).alias(n) for n in names],
        total.alias("support"),
    )
    accuracy = per.agg(*[(F.sum("tp") / total).alias(n) for n in names], total.alias("support"))
    out = per.drop("tp")
    for title, row in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(row.withColumn("class", F.lit(title)))
    return out


def imbalanced_report(df: DataFrame, label: str, prediction: str, alpha: float = 0.1) -> DataFrame:
    """Precision, recall, specificity, f1, geometric mean and index balanced accuracy."""
    precision, recall, f1 = _prf()
    specificity = _ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return class_counts(df, label, prediction).select(
        "class", precision.alias("pre"), recall.alias("rec"), specificity.alias("spe"),
        f1.alias("f1"), F.sqrt(recall * specificity).alias("geo"),
        ((1 + alpha * (recall - specificity)) * recall * specificity).alias("iba"),
        F.col("support").alias("sup"),
    )


def scores(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Hard-label scores, in one row (per group of ``by``)."""
    _, recall, f1 = _prf()
    tp, support, predicted = (F.col(c).cast("double") for c in ("tp", "support", "predicted"))
    total = F.max("total").cast("double")
    jaccard = _ratio(tp, support + predicted - tp)
    right = F.sum(tp)
    chance = F.sum(support * predicted)
    spread = F.sqrt(
        (total * total - F.sum(predicted * predicted)) * (total * total - F.sum(support * support))
    )
    return class_counts(df, label, prediction, by).groupBy(*[q(c) for c in by]).agg(
        (right / total).alias("accuracy"),
        F.avg(F.when(support > 0, recall)).alias("balanced_accuracy"),
        (F.sum(f1 * support) / total).alias("f1_weighted"),
        (right / (2 * total - right)).alias("jaccard_micro"),
        F.avg(jaccard).alias("jaccard_macro"),
        (F.sum(jaccard * support) / total).alias("jaccard_weighted"),
        _ratio(right / total - chance / (total * total), 1 - chance / (total * total)).alias("kappa"),
        _ratio(right * total - chance, spread).alias("mcc"),
    )


def brier_score(df: DataFrame, positive: Column, probability: str) -> DataFrame:
    gap = q(probability) - positive.cast("double")
    return df.agg(F.avg(gap * gap).alias("brier"))


def threshold_sweep(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Per distinct score, highest first: rows and positives at or above it.

    Equal scores are one row before they are put in order, so no score is too frequent
    and no task orders all rows.
    """
    counts = df.groupBy(q(score).alias("threshold")).agg(
        F.sum(positive.cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    return running(
        counts, ["threshold"], {"tp": F.col("pos"), "flagged": F.col("n")}, descending=True
    )


def _class_totals(df: DataFrame, positive: Column) -> tuple[int, int]:
    """Positives and negatives."""
    flag = positive.cast("long")
    row = df.agg(F.sum(flag), F.sum(1 - flag)).first()
    return row[0] or 0, row[1] or 0


def _share(top: Column, total: int) -> Column:
    return top / F.lit(float(total)) if total else F.lit(0.0)


def pr_curve(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Rows without a score take no part, in the totals neither."""
    df = df.where(q(score).isNotNull())
    positives, _ = _class_totals(df, positive)
    return threshold_sweep(df, positive, score).select(
        "threshold",
        (F.col("tp") / F.col("flagged")).alias("precision"),
        _share(F.col("tp"), positives).alias("recall"),
    )


def roc_curve(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Rows without a score take no part, in the totals neither."""
    df = df.where(q(score).isNotNull())
    positives, negatives = _class_totals(df, positive)
    return threshold_sweep(df, positive, score).select(
        "threshold",
        _share(F.col("flagged") - F.col("tp"), negatives).alias("fpr"),
        _share(F.col("tp"), positives).alias("tpr"),
    )


def ranking_scores(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision, in one row.

    Rows without a score take no part.
    """
    df = df.where(q(score).isNotNull())
    positives, negatives = _class_totals(df, positive)
    # Negatives of a score lie below all positives of higher scores, and level with its own.
    wins = (F.col("n") - F.col("pos")).cast("double") * (F.col("tp") - F.col("pos") / 2)
    precision = F.col("pos") * F.col("tp") / F.col("flagged")
    return threshold_sweep(df, positive, score).agg(
        _share(_share(F.sum(wins), positives), negatives).alias("roc_auc"),
        _share(F.sum(precision), positives).alias("average_precision"),
    )


def roc_auc_ovr(df: DataFrame, label: str, probabilities: dict[str, str]) -> DataFrame:
    """Support-weighted one-vs-rest area; ``probabilities`` names each class's column.

    All classes share one aggregation by class and score and one running sum. Rows without a
    label take no part, nor do those without a class's score in that class's area.
    """
    own = q(label).cast("string")
    cells = [
        F.struct(F.lit(name).alias("class"), q(column).cast("double").alias("threshold"), (own == name).cast("long").alias("pos"))
        for name, column in probabilities.items()
    ]
    long = df.where(own.isNotNull()).select(F.inline(F.array(*cells)))
    counts = long.groupBy("class", "threshold").agg(F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    # Missing scores come last, so that they leave the sums before them alone.
    swept = running(counts, ["threshold"], {"tp": F.col("pos")}, by=["class"], descending=True)
    known, negative = F.col("threshold").isNotNull(), F.col("n") - F.col("pos")
    wins = negative.cast("double") * (F.col("tp") - F.col("pos") / 2)
    pairs = F.sum(F.when(known, F.col("pos"))).cast("double") * F.sum(F.when(known, negative))
    areas = swept.groupBy("class").agg(
        F.coalesce(_ratio(F.sum(F.when(known, wins)), pairs), F.lit(0.0)).alias("area"),
        F.sum("pos").alias("size"),
    )
    return areas.agg((F.sum(F.col("area") * F.col("size")) / F.sum("size")).alias("roc_auc_ovr_weighted"))
