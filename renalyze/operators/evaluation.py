"""Classifier evaluation as aggregates.

Everything is a global partial aggregate (one row per task, then one tiny
final merge) except the ROC curve, which needs scores in order: it groups by
distinct score first (partial aggregate, so repeated scores collapse before
the shuffle) and runs the cumulative sums over the distinct scores only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Tp, fp, tn, fn, positives predicted, total."""
    y, p = F.col(label), F.col(pred)
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if(p == 1).alias("positives"),
        F.count(F.lit(1)).alias("total"),
    )


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Share of rows where prediction equals label."""
    return df.agg((F.count_if(F.col(label) == F.col(pred)) / F.count(F.lit(1))).alias("accuracy"))


def fbeta(df: DataFrame, beta: float = 3.0, zero_division: float = 0.0,
          label: str = "label", pred: str = "prediction") -> DataFrame:
    """F-beta of the positive class; ``zero_division`` when undefined."""
    c = confusion_counts(df, label, pred)
    b2 = beta * beta
    num = (1 + b2) * F.col("tp")
    den = (1 + b2) * F.col("tp") + b2 * F.col("fn") + F.col("fp")
    return c.select(F.when(den == 0, F.lit(float(zero_division)))
                     .otherwise(num.cast("double") / den.cast("double")).alias("fbeta"))


def metrics(df: DataFrame, beta: float = 3.0, zero_division: float = 0.0,
            label: str = "label", pred: str = "prediction") -> DataFrame:
    """M4 / metrics_table: accuracy, F-beta and row count in one aggregate."""
    y, p = F.col(label), F.col(pred)
    b2 = beta * beta
    tp = F.count_if((y == 1) & (p == 1))
    den = (1 + b2) * tp + b2 * F.count_if((y == 1) & (p == 0)) + F.count_if((y == 0) & (p == 1))
    return df.agg(
        (F.count_if(y == p) / F.count(F.lit(1))).alias("accuracy"),
        F.when(den == 0, F.lit(float(zero_division))).otherwise(((1 + b2) * tp).cast("double") / den).alias("fbeta"),
        F.count(F.lit(1)).alias("n_rows"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score, high to low, plus
    the origin (threshold +inf).  Ties in score form one point.

    Positives / negatives per distinct score are a partial aggregate; the
    cumulative counts come from ``prefix.running_sums`` (block-wise, exact),
    and the class totals are scalar subqueries: no step sorts the whole
    table in one task."""
    from .prefix import running_sums

    y = F.col(label)
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
    cum = running_sums(per, "threshold", ["p", "n"], descending=True)
    P = per.agg(F.sum("p")).scalar()
    N = per.agg(F.sum("n")).scalar()
    pts = cum.select("threshold",
                     F.when(N > 0, F.col("cum_n") / N).alias("fpr"),
                     F.when(P > 0, F.col("cum_p") / P).alias("tpr"))
    spark = df.sparkSession
    origin = spark.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return pts.select("threshold", "fpr", "tpr").unionByName(origin)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve (equal to the trapezoid rule over
    ``roc_points``): for each distinct score, its negatives times the
    positives above it plus half the tied positives, over P * N."""
    y = F.col(label)
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
    from .prefix import running_sums
    # area = sum over distinct scores of n_s * (positives above s + p_s / 2) / (P * N)
    cum = running_sums(per, "s", ["p"], descending=True)
    area = cum.agg(F.sum(F.col("n") * (F.col("cum_p") - F.col("p") / 2.0)).alias("a"),
                   F.sum("p").alias("P"), F.sum("n").alias("N"))
    return area.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                              F.col("a") / (F.col("P") * F.col("N"))).otherwise(F.lit(0.0)).alias("roc_auc"))
