"""Confidence averages, model evaluation and acceptance rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sulatan.functions.replies import is_finite


def average_confidence(df: DataFrame, keys: list[str], confidence: str = "confidence", digits: int | None = None) -> DataFrame:
    """Mean of the finite confidences per key, 0 if there is none."""
    mean = F.coalesce(F.avg(F.when(is_finite(confidence), F.col(confidence))), F.lit(0.0))
    out = mean if digits is None else F.bround(mean, digits)
    return df.groupBy(*keys).agg(out.alias("average_confidence"), F.count(F.lit(1)).alias("n"))


def label_prediction_join(truth: DataFrame, predictions: DataFrame, on: str = "item_id") -> DataFrame:
    """True label next to the prediction of the same item."""
    return truth.join(predictions, on)


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Counts for every pair of classes seen on either side, zeros included."""
    by = by or []
    counts = df.groupBy(*by, actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    classes = F.array_union(F.collect_set(actual), F.collect_set(predicted))
    per = counts.groupBy(*by).agg(classes.alias("_c"))
    grid = per.select(*by, F.explode("_c").alias(actual), "_c").select(*by, actual, F.explode("_c").alias(predicted))
    return grid.join(counts, [*by, actual, predicted], "left").fillna(0, ["n"])


def class_scores(matrix: DataFrame, actual: str = "actual", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    by = by or []
    sides = F.array(F.struct(F.col(actual).alias("c"), F.lit(1).alias("a"), F.lit(0).alias("p")),
                    F.struct(F.col(predicted).alias("c"), F.lit(0).alias("a"), F.lit(1).alias("p")))
    hit = F.col(actual) == F.col(predicted)
    rows = matrix.select(*by, F.when(hit, F.col("n")).otherwise(0).alias("_tp"), "n", F.explode(sides).alias("s"))
    sums = rows.groupBy(*by, F.col("s.c").alias("class")).agg(
        F.sum(F.col("_tp") * F.col("s.a")).alias("_tp"), F.sum(F.col("n") * F.col("s.a")).alias("support"),
        F.sum(F.col("n") * F.col("s.p")).alias("_pred"))
    precision = F.coalesce(F.try_divide("_tp", "_pred"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("_tp", "support"), F.lit(0.0))
    out = sums.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1).select(*by, "class", "precision", "recall", "f1", "support", "_tp")


def classification_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Accuracy and macro precision, recall and F1, overall or per group."""
    by = by or []
    scores = class_scores(confusion_matrix(df, actual, predicted, by), actual, predicted, by)
    out = scores.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum("_tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("total"), F.count(F.lit(1)).alias("num_classes"))
    return out


def acceptance_rate(submissions: DataFrame, accepted: str = "accepted", target: float = 0.6) -> DataFrame:
    """Total, archived, rejected, rate, and whether the target is met."""
    out = submissions.agg(F.count(F.lit(1)).alias("total_submissions"),
                          F.coalesce(F.sum(F.col(accepted).cast("long")), F.lit(0)).alias("archived"))
    rate = F.coalesce(F.try_divide("archived", "total_submissions"), F.lit(0.0))
    return out.withColumns({"rejected": F.col("total_submissions") - F.col("archived"), "acceptance_rate": rate,
                            "target_rate": F.lit(float(target)), "target_met": rate >= target})
