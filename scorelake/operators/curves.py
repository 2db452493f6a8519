"""Threshold curves and the areas under them, exact for any number of distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators.cumulate import ROWS_PER_BUCKET, ordered_totals


def threshold_table(predictions: DataFrame, score_digits: int | None = None,
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per (model, distinct score), by falling score: positives and negatives at and above it, and in all.

    ``score_digits`` rounds scores first, which bounds the number of points at the price of exactness.
    """
    score = F.col("score").cast("double")
    if score_digits is not None:
        score = F.round(score, score_digits)
    rows = (predictions.select("model", F.col("y").cast("int").alias("y"), score.alias("score"))
            .where("y is not null and score is not null and not isnan(score)"))
    return ordered_totals(
        rows, ["model"], "score",
        {"pos": F.count(F.when(F.col("y") == 1, 1)), "neg": F.count(F.when(F.col("y") == 0, 1))},
        descending=True, row_count=predictions.count(), rows_per_bucket=rows_per_bucket)


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _share(top: Column, total: str) -> Column:
    return F.when(F.col(total) > 0, top / _d(total))


def _points(table: DataFrame, before: bool) -> tuple[Column, Column]:
    """True and false positives at a threshold, or at the next higher one."""
    tp, fp = _d("pos_upto"), _d("neg_upto")
    return (tp - _d("pos"), fp - _d("neg")) if before else (tp, fp)


def areas_of(table: DataFrame) -> DataFrame:
    """(model, auc_roc, auc_pr) from a :func:`threshold_table`.

    Area under ROC counts ties half; it is null unless both classes occur. The precision-recall area adds
    trapezoids from (recall 0, precision 1) downwards; each point knows its predecessor's counts, so no
    second ordering is needed.
    """
    tp, fp = _points(table, False)
    tp0, fp0 = _points(table, True)
    precision = tp / (tp + fp)
    precision0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    both = (F.max("pos_total") > 0) & (F.max("neg_total") > 0)
    roc = F.sum(_d("neg") * (tp0 + tp) / 2) / (F.max(_d("pos_total")) * F.max(_d("neg_total")))
    pr = F.sum(_d("pos") * (precision + precision0) / 2) / F.max(_d("pos_total"))
    return table.groupBy("model").agg(F.when(both, roc).alias("auc_roc"), F.when(both, pr).alias("auc_pr"))


def areas(predictions: DataFrame, **options) -> DataFrame:
    return areas_of(threshold_table(predictions, **options))


def roc_auc(predictions: DataFrame, **options) -> DataFrame:
    return areas(predictions, **options).select("model", "auc_roc")


def auc_pr(predictions: DataFrame, **options) -> DataFrame:
    return areas(predictions, **options).select("model", "auc_pr")


def _point(kind: str, threshold: Column, x: Column, y: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), threshold.cast("double").alias("threshold"),
                    x.cast("double").alias("x"), y.cast("double").alias("y"))


def curve_points(table: DataFrame, kinds: Sequence[str] = ("roc", "pr")) -> DataFrame:
    """(model, kind, threshold, x, y) of the wanted curves from a :func:`threshold_table`, in one pass.

    ``roc``: x = false positive rate, y = true positive rate; ``pr``: x = recall, y = precision. The row of
    the highest score also yields the end point without a threshold: (0, 0), and recall 0, precision 1.
    """
    tpr, fpr = _share(_d("pos_upto"), "pos_total"), _share(_d("neg_upto"), "neg_total")
    precision = _d("pos_upto") / (_d("pos_upto") + _d("neg_upto"))
    score, none = F.col("score"), F.lit(None)
    points = {"roc": _point("roc", score, fpr, tpr), "pr": _point("pr", score, tpr, precision)}
    ends = {"roc": _point("roc", none, F.lit(0.0), F.lit(0.0)), "pr": _point("pr", none, F.lit(0.0), F.lit(1.0))}
    here, first = [points[k] for k in kinds], [ends[k] for k in kinds]
    highest = (F.col("pos_upto") == F.col("pos")) & (F.col("neg_upto") == F.col("neg"))
    rows = F.when(highest, F.array(*here, *first)).otherwise(F.array(*here))
    return table.select("model", F.explode(rows).alias("p")).select("model", "p.*")


def roc_curve(predictions: DataFrame, **options) -> DataFrame:
    return curve_points(threshold_table(predictions, **options), ["roc"])


def pr_curve(predictions: DataFrame, **options) -> DataFrame:
    return curve_points(threshold_table(predictions, **options), ["pr"])
