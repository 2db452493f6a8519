"""Rank and compare models. Inputs are metric tables with one row per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.text import auc_text, percent_text

RANKED_METRICS = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "mcc"]
RANKED_POSITIVE = ["accuracy", "precision_positive", "recall_positive", "f1_positive", "mcc"]
TRAINED_COLUMNS = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "auc_roc", "auc_pr", "mcc"]
SCORED_COLUMNS = ["accuracy", "precision_positive", "recall_positive", "f1_positive", "mcc", "success_rate", "valid"]


def metrics_long(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """(model, metric, value)."""
    return metrics.select("model", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(
        ["model"], list(names), "metric", "value")


def comparison_table(trained: DataFrame | None, scored: DataFrame | None = None) -> DataFrame:
    """One row per model of both families; columns a family lacks are null.

    Both averages of precision, recall and F1 keep their own columns: they must not be compared.
    """
    parts = []
    if trained is not None:
        parts.append(trained.select(F.lit("trained").alias("family"), "model", *TRAINED_COLUMNS))
    if scored is not None:
        parts.append(scored.select(F.lit("scored").alias("family"), "model", *SCORED_COLUMNS))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def metric_rankings(metrics: DataFrame, names: Sequence[str] = RANKED_METRICS) -> DataFrame:
    """(metric, position, model, value): models by falling value per metric, equal values by name."""
    order = Window.partitionBy("metric").orderBy(F.col("value").desc_nulls_last(), "model")
    return metrics_long(metrics, names).select(
        "metric", F.row_number().over(order).alias("position"), "model", "value")


def best_per_metric(metrics: DataFrame, names: Sequence[str] = RANKED_POSITIVE) -> DataFrame:
    """(metric, model, value) of the best model; first by name among equals."""
    best = F.min(F.struct(-F.col("value"), F.col("model"), F.col("value")))
    return (metrics_long(metrics, names).where("value is not null")
            .groupBy("metric").agg(best.alias("b")).select("metric", "b.model", "b.value"))


def best_model(metrics: DataFrame, by: str = "accuracy") -> DataFrame:
    """(metric, model, value) of the overall best model."""
    return best_per_metric(metrics, [by])


def overall_rank(metrics: DataFrame, by: str = "f1_positive") -> DataFrame:
    """(model, value, position): unique positions 1..n by falling value."""
    ranked = metric_rankings(metrics.where(F.col(by).isNotNull()), [by])
    return ranked.select("model", F.col("value").alias(by), "position")


def accuracy_summary(metrics: DataFrame, name: str = "accuracy") -> DataFrame:
    """Mean, sample standard deviation, best, worst and range over models."""
    v = F.col(name)
    return metrics.agg(
        F.avg(v).alias("mean_accuracy"), F.stddev_samp(v).alias("std_accuracy"),
        F.max(v).alias("best_accuracy"), F.min(v).alias("worst_accuracy"),
        (F.max(v) - F.min(v)).alias("accuracy_range"))


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """Per model: folds, mean and population standard deviation of (model, fold, value) rows, and the fold scores in
    order of the folds as a list (as long as there are folds)."""
    return fold_scores.groupBy("model").agg(
        F.count("value").alias("folds"), F.avg("value").alias("mean_score"),
        F.stddev_pop("value").alias("std_score"),
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda s: s["value"]).alias("fold_scores"))


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` features per model by importance, or by absolute coefficient where there is none."""
    weight = F.coalesce("importance", "abs_coefficient") if "abs_coefficient" in importance.columns \
        else F.col("importance")
    order = Window.partitionBy("model").orderBy(weight.desc_nulls_last(), "feature")
    return (importance.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n))


def summary_table(metrics: DataFrame) -> DataFrame:
    """(model, accuracy, auc) as text: percent with three decimals, three decimals or N/A."""
    return metrics.select("model", percent_text(F.coalesce("accuracy", F.lit(0.0))).alias("accuracy"),
                          auc_text(F.col("auc_roc")).alias("auc"))


def metric_sanity(metrics: DataFrame, low: float = 0.5) -> DataFrame:
    """Per model: accuracy, and area under ROC when present, lie in [low, 1]."""
    def sane(c: Column) -> Column:
        return c.between(low, 1.0)

    accuracy_ok = F.coalesce(sane(F.col("accuracy")), F.lit(False))
    auc_ok = F.coalesce(sane(F.col("auc_roc")), F.lit(True))
    return metrics.select("model", accuracy_ok.alias("accuracy_ok"), auc_ok.alias("auc_ok"),
                          (accuracy_ok & auc_ok).alias("sane"))
