"""Paired tests between the best and the second-best model."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake import config


def best_two(scores: DataFrame) -> DataFrame:
    """One row (best_model, second_model, best_score, second_score) from (model, value) rows.

    Models are ordered by mean value, equal ones by name.
    """
    order = Window.orderBy(F.col("value").desc(), "model")
    ranked = (scores.where("value is not null").groupBy("model").agg(F.avg("value").alias("value"))
              .withColumn("position", F.row_number().over(order)))

    def at(position: int, name: str):
        return F.max(F.when(F.col("position") == position, F.col(name)))

    return ranked.where("position <= 2").agg(
        at(1, "model").alias("best_model"), at(2, "model").alias("second_model"),
        at(1, "value").alias("best_score"), at(2, "value").alias("second_score"))


def paired_t_stat(fold_scores: DataFrame) -> DataFrame:
    """Paired t statistic over folds, best against second-best model.

    Input (model, fold, value), one row per model and fold: a few rows. ``t_statistic`` is null with fewer
    than two pairs or when all differences are equal.
    """
    mean = F.avg("value").over(Window.partitionBy("model"))
    order = Window.orderBy(F.col("mean").desc(), "model")
    ranked = (fold_scores.where("value is not null").withColumn("mean", mean)
              .withColumn("position", F.dense_rank().over(order)).where("position <= 2"))

    def at(position: int, name: str):
        return F.max(F.when(F.col("position") == position, F.col(name)))

    by_fold = ranked.groupBy("fold").agg(
        *[at(i, "model").alias(f"model_{i}") for i in (1, 2)],
        *[at(i, "mean").alias(f"mean_{i}") for i in (1, 2)],
        (at(1, "value") - at(2, "value")).alias("d"))
    spread = F.stddev_samp("d")
    return by_fold.agg(
        F.max("model_1").alias("best_model"), F.max("model_2").alias("second_model"),
        F.max("mean_1").alias("best_score"), F.max("mean_2").alias("second_score"),
        F.count("d").alias("pairs"), F.avg("d").alias("mean_difference"),
        F.when((F.count("d") > 1) & (spread > 1e-12), F.avg("d") / (spread / F.sqrt(F.count("d"))))
        .alias("t_statistic"))


def mcnemar_cells(predictions: DataFrame) -> DataFrame:
    """Per row agreement of the two most accurate models: both right, only one right (b, c), both wrong.

    The two names come from four counts per model; only those two models' rows are then read and grouped by
    row id, one shuffle instead of a join of two filtered copies.
    """
    from scorelake.operators.metrics import cells, from_cells

    accuracy = from_cells(cells(predictions), ["accuracy"]).select("model", F.col("accuracy").alias("value"))
    pair = best_two(accuracy).first()
    best, second = pair["best_model"], pair["second_model"]
    right = F.col("pred") == F.col("y")

    def answer(model: str):
        return F.max(F.when(F.col("model") == model, right.cast("int")))

    by_row = (predictions.where(F.col("model").isin([m for m in (best, second) if m is not None]))
              .where("pred is not null and y is not null")
              .groupBy("row_id").agg(answer(best).alias("a"), answer(second).alias("b"))
              .where("a is not null and b is not null"))

    def n(a: int, b: int):
        return F.count(F.when((F.col("a") == a) & (F.col("b") == b), 1))

    return by_row.agg(n(1, 1).alias("both_right"), n(1, 0).alias("only_best_right"),
                      n(0, 1).alias("only_second_right"), n(0, 0).alias("both_wrong")).select(
        F.lit(best).cast("string").alias("best_model"), F.lit(second).cast("string").alias("second_model"), "*")


def _t_tail(t: float, df: int) -> float:
    """Two-sided tail of Student's t by Simpson's rule on the angle substitution t = sqrt(df) * tan(a)."""
    start, steps = math.atan(abs(t) / math.sqrt(df)), 2000
    h = (math.pi / 2 - start) / steps
    heights = [math.cos(start + i * h) ** (df - 1) for i in range(steps + 1)]
    area = h / 3 * (heights[0] + heights[-1] + 4 * sum(heights[1:-1:2]) + 2 * sum(heights[2:-1:2]))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return min(1.0, 2 * scale * area)


def t_test(fold_scores: DataFrame, level: float = config.SIGNIFICANCE_LEVEL) -> dict:
    """Best against second-best model over folds, with p-value; not significant when undefined."""
    out = paired_t_stat(fold_scores).first().asDict()
    t = out["t_statistic"]
    p = None if t is None else _t_tail(t, out["pairs"] - 1)
    return {**out, "p_value": p, "significant": p is not None and p < level}


def mcnemar_test(predictions: DataFrame, level: float = config.SIGNIFICANCE_LEVEL) -> dict:
    """McNemar's test with continuity correction; null without any disagreement."""
    out = mcnemar_cells(predictions).first().asDict()
    b, c = out["only_best_right"], out["only_second_right"]
    stat = (max(0, abs(b - c) - 1)) ** 2 / (b + c) if b + c else None
    p = None if stat is None else math.erfc(math.sqrt(stat / 2))
    return {**out, "statistic": stat, "p_value": p, "significant": p is not None and p < level}
