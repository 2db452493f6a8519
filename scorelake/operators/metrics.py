"""Classification metrics for any number of models from one predictions table.

``predictions`` has columns ``model, row_id, y, pred, score``: true class 0/1, predicted class (null when
the model gave none) and score of class 1 (null when unsupported). Every hard-label metric follows from
four counts per model, so a table of any size shuffles one small row per model and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.operators import curves

HARD_METRICS = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"]
POSITIVE_METRICS = ["precision_positive", "recall_positive", "f1_positive"]


def valid_predictions(predictions: DataFrame) -> DataFrame:
    """Rows with a usable prediction and a known class."""
    return predictions.where("pred is not null and y is not null")


def cells(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Per model: rows attempted, rows with a prediction, and the four confusion counts.

    Models without any usable row keep a row of zeros.
    """
    y, p = F.col("y"), F.col("pred")

    def hits(actual: int, predicted: int) -> Column:
        return F.count(F.when((y == actual) & (p == predicted), 1))

    return predictions.groupBy(*by).agg(
        F.count("*").alias("attempted"),
        F.count(F.when(y.isNotNull() & p.isNotNull(), 1)).alias("valid"),
        hits(0, 0).alias("tn"), hits(0, 1).alias("fp"), hits(1, 0).alias("fn"), hits(1, 1).alias("tp"),
    )


# Per class: precision, recall, F1, support; 0 where undefined. One class' hits are the other's rejections.
_CLASS_COLUMNS = {
    "precision_0": "if(tn + fn > 0, tn / (tn + fn), 0D)",
    "precision_1": "if(tp + fp > 0, tp / (tp + fp), 0D)",
    "recall_0": "if(tn + fp > 0, tn / (tn + fp), 0D)",
    "recall_1": "if(tp + fn > 0, tp / (tp + fn), 0D)",
    "f1_0": "if(tn + fn + fp > 0, 2 * tn / (2 * tn + fn + fp), 0D)",
    "f1_1": "if(tp + fn + fp > 0, 2 * tp / (2 * tp + fn + fp), 0D)",
    "support_0": "tn + fp",
    "support_1": "tp + fn",
}


def _weighted(metric: str) -> str:
    return f"({metric}_0 * support_0 + {metric}_1 * support_1) / valid"


# Only evaluated for models with a valid row. Square roots keep the products of counts within doubles.
_EXPRESSIONS = {
    "accuracy": "(tn + tp) / valid",
    "precision_weighted": _weighted("precision"),
    "recall_weighted": _weighted("recall"),
    "f1_weighted": _weighted("f1"),
    "precision_positive": "precision_1",
    "recall_positive": "recall_1",
    "f1_positive": "f1_1",
    "mcc": "if((tp + fp) > 0 and (tp + fn) > 0 and (tn + fp) > 0 and (tn + fn) > 0, "
           "(double(tp) * tn - double(fp) * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 0D)",
    "specificity": "recall_0",
    "sensitivity": "recall_1",
}


def _with_classes(counted: DataFrame) -> DataFrame:
    return counted.selectExpr("*", *[f"{e} as {c}" for c, e in _CLASS_COLUMNS.items()])


def _guarded(name: str) -> str:
    return f"if(valid > 0, {_EXPRESSIONS[name]}, null) as {name}"


def from_cells(counted: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Named metrics as columns; null for a model without a usable row."""
    return _with_classes(counted).selectExpr(*by, *[_guarded(m) for m in metrics])


def hard_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1."""
    return from_cells(cells(predictions), HARD_METRICS)


def positive_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy and precision, recall, F1 of class 1 alone."""
    return from_cells(cells(predictions), ["accuracy", *POSITIVE_METRICS])


def mcc(predictions: DataFrame) -> DataFrame:
    return from_cells(cells(predictions), ["mcc"])


def sens_spec(predictions: DataFrame) -> DataFrame:
    return from_cells(cells(predictions), ["specificity", "sensitivity"])


def success_rate(predictions: DataFrame) -> DataFrame:
    """Valid predictions / rows attempted, per model: the definition of :func:`model_metrics`."""
    return cells(predictions).selectExpr("model", "valid", "attempted", "valid / attempted as success_rate")


def _matrix_rows(counted: DataFrame) -> DataFrame:
    return counted.selectExpr("model", """stack(4, 0, 0, tn, tn + fp, 0, 1, fp, tn + fp, 1, 0, fn, tp + fn, 1, 1, tp, tp + fn)
        as (actual, predicted, n, n_actual)""")


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Four rows per model (actual, predicted, n), zeros included."""
    return _matrix_rows(cells(predictions)).drop("n_actual")


def confusion_normalized(predictions: DataFrame) -> DataFrame:
    """Confusion matrix divided by the actual class' rows; null when the class does not occur."""
    return _matrix_rows(cells(predictions)).selectExpr(
        "model", "actual", "predicted", "if(n_actual > 0, n / n_actual, null) as share")


def confusion_cells(predictions: DataFrame) -> DataFrame:
    return cells(predictions).select("model", "tn", "fp", "fn", "tp")


def per_class_metrics(predictions: DataFrame) -> DataFrame:
    """(model, class_value, precision, recall, f1, support)."""
    return _with_classes(cells(predictions).where("valid > 0")).selectExpr("model", """stack(2,
        0, precision_0, recall_0, f1_0, support_0,
        1, precision_1, recall_1, f1_1, support_1) as (class_value, precision, recall, f1, support)""")


def classification_report(predictions: DataFrame) -> DataFrame:
    """Per model five rows: class 0, class 1, accuracy (in the f1 column), macro and weighted average."""
    return _with_classes(cells(predictions).where("valid > 0")).selectExpr("model", f"""stack(5,
        '0', precision_0, recall_0, f1_0, support_0,
        '1', precision_1, recall_1, f1_1, support_1,
        'accuracy', double(null), double(null), {_EXPRESSIONS["accuracy"]}, valid,
        'macro avg', (precision_0 + precision_1) / 2, (recall_0 + recall_1) / 2, (f1_0 + f1_1) / 2, valid,
        'weighted avg', {_weighted("precision")}, {_weighted("recall")}, {_weighted("f1")}, valid
        ) as (label, precision, recall, f1, support)""")


RECORD_METRICS = [*HARD_METRICS, *POSITIVE_METRICS, "mcc", "specificity", "sensitivity"]


def model_metrics(predictions: DataFrame, areas: bool = True, thresholds: DataFrame | None = None) -> DataFrame:
    """One record per model: counts, success rate, both metric families, areas under the curves.

    Models without a usable row appear with null metrics. ``areas=False`` leaves the two areas null and
    saves the pass over the scores (models that give labels only); a stored ``thresholds`` table is used as is.
    """
    record = _with_classes(cells(predictions)).selectExpr(
        "model", "attempted", "valid", "valid / attempted as success_rate", "tn", "fp", "fn", "tp",
        *[_guarded(m) for m in RECORD_METRICS])
    if not areas:
        null = F.lit(None).cast("double")
        return record.withColumns({"auc_roc": null, "auc_pr": null})
    found = curves.areas(predictions) if thresholds is None else curves.areas_of(thresholds)
    return record.join(found, "model", "left")
