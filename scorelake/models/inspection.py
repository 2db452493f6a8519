"""Feature importance and coefficients of fitted models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "model string, feature string, importance double, coefficient double, abs_coefficient double"


def feature_importance(spark: SparkSession, models: Mapping[str, PipelineModel], features: Sequence[str]) -> DataFrame:
    """(model, feature, importance, coefficient, abs_coefficient), strongest first per model.

    Tree models have importances, linear models on the original features coefficients; a model with
    neither (kernel machine, vote) contributes no rows. The table has one row per model and feature.
    """
    rows = []
    for name, model in models.items():
        last = model.stages[-1]
        if hasattr(last, "featureImportances"):
            rows += [(name, f, float(v), None, None) for f, v in zip(features, last.featureImportances.toArray())]
        elif hasattr(last, "coefficients") and last.numFeatures == len(features):
            rows += [(name, f, None, float(v), abs(float(v))) for f, v in zip(features, last.coefficients.toArray())]
    return spark.createDataFrame(rows, SCHEMA).orderBy(
        "model", F.coalesce("importance", "abs_coefficient").desc(), "feature")


def model_type(model: PipelineModel) -> str:
    """Class of the fitted machine: the last stage but for calibration steps."""
    machines = [s for s in model.stages if hasattr(s, "featureImportances") or hasattr(s, "coefficients")]
    return type((machines or model.stages)[0]).__name__


def with_model_type(record: DataFrame, models: Mapping[str, PipelineModel], others: str = "SoftVote") -> DataFrame:
    """Add ``model_type`` to a metrics record; models that aren't in ``models`` (the vote) get ``others``."""
    kind = F.lit(others)
    for name, model in models.items():
        kind = F.when(F.col("model") == name, model_type(model)).otherwise(kind)
    return record.withColumn("model_type", kind)
