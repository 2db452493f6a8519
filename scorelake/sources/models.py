"""Store fitted models with a manifest that keeps their exact names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from scorelake.sources.tables import read_json

_MANIFEST = "position int, model string, folder string"


def save_models(spark: SparkSession, models: Mapping[str, PipelineModel], path: str) -> None:
    rows = []
    for i, (name, model) in enumerate(models.items()):
        folder = f"model_{i}"
        model.write().overwrite().save(f"{path}/{folder}")
        rows.append((i, name, folder))
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_models(spark: SparkSession, path: str) -> dict[str, PipelineModel]:
    """Models by their names; a missing folder or model raises."""
    from pyspark.sql import types as T

    manifest = read_json(spark, f"{path}/manifest", T.StructType.fromDDL(_MANIFEST))
    return {r["model"]: PipelineModel.load(f"{path}/{r['folder']}") for r in manifest.orderBy("position").collect()}
