"""Tables, splits and samples on storage. Parquet by default, CSV where files are exchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import config
from scorelake.functions.missing import col
from scorelake.operators.profile import class_balance


def record_schema(features: Sequence[str] = config.FEATURE_COLUMNS, target: str = config.TARGET_COLUMN,
                  id_col: str = config.ID_COLUMN) -> T.StructType:
    """Id, double features, double target: the declared layout of the input file."""
    return T.StructType([T.StructField(id_col, T.LongType())]
                        + [T.StructField(c, T.DoubleType()) for c in [*features, target]])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """Read CSV (with header) or Parquet, told apart by ``fmt`` or the path.

    A missing path raises ``FileNotFoundError``, a table without rows ``ValueError``. Without a schema
    CSV types are inferred, which reads the file twice.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    try:
        if fmt == "csv":
            df = reader.csv(path, header=True, inferSchema=schema is None, enforceSchema=schema is None)
        else:
            df = reader.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def write_table(df: DataFrame, path: str, fmt: str | None = None, partition_by: Sequence[str] = ()) -> None:
    """Write, replacing what is there; CSV gets a header."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_splits(split: DataFrame, path: str, features: Sequence[str], target: str, fmt: str = "parquet",
                 keep: Sequence[str] = ()) -> None:
    """Features and target of both splits in one job, one directory per split."""
    cols = [col(c) for c in [*keep, *features, target, "split"]]
    write_table(split.select(cols), path, fmt, partition_by=["split"])


def split_metadata(split: DataFrame, features: Sequence[str], target: str, test_size: float, seed: int) -> DataFrame:
    """One nested row: sizes, features, class balance of both splits, test size and seed."""
    balance = class_balance(split, target, by=["split"])
    per_split = balance.groupBy("split").agg(F.struct(
        F.first("total_samples").alias("total_samples"),
        F.map_from_entries(F.collect_list(F.struct(F.col("class_value").cast("string"), "class_count")))
        .alias("class_counts"),
        F.map_from_entries(F.collect_list(F.struct(F.col("class_value").cast("string"), "class_proportion")))
        .alias("class_proportions"),
        F.first("majority_class").alias("majority_class"), F.first("minority_class").alias("minority_class"),
        F.first("imbalance_ratio").alias("imbalance_ratio")).alias("balance"))

    def of(name: str):
        return F.max(F.when(F.col("split") == name, F.col("balance.total_samples")))

    def balance_of(name: str):
        return F.first(F.when(F.col("split") == name, F.col("balance")), ignorenulls=True)

    return per_split.agg(
        of("train").alias("train_samples"), of("test").alias("test_samples"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        balance_of("train").alias("train_balance"), balance_of("test").alias("test_balance"),
        F.lit(float(test_size)).alias("test_size"), F.lit(int(seed)).cast("long").alias("random_state"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read stored results; errors are raised, not hidden."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise


def write_importance(importance: DataFrame, path: str, fmt: str = "csv") -> None:
    """Importance of all models, one directory per model."""
    write_table(importance, path, fmt, partition_by=["model"])


def write_evaluation(root: str, metrics: DataFrame | None = None, rankings: DataFrame | None = None,
                     curves: DataFrame | None = None) -> None:
    """The artefacts of an evaluation below ``root``: metrics, rankings, curves; those given."""
    if metrics is not None:
        write_json(metrics, f"{root}/metrics")
    if rankings is not None:
        write_json(rankings, f"{root}/rankings")
    if curves is not None:
        write_table(curves, f"{root}/curves", "parquet", partition_by=["model", "kind"])
