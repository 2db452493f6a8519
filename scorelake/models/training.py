"""Build, train, cross-validate and apply the models of the registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake import config
from scorelake.functions.missing import col
from scorelake.models.boosting import BoostedTrees
from scorelake.models.forest import BaggedForest
from scorelake.models.stages import BalancedLogisticRegression, KernelSVM
from scorelake.operators.metrics import cells, from_cells
from scorelake.operators.sampling import stratified_sample
from scorelake.session import scratch_root

MODEL_NAMES = list(config.MODEL_PARAMS)
MOST_ROWS = 250_000


def build(name: str, seed: int = config.RANDOM_STATE, **params) -> Pipeline:
    """Untrained pipeline for (row_id, y, features) rows; ``params`` override the defaults."""
    given = {**config.MODEL_PARAMS[name], **params}
    if name == "RandomForest":
        stages = [BaggedForest(seed=seed, **given)]
    elif name == "LogisticRegression":
        stages = [BalancedLogisticRegression(**given)]
    elif name == "SVM":
        stages = [KernelSVM(seed=seed, **given)]
    elif name == "GradientBoosting":
        stages = [BoostedTrees(seed=seed, **given)]
    else:
        raise ValueError(f"unknown model {name}")
    return Pipeline(stages=stages)


def registry(names: Sequence[str] = MODEL_NAMES, overrides: Mapping[str, dict] | None = None) -> dict[str, Pipeline]:
    return {n: build(n, **(overrides or {}).get(n, {})) for n in names}


def assemble(df: DataFrame, id_col: str, target: str, features: Sequence[str], missing: str = "error",
             keep: Sequence[str] = (), partitions: int | None = None, rows_per_partition: int | None = None) -> DataFrame:
    """(row_id, y, features, ...): the only layout the models see. ``missing``: error or skip.

    Persist the result before fitting; every fit reads it many times. ``partitions`` spreads a table
    that arrives in fewer pieces than there are cores; ``rows_per_partition`` sets their number by size instead: once every
    core has one, partitions grow up to ``MOST_ROWS``, as fits run hundreds of short jobs whose time is that of starting tasks.
    """
    if rows_per_partition:
        n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
        partitions = min(-(-n // rows_per_partition), max(cores, -(-n // MOST_ROWS))) or 1
    inputs = df.select(col(id_col).alias("row_id"), col(target).cast("double").alias("y"),
                       *[col(f) for f in features], *[col(k) for k in keep])
    if partitions:
        # Sorted, so that a lost partition comes back in the same order: forests draw rows by position.
        inputs = inputs.repartition(partitions, "row_id").sortWithinPartitions("row_id")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid=missing)
    return assembler.transform(inputs).select("row_id", "y", "features", *[col(k) for k in keep])


def fit_sample(table: DataFrame, fit_rows: int | None) -> DataFrame:
    """At most ``fit_rows`` labelled rows to fit on, class shares kept (all rows when None).

    Forests and kernel machines hold trees or feature maps that grow with the rows they are fitted on; this bounds
    them. Scoring is never bounded.
    """
    return table if fit_rows is None else stratified_sample(table, "row_id", "y", fit_rows)


def run_fits(spark: SparkSession, jobs: Sequence, work, parallelism: int) -> list:
    """Run independent fits from a few driver threads; Spark schedules their tasks side by side."""
    if parallelism <= 1:
        return [work(j) for j in jobs]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), jobs, 1)


def train_all(table: DataFrame, estimators: Mapping[str, Pipeline], parallelism: int = 2, fit_rows: int | None = None,
              ) -> tuple[dict[str, PipelineModel], list[tuple[str, str, str | None]]]:
    """Fit every estimator; returns the models and (model, status, error) rows.

    A failing model is recorded and the others go on. ``fit_rows``: see :func:`fit_sample`.
    """
    scratch_root(table.sparkSession)   # boosting and deep forests cut their lineage there
    table = fit_sample(table, fit_rows)

    def fit(item):
        name, estimator = item
        try:
            return name, estimator.fit(table), None
        except Exception as e:
            return name, None, f"{type(e).__name__}: {e}"

    results = run_fits(table.sparkSession, list(estimators.items()), fit, parallelism)
    return ({n: m for n, m, _ in results if m is not None},
            [(n, "trained" if m is not None else "failed", e) for n, m, e in results])


def status_table(spark: SparkSession, status: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    return spark.createDataFrame(list(status), "model string, status string, error string")


def with_scores(df: DataFrame, models: Mapping[str, PipelineModel]) -> DataFrame:
    """Add ``pred_<i>`` and ``score_<i>`` for the i-th model: one narrow chain over the same rows, no join."""
    keep = list(df.columns)
    for i, model in enumerate(models.values()):
        out = model.transform(df)
        score = vector_to_array(F.col("probability"))[1] if "probability" in out.columns else F.lit(None)
        df = out.select(*[col(k) for k in keep], F.col("prediction").cast("int").alias(f"pred_{i}"),
                        score.cast("double").alias(f"score_{i}"))
        keep = list(df.columns)
    return df


def soft_vote(df: DataFrame, score_columns: Sequence[str]) -> DataFrame:
    """Add ``score`` (mean probability) and ``pred`` (class of the larger mean, ties to class 0)."""
    if len(score_columns) < 2:
        raise ValueError("an ensemble needs at least two models")
    mean = sum((col(c) for c in score_columns[1:]), col(score_columns[0])) / len(score_columns)
    return df.withColumn("score", mean).withColumn("pred", (F.col("score") > 0.5).cast("int"))


def predict(models: Mapping[str, PipelineModel], table: DataFrame, ensemble: bool = False,
            keep: Sequence[str] = ()) -> DataFrame:
    """Predictions table (model, row_id, y, pred, score) of all models, optionally with their soft vote.

    Members of the vote are not fitted again: the same rows and seeds give the same models.
    """
    wide = with_scores(table.select("row_id", "y", "features", *keep), models)
    names = list(models)
    rows = [F.struct(F.lit(n).alias("model"), F.col(f"pred_{i}").alias("pred"), F.col(f"score_{i}").alias("score"))
            for i, n in enumerate(names)]
    if ensemble:
        wide = soft_vote(wide, [f"score_{i}" for i in range(len(names))])
        rows.append(F.struct(F.lit("Ensemble").alias("model"), F.col("pred"), F.col("score")))
    return (wide.select("row_id", F.col("y").cast("int").alias("y"), *keep, F.explode(F.array(*rows)).alias("m"))
            .select("m.model", "row_id", "y", "m.pred", "m.score", *keep))


def by_parts(estimator: Pipeline):
    """The only stage of an estimator, if it fits several parts of a table side by side."""
    stages = estimator.getStages()
    return stages[0] if len(stages) == 1 and hasattr(stages[0], "fit_parts") else None


def cross_validate(table: DataFrame, estimators: Mapping[str, Pipeline], n_folds: int, parallelism: int = 2,
                   fit_rows: int | None = None, failures: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Out-of-fold predictions (model, row_id, y, pred, score, fold); ``table`` carries ``fold``.

    Everything learned, class weights included, is learned on the other folds. A model that fails on a fold is left
    out and noted in ``failures`` as (model, "failed", error); without that list, or when no model is left, it raises.
    Fits of many short jobs (boosting, kernel machines) take the folds side by side, in the jobs of one fit.
    """
    scratch_root(table.sparkSession)
    together = [] if fit_rows is not None else [n for n, e in estimators.items() if by_parts(e) is not None]

    def fit(job):
        f, name = job
        if f is None:
            try:
                models = by_parts(estimators[name]).fit_parts(table, [F.col("fold") != f for f in range(n_folds)])
                return [(f, name, PipelineModel([m]), None) for f, m in enumerate(models)]
            except Exception:                            # fold by fold, to know which one fails
                return [found for f in range(n_folds) for found in fit((f, name))]
        try:
            return [(f, name, estimators[name].fit(fit_sample(table.where(F.col("fold") != f), fit_rows)), None)]
        except Exception as e:
            return [(f, name, None, f"fold {f}: {type(e).__name__}: {e}")]

    jobs = [(None, n) for n in together] + [(f, n) for f in range(n_folds) for n in estimators if n not in together]
    fitted = [found for part in run_fits(table.sparkSession, jobs, fit, parallelism) for found in part]
    failed: dict[str, str] = {}
    for _, name, _, error in fitted:
        if error is not None:
            failed.setdefault(name, error)
    if failed and (failures is None or len(failed) == len(estimators)):
        raise RuntimeError(f"cross-validation failed: {failed}")
    if failures is not None:
        failures += [(name, "failed", error) for name, error in failed.items()]
    out = None
    for f in range(n_folds):
        models = {name: m for g, name, m, _ in fitted if g == f and name not in failed}
        part = predict(models, table.where(F.col("fold") == f), keep=["fold"])
        out = part if out is None else out.unionByName(part)
    return out


def fold_scores(out_of_fold: DataFrame) -> DataFrame:
    """(model, fold, value): accuracy per model and fold."""
    by = ["model", "fold"]
    return from_cells(cells(out_of_fold, by), ["accuracy"], by).withColumnRenamed("accuracy", "value")


# --- history ---------------------------------------------------------------------------------

HISTORY = "model string, method string, detail string, best_score double, trained_at timestamp"


def history_rows(summary: DataFrame, method: str, detail: str, score: str | None = None) -> DataFrame:
    """One history row per model of ``summary``, stamped now."""
    best = F.col(score).cast("double") if score else F.lit(None).cast("double")
    return summary.select("model", F.lit(method).alias("method"), F.lit(detail).alias("detail"),
                          best.alias("best_score"), F.current_timestamp().alias("trained_at"))


def training_summary(history: DataFrame) -> DataFrame:
    """History rows numbered per model in order of time."""
    order = Window.partitionBy("model").orderBy("trained_at", "method")
    return history.select("model", F.row_number().over(order).alias("training"), "method", "detail",
                          "best_score", "trained_at")


def append_history(rows: DataFrame, path: str) -> None:
    """Add rows to a history that collects several runs."""
    rows.write.mode("append").parquet(path)
