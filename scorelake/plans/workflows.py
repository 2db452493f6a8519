"""End-to-end runs. Every step writes a table that the next one reads, so a run can be taken up again."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake import config
from scorelake.models import inspection, training, tuning
from scorelake.operators import compare, curves, metrics, profile, sampling, scoring, significance
from scorelake.sources import models as model_store
from scorelake.sources import tables


def prepare(spark: SparkSession, source: DataFrame, out: str, features: Sequence[str] = config.FEATURE_COLUMNS,
            target: str = config.TARGET_COLUMN, id_col: str = config.ID_COLUMN, test_size: float = config.TEST_SIZE,
            sample_size: int = config.SAMPLE_SIZE, n_folds: int = 5, seed: int = config.RANDOM_STATE) -> DataFrame:
    """Validate, clean, describe, split and sample; returns the validation report.

    Below ``out``: ``validation``, ``clean``, ``feature_summary``, ``splits`` (by split, with id and fold),
    ``split_metadata`` and ``sample``. Stops after the report when validation fails.
    """
    report_path = f"{out}/validation"
    tables.write_json(profile.validation_report(source, features, target, id_col), report_path)
    report = tables.read_json(spark, report_path)
    if not profile.is_valid(report):
        return report

    # Written once: every later step reads it several times, and cleaning shuffles whole rows.
    tables.write_table(profile.clean_rows(source, target), f"{out}/clean")
    clean = tables.read_table(spark, f"{out}/clean")
    present = profile.present_features(clean, features)
    tables.write_json(profile.feature_summary(clean, present), f"{out}/feature_summary")

    # Split, folds and sample have seeds of their own: with one row order, training rows would miss whole folds.
    # Folds divide the training rows, test rows have none.
    split = sampling.stratified_split(clean, id_col, target, test_size, seed)
    folded = sampling.stratified_folds(split.where("split = 'train'"), id_col, target, n_folds, seed + 1)
    parts = folded.unionByName(split.where("split = 'test'").withColumn("fold", F.lit(None).cast(folded.schema["fold"].dataType)))
    tables.write_splits(parts, f"{out}/splits", present, target, keep=[id_col, "fold"])
    stored = spark.read.parquet(f"{out}/splits")
    tables.write_json(tables.split_metadata(stored, present, target, test_size, seed), f"{out}/split_metadata")
    tables.write_table(sampling.stratified_sample(clean, id_col, target, sample_size, seed + 2), f"{out}/sample")
    return report


def evaluate(spark: SparkSession, predictions: DataFrame, out: str, names: Sequence[str] = compare.RANKED_METRICS) -> DataFrame:
    """Write metrics, rankings and curves of stored predictions; returns the metrics.

    The threshold table, the only step that shuffles scores, is stored and serves areas and curves.
    """
    tables.write_table(curves.threshold_table(predictions), f"{out}/thresholds")
    thresholds = spark.read.parquet(f"{out}/thresholds")
    record = metrics.model_metrics(predictions, thresholds=thresholds)
    tables.write_json(record, f"{out}/metrics")
    record = tables.read_json(spark, f"{out}/metrics", record.schema)
    tables.write_evaluation(out, None, compare.metric_rankings(record, names), curves.curve_points(thresholds))
    return record


def train_and_evaluate(spark: SparkSession, splits: DataFrame, out: str, features: Sequence[str], target: str, id_col: str,
                       names: Sequence[str] = tuple(training.MODEL_NAMES), n_folds: int = 5, tune: bool = False,
                       grids: dict[str, dict] | None = None,
                       overrides: dict[str, dict] | None = None, partitions: int | None = None,
                       parallelism: int = 2, fit_rows: int | None = None) -> dict:
    """Cross-validate, optionally tune, train, vote, predict the test rows, evaluate, compare and store.

    ``splits`` has columns split (train/test) and fold. Below ``out``: ``fold_scores``, ``history``,
    ``tuning``, ``status``, ``importance``, ``models``, ``predictions`` and the artefacts of :func:`evaluate`; a second
    run replaces them. ``status`` has the outcome of every model's cross-validation and fit. ``fit_rows`` bounds the
    labelled rows of each fit (see :func:`scorelake.models.training.fit_sample`); all test rows are scored.
    """
    table = training.assemble(splits, id_col, target, features, keep=["split", "fold"], partitions=partitions).persist()
    try:
        train, test = table.where("split = 'train'"), table.where("split = 'test'")
        folds = {r["fold"] for r in train.select("fold").distinct().collect()}
        if folds != set(range(n_folds)):
            raise ValueError(f"training rows have the folds {sorted(folds, key=str)}, asked are 0 to {n_folds - 1}")
        overrides, history = dict(overrides or {}), []
        if tune:
            found = tuning.random_search(training.fit_sample(train, fit_rows), names, n_folds=n_folds, grids=grids, parallelism=parallelism)
            results = {n: r for n, r in found.items() if isinstance(r, tuning.SearchResult)}
            overrides |= {n: r.best_params for n, r in results.items()}
            failed = {n: r for n, r in found.items() if n not in results}
            if failed:
                raise RuntimeError(f"tuning failed: {failed}")
            searched = {n: r.table(spark) for n, r in results.items()}
            tables.write_json(reduce(DataFrame.unionByName, searched.values()), f"{out}/tuning")
            history += [training.history_rows(scores.where("position = 1"), "hyperparameter_tuning", str(results[n].best_params), "mean_score")
                        for n, scores in searched.items()]
        estimators = training.registry(names, overrides)

        failures: list[tuple[str, str, str]] = []
        scores = training.fold_scores(training.cross_validate(train, estimators, n_folds, parallelism, fit_rows, failures))
        tables.write_json(scores, f"{out}/fold_scores")
        scores = tables.read_json(spark, f"{out}/fold_scores", scores.schema)
        history.append(training.history_rows(compare.cv_summary(scores), "cross_validation", f"{n_folds} folds", "mean_score"))
        tables.write_table(reduce(DataFrame.unionByName, history), f"{out}/history")

        models, status = training.train_all(train, estimators, parallelism, fit_rows)
        status += [(n, "cross-validation failed", error) for n, _, error in failures]
        tables.write_json(training.status_table(spark, status), f"{out}/status")
        model_store.save_models(spark, models, f"{out}/models")
        tables.write_importance(inspection.feature_importance(spark, models, features), f"{out}/importance")

        predicted = training.predict(models, test, ensemble=len(models) > 1)
        tables.write_table(predicted, f"{out}/predictions", "parquet", partition_by=["model"])
    finally:
        table.unpersist()
    predictions = spark.read.parquet(f"{out}/predictions").select("model", "row_id", "y", "pred", "score")
    record = inspection.with_model_type(evaluate(spark, predictions, out), models)
    tables.write_json(record.select("model", "model_type"), f"{out}/model_types")
    return {"metrics": record, "models": models, "fold_test": significance.t_test(scores),
            "row_test": significance.mcnemar_test(predictions) if len(models) > 1 else None}


def score_by_prompt(spark: SparkSession, test: DataFrame, out: str, features: Sequence[str], target: str, id_col: str,
                    models: Sequence[str], scorer: scoring.Scorer, sample_size: int | None = None,
                    partitions: int | None = None, target_name: str = "Health Status", seed: int = config.RANDOM_STATE,
                    slices: int = 1, **options) -> DataFrame:
    """Score one shared sample with every model and evaluate; returns the metrics.

    Answers are stored below ``out/responses`` by model and in ``slices`` pieces of the rows, so a run that stops loses
    one piece; rows already there are not asked again. A model without any answer is an error. Only the answers of
    these models for this sample are evaluated.
    """
    sample = scoring.evaluation_sample(test, id_col, sample_size, seed)
    if partitions:      # rows move, not the prompts made from them
        sample = sample.repartition(partitions, id_col)
    for model, piece in [(m, i) for m in models for i in range(slices)]:
        of_piece = sample.where(F.pmod(F.xxhash64(id_col), F.lit(slices)) == piece)
        pending = scoring.prompts(of_piece, id_col, target, features, [model], target_name)
        try:
            pending = scoring.unscored(pending, spark.read.parquet(f"{out}/responses"))
        except Exception as e:
            if getattr(e, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
                raise
        scoring.score(pending, scorer, **options).write.mode("append").parquet(f"{out}/responses")
    asked = sample.select(F.col(id_col).cast("long").alias("row_id"))
    responses = spark.read.parquet(f"{out}/responses").where(F.col("model").isin(list(models))).join(asked, "row_id", "left_semi")
    silent = responses.groupBy("model").agg(F.count("raw").alias("answers"), F.max("error").alias("error")).where("answers = 0").collect()
    if silent:
        raise RuntimeError("no answer at all: " + "; ".join(f"{r['model']}: {r['error']}" for r in silent))
    record = scoring.scored_metrics(responses)
    tables.write_json(record, f"{out}/metrics")
    record = tables.read_json(spark, f"{out}/metrics", record.schema)
    tables.write_json(compare.overall_rank(record), f"{out}/ranking")
    tables.write_json(compare.best_per_metric(record), f"{out}/best")
    return record
