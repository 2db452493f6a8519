import json
import os

import pytest
from pyspark.sql import functions as F

from scorelake import config
from scorelake.operators import sampling
from scorelake.plans import prepare, score_by_prompt, train_and_evaluate
from scorelake.queries import inputs
from scorelake.session import scratch_path, scratch_root
from scorelake.sources import tables


def test_missing_and_empty_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.csv"))
    tables.write_table(spark.range(3).where("id < 0"), str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "empty"))
    with pytest.raises(FileNotFoundError):
        tables.read_json(spark, str(tmp_path / "none"))


def test_declared_schema():
    schema = tables.record_schema()
    assert len(schema) == 21 and schema[0].name == config.ID_COLUMN and "W/B" in schema.names


def test_csv_keeps_values_and_replaces(spark, tmp_path):
    path = str(tmp_path / "deep" / "er" / "t.csv")
    df = spark.createDataFrame([(1, 0.1 + 0.2, None), (2, float("nan"), 1.0)], "SEQN long, `W/B` double, y double")
    tables.write_table(spark.range(5), path)
    tables.write_table(df, path)
    back = tables.read_table(spark, path, df.schema).orderBy("SEQN").collect()
    assert back[0]["W/B"] == 0.1 + 0.2 and back[0]["y"] is None and back[1]["W/B"] != back[1]["W/B"]
    assert tables.read_table(spark, path).columns == ["SEQN", "W/B", "y"]


def test_metadata_document(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("double").alias("y"), F.lit(1.0).alias("a"))
    split = sampling.stratified_split(df, "row_id", "y")
    tables.write_json(tables.split_metadata(split, ["a"], "y", 0.3, 42), str(tmp_path / "m"))
    lines = [line for f in os.listdir(tmp_path / "m") if f.endswith(".json") for line in open(tmp_path / "m" / f)]
    doc = json.loads(lines[0])
    assert len(lines) == 1 and doc["train_samples"] == 70 and doc["test_samples"] == 30
    assert doc["train_balance"]["class_counts"] == {"0.0": 56, "1.0": 14}
    assert doc["test_balance"]["imbalance_ratio"] == 4.0 and doc["features"] == ["a"] and doc["random_state"] == 42


def test_scratch_follows_the_session(spark):
    root = scratch_root(spark)
    assert scratch_path(spark, "x").startswith(root) and scratch_path(spark, "x") != scratch_path(spark, "x")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_workflows(spark, sf_dir, tmp_path):
    source = inputs.planted(spark, sf_dir)
    source = source.unionByName(source.where("row_id % 50 = 0"))
    out = str(tmp_path / "prepared")
    report = prepare(spark, source, out, inputs.FEATURES, "y", "row_id", sample_size=50)
    assert report.where("check_name = 'duplicate_rows'").first().status == "WARNING"
    splits = spark.read.parquet(f"{out}/splits")
    assert {r.split: r["count"] for r in splits.groupBy("split").count().collect()} == {"train": 700, "test": 300}
    assert 45 <= spark.read.parquet(f"{out}/sample").count() <= 50

    train = splits.where("split = 'train'")
    sizes = {}
    for r in train.groupBy("y", "fold").count().collect():
        sizes.setdefault(r.y, {})[r.fold] = r["count"]
    assert all(set(own) == set(range(5)) and max(own.values()) - min(own.values()) <= 1 for own in sizes.values())
    assert splits.where("split = 'test' and fold is not null").count() == 0
    in_sample = spark.read.parquet(f"{out}/sample").join(train, "row_id").count()
    assert in_sample < spark.read.parquet(f"{out}/sample").count()
    with pytest.raises(ValueError, match="folds"):
        train_and_evaluate(spark, splits, str(tmp_path / "wrong"), inputs.FEATURES, "y", "row_id", n_folds=3)

    small = {"RandomForest": {"numTrees": 5, "maxDepth": 5}}
    run = train_and_evaluate(spark, splits, str(tmp_path / "run"), inputs.FEATURES, "y", "row_id",
                             names=["RandomForest", "LogisticRegression"], n_folds=5, overrides=small)
    assert {(r.model, r.model_type) for r in run["metrics"].collect()} == {
        ("RandomForest", "BaggedForestModel"), ("LogisticRegression", "LogisticRegressionModel"), ("Ensemble", "SoftVote")}
    assert all(r.accuracy > 0.8 for r in run["metrics"].collect())
    assert run["fold_test"]["pairs"] == 5
    assert set(os.listdir(tmp_path / "run")) >= {"fold_scores", "history", "status", "models", "importance", "predictions",
                                                 "metrics", "rankings", "curves"}

    def scorer(model, prompts):
        return ["1" if float(p.split("f_value: ")[1].split("\n")[0]) > 60 else "0" for p in prompts]

    test = splits.where("split = 'test'")
    for _ in range(2):   # the second run finds everything answered
        record = score_by_prompt(spark, test, str(tmp_path / "prompts"), inputs.FEATURES, "y", "row_id", ["a", "b"], scorer, 40)
    assert [(r.attempted, r.valid) for r in record.collect()] == [(40, 40)] * 2
    assert spark.read.parquet(str(tmp_path / "prompts" / "responses")).count() == 80

    def stops(model, prompts):
        raise RuntimeError("no key")

    with pytest.raises(RuntimeError, match="no key"):
        score_by_prompt(spark, test, str(tmp_path / "silent"), inputs.FEATURES, "y", "row_id", ["a"], stops, 40)
    pieces = str(tmp_path / "pieces")
    score_by_prompt(spark, test, pieces, inputs.FEATURES, "y", "row_id", ["a"], scorer, 40, slices=3)
    again = score_by_prompt(spark, test, pieces, inputs.FEATURES, "y", "row_id", ["a"], stops, 40, slices=3)
    assert [(r.model, r.attempted, r.valid) for r in again.collect()] == [("a", 40, 40)]


def test_tuning_changes_the_model_and_runs_replace_each_other(spark, sf_dir, tmp_path):
    out = str(tmp_path / "prepared")
    prepare(spark, inputs.planted(spark, sf_dir), out, inputs.FEATURES, "y", "row_id", sample_size=50, n_folds=3)
    splits, run = spark.read.parquet(f"{out}/splits"), str(tmp_path / "run")
    for _ in range(2):
        got = train_and_evaluate(spark, splits, run, inputs.FEATURES, "y", "row_id", names=["LogisticRegression"], n_folds=3,
                                 tune=True, grids={"LogisticRegression": {"C": [0.0001, 10.0], "maxIter": [50]}}, fit_rows=600)
    tuned = spark.read.json(f"{run}/tuning").collect()
    assert len(tuned) == 2 and {r.position for r in tuned} == {1, 2}
    best = next(r for r in tuned if r.position == 1)
    history = spark.read.parquet(f"{run}/history").collect()
    assert sorted(r.method for r in history) == ["cross_validation", "hyperparameter_tuning"]
    assert "50" in best.params and got["metrics"].count() == 1


def test_prepare_stops_on_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, 0)], "id long, y int")
    report = prepare(spark, df, str(tmp_path / "p"), ["a"], "y", "id")
    assert not report.first().passed and os.listdir(tmp_path / "p") == ["validation"]
