import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from scorelake import config
from scorelake.models import inspection, stages, training, tuning
from scorelake.operators import curves, metrics, sampling
from scorelake.sources.models import load_models, save_models


@pytest.fixture(scope="module")
def ring(spark):
    """Two features; class 1 lies outside a circle, so no line separates the classes."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (np.hypot(x[:, 0], x[:, 1]) > 1.5).astype(float)
    rows = [(i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(400)]
    df = sampling.ordered_folds(spark.createDataFrame(rows, "id long, y double, a double, `b/c` double"), "id", "y", 3)
    return training.assemble(df, "id", "y", ["a", "b/c"], keep=["fold"], partitions=2).persist()


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1.0, 5.0, 0.2]
    p = 1 / (1 + np.exp(-(x @ [1.5, -0.2, 2.0] - 1)))
    y = (rng.uniform(size=300) < p).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(300)],
                               "id long, y double, a double, b double, c double")
    return x, y, training.assemble(df, "id", "y", ["a", "b", "c"]).persist()


def newton(x, y, c):
    """Balanced ridge logistic regression by Newton steps."""
    k = np.array([np.sum(y == 0), np.sum(y == 1)])
    w = (len(y) / (2 * k))[y.astype(int)]
    z = np.column_stack([x, np.ones(len(y))])
    beta, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        g = ridge @ beta - c * z.T @ (w * (y - p))
        h = ridge + c * (z * (w * p * (1 - p))[:, None]).T @ z
        beta -= np.linalg.solve(h, g)
    return beta


@pytest.mark.parametrize("c", [1.0, 0.01])
def test_logistic_regression_against_newton(line, c):
    x, y, table = line
    model = training.build("LogisticRegression", C=c).fit(table).stages[-1]
    assert [*model.coefficients, model.intercept] == pytest.approx(newton(x, y, c), abs=2e-4)


def test_weights_are_learned_on_the_rows_given(ring):
    model = stages.ClassWeigher().fit(ring)
    n1 = ring.where("y = 1").count()
    found = {r.y: r.class_weight for r in model.transform(ring).select("y", "class_weight").distinct().collect()}
    assert found == {0.0: pytest.approx(400 / (2 * (400 - n1))), 1.0: pytest.approx(400 / (2 * n1))}
    part = stages.ClassWeigher().fit(ring.where("fold = 0"))
    assert part.getOrDefault(part.weights) != model.getOrDefault(model.weights)
    assert model.transform(ring.drop("y")).columns == ring.drop("y").columns


def test_fourier_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 3))
    df = training.assemble(spark.createDataFrame([(i, 0.0, *map(float, v)) for i, v in enumerate(x)],
                                                 "id long, y double, a double, b double, c double"), "id", "y", ["a", "b", "c"])
    mapped = stages.FourierFeatures(inputCol="features", outputCol="z", gamma=0.4, inputSize=3, components=4000, seed=5)
    z = np.array([r.z.toArray() for r in mapped.transform(df).orderBy("row_id").collect()])
    exact = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.08


def test_bandwidth(line):
    x, _, table = line
    gamma, size = stages.KernelSVM()._bandwidth(table)
    assert size == 3 and gamma == pytest.approx(1 / (3 * x.var()))
    assert stages.KernelSVM(gamma="auto")._bandwidth(table)[0] == pytest.approx(1 / 3)
    assert stages.KernelSVM(gamma=0.5)._bandwidth(table)[0] == 0.5


@pytest.mark.parametrize("name,params", [
    ("RandomForest", {"numTrees": 10}), ("SVM", {"components": 60, "maxIter": 30, "calibrationFolds": 3}),
    ("GradientBoosting", {"maxIter": 8, "maxDepth": 3})])
def test_curved_models_learn_the_ring(ring, name, params):
    predicted = training.predict({name: training.build(name, **params).fit(ring)}, ring)
    record = metrics.model_metrics(predicted).first()
    assert record["auc_roc"] > 0.95 and record["accuracy"] > 0.85 and record["valid"] == 400


def test_linear_and_polynomial_kernels(ring):
    params = {"maxIter": 30, "calibrationFolds": 2}
    linear, poly = (training.build("SVM", kernel=k, **params).fit(ring) for k in ("linear", "poly"))
    auc = {k: curves.roc_auc(training.predict({k: m}, ring)).first()["auc_roc"] for k, m in (("linear", linear), ("poly", poly))}
    assert auc["poly"] > 0.95 and auc["linear"] < 0.8
    with pytest.raises(ValueError):
        training.build("SVM", kernel="sigmoid").fit(ring)


def test_vote(spark, ring):
    model = training.build("LogisticRegression").fit(ring)
    predicted = training.predict({"one": model, "two": model}, ring, ensemble=True)
    rows = {(r.model, r.row_id): (r.pred, r.score) for r in predicted.collect()}
    assert len(rows) == 1200
    for i in range(400):
        assert rows["Ensemble", i][1] == pytest.approx(rows["one", i][1]) and rows["Ensemble", i][0] == rows["one", i][0]
    tie = training.soft_vote(spark.createDataFrame([(0.25, 0.75)], "a double, b double"), ["a", "b"]).first()
    assert (tie.score, tie.pred) == (0.5, 0)
    with pytest.raises(ValueError):
        training.soft_vote(ring, ["y"])


def test_failing_model_is_recorded(spark, ring):
    estimators = {"bad": training.build("SVM", kernel="none"), "good": training.build("LogisticRegression")}
    models, status = training.train_all(ring, estimators)
    assert list(models) == ["good"]
    got = {r.model: (r.status, r.error) for r in training.status_table(spark, status).collect()}
    assert got["good"] == ("trained", None) and got["bad"][0] == "failed" and "unknown kernel" in got["bad"][1]


def test_store_keeps_names_and_predictions(spark, ring, tmp_path):
    models = {"RandomForest": training.build("RandomForest", numTrees=3).fit(ring),
              "My SVM/2": training.build("SVM", components=20, maxIter=5, calibrationFolds=2).fit(ring),
              "GradientBoosting": training.build("GradientBoosting", maxIter=2).fit(ring)}
    save_models(spark, models, str(tmp_path / "models"))
    loaded = load_models(spark, str(tmp_path / "models"))
    assert list(loaded) == list(models) and all(isinstance(m, PipelineModel) for m in loaded.values())
    before, after = (sorted(map(tuple, training.predict(m, ring).collect())) for m in (models, loaded))
    assert before == after
    with pytest.raises(FileNotFoundError):
        load_models(spark, str(tmp_path / "nothing"))


def test_importance_and_coefficients(spark, ring):
    models = {"RandomForest": training.build("RandomForest", numTrees=3).fit(ring),
              "LogisticRegression": training.build("LogisticRegression").fit(ring),
              "SVM": training.build("SVM", components=20, maxIter=5, calibrationFolds=2).fit(ring)}
    rows = inspection.feature_importance(spark, models, ["a", "b/c"]).collect()
    forest = [r.importance for r in rows if r.model == "RandomForest"]
    assert sum(forest) == pytest.approx(1.0) and forest == sorted(forest, reverse=True)
    linear = [r for r in rows if r.model == "LogisticRegression"]
    assert all(r.abs_coefficient == abs(r.coefficient) for r in linear) and len(linear) == 2
    assert not [r for r in rows if r.model == "SVM"]


def test_cross_validation_scores_every_row_once(ring):
    found = training.cross_validate(ring, training.registry(["LogisticRegression"]), 3)
    assert found.count() == 400 and found.select("row_id").distinct().count() == 400
    scores = training.fold_scores(found).collect()
    assert sorted(r.fold for r in scores) == [0, 1, 2]


def test_grid_sizes():
    sizes = {n: len(tuning.combinations(g)) for n, g in config.PARAM_GRIDS.items()}
    assert sizes == {"RandomForest": 108, "LogisticRegression": 36, "SVM": 72, "GradientBoosting": 243}


def test_sampled_combinations_are_distinct_and_reproducible():
    grid = config.PARAM_GRIDS["SVM"]
    one, two = tuning.sampled_combinations(grid, 20), tuning.sampled_combinations(grid, 20)
    assert one == two and len({str(c) for c in one}) == 20
    assert len(tuning.sampled_combinations({"C": [1.0, 2.0]}, 20)) == 2


def test_grid_search(spark, ring):
    found = tuning.grid_search(ring, "RandomForest", {"numTrees": [5], "maxDepth": [1, 8]}, parallelism=2)
    assert found.best_params == {"numTrees": 5, "maxDepth": 8} and found.best_score > 0.85
    table = found.table(spark).orderBy("position").collect()
    assert [r.position for r in table] == [1, 2] and table[0].mean_score == pytest.approx(found.best_score)
    assert found.best_model.stages[-1].getNumTrees == 5


def test_random_search_reports_failures(ring):
    found = tuning.random_search(ring, ["LogisticRegression", "SVM"], n_iter=1,
                                 grids={"SVM": {"kernel": ["none"]}, "LogisticRegression": {"C": [1.0], "maxIter": [20]}})
    assert isinstance(found["SVM"], ValueError) and found["LogisticRegression"].best_params["C"] == 1.0


def test_missing_feature_values(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, None)], "id long, y double, a double")
    assert training.assemble(df, "id", "y", ["a"], missing="skip").count() == 1
    with pytest.raises(Exception):
        training.assemble(df, "id", "y", ["a"]).collect()


def test_history_is_numbered(spark, tmp_path):
    path = str(tmp_path / "history")
    for method in ("cross_validation", "hyperparameter_tuning"):
        training.append_history(training.history_rows(spark.createDataFrame([("m", 0.5)], "model string, s double"), method, "d", "s"), path)
    rows = training.training_summary(spark.read.parquet(path)).orderBy("training").collect()
    assert [(r.training, r.method, r.best_score) for r in rows] == [(1, "cross_validation", 0.5), (2, "hyperparameter_tuning", 0.5)]
    assert math.isfinite(rows[0].trained_at.timestamp())


def test_labels_are_zero_and_one(spark):
    df = spark.range(300).select(F.col("id").alias("y"))
    with pytest.raises(ValueError, match="other than 0 and 1"):
        stages.class_counts(df, "y")
    with pytest.raises(ValueError, match="missing"):
        stages.class_counts(df.select(F.when(F.col("y") > 1, None).otherwise(F.col("y")).alias("y")), "y")
    assert stages.class_counts(df.where("y = 1"), "y") == {1.0: 1}


def test_a_failing_model_does_not_end_cross_validation(spark, ring):
    estimators = training.registry(["LogisticRegression"]) | {"broken": training.build("SVM", kernel="none")}
    failures = []
    found = training.cross_validate(ring, estimators, 3, failures=failures)
    assert {r.model for r in found.select("model").distinct().collect()} == {"LogisticRegression"}
    assert [(n, s) for n, s, _ in failures] == [("broken", "failed")] and "kernel" in failures[0][2]
    with pytest.raises(RuntimeError, match="broken"):
        training.cross_validate(ring, estimators, 3)


def test_fit_rows_bound_the_fit_but_not_the_scoring(spark, ring):
    bounded = training.fit_sample(ring, 100)
    assert bounded.count() == 100
    share = [ring.where("y = 1").count() / 400, bounded.where("y = 1").count() / 100]
    assert abs(share[0] - share[1]) < 0.02
    models, status = training.train_all(ring, training.registry(["LogisticRegression"]), fit_rows=100)
    alone = training.registry(["LogisticRegression"])["LogisticRegression"].fit(bounded)
    assert status[0][1] == "trained" and training.predict(models, ring).count() == 400
    assert models["LogisticRegression"].stages[0].coefficients == alone.stages[0].coefficients


def test_an_empty_fold_is_named(ring):
    with pytest.raises(ValueError, match="fold"):
        tuning.grid_search(ring, "LogisticRegression", {"C": [1.0]}, n_folds=4)


def test_partitions_grow_once_every_core_has_one(spark):
    table = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("y"), F.col("id").cast("double").alias("a"))
    cores = spark.sparkContext.defaultParallelism
    parts = [training.assemble(table, "row_id", "y", ["a"], rows_per_partition=n).rdd.getNumPartitions() for n in (10, 4000)]
    assert parts == [cores, 1]


def test_candidates_share_a_fit_that_ended_before_its_limit(ring, monkeypatch):
    fitted, plain = [], tuning.build
    monkeypatch.setattr(tuning, "build", lambda name, **params: fitted.append(params) or plain(name, **params))
    found = tuning.grid_search(ring, "LogisticRegression", {"C": [0.01, 1.0], "maxIter": [500, 300]})
    assert len(fitted) == 2 * 3 + 1 and [s["params"]["maxIter"] for s in found.scores if s["params"]["C"] == 1.0] == [500, 300]
    fitted.clear()
    grid = {"C": [10.0], "maxIter": [1, 2, 400]}                    # the first two limits bind
    found = tuning.grid_search(ring, "LogisticRegression", grid)
    assert len(fitted) == 3 * 3 + 1
    for s in found.scores:
        alone = tuning.search(ring, "LogisticRegression", [s["params"]])
        assert (s["mean"], s["std"]) == (alone.best_score, alone.scores[0]["std"])


def test_kernel_machines_hold_few_mapped_copies(ring, monkeypatch):
    svm = stages.KernelSVM(components=20, maxIter=5, calibrationFolds=2)
    assert svm._at_once(ring) == svm.getOrDefault("parallelism")
    before = svm.fit(ring)
    monkeypatch.setattr(stages, "HELD_BYTES", 1000)
    assert svm._at_once(ring) == 1 and stages.KernelSVM(kernel="poly")._width(2) == 9
    rows = lambda m: sorted((r.row_id, round(r.probability[1], 9)) for r in m.transform(ring).collect())
    assert rows(svm.fit(ring)) == rows(before)
