"""Models of several folds grow side by side."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.models import boosting, hinge, stages, training


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(600, 2)), 2)
    y = ((x ** 2).sum(axis=1) + rng.normal(scale=0.3, size=600) > 1.4).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), *map(float, x[i]), i % 3) for i in range(600)], "id long, y int, a double, b double, fold int")
    return training.assemble(rows, "id", "y", ["a", "b"], keep=["fold"], partitions=3).persist()


def scored(model, table):
    return {r.row_id: r.probability[1] for r in model.transform(table).collect()}


def test_folds_share_the_jobs_of_one_boosted_model(folded, monkeypatch):
    calls, plain = [], boosting.part_sums
    monkeypatch.setattr(boosting, "part_sums", lambda *given: calls.append(len(given[1])) or plain(*given))
    estimator = training.build("GradientBoosting", maxIter=12, maxDepth=3, subsamplingRate=0.8)
    parts = [F.col("fold") != f for f in range(3)]
    found = estimator.getStages()[0].fit_parts(folded, parts)
    assert len(calls) <= 12 * 3 and max(calls) == 3
    for model, part in zip(found, parts):
        alone = estimator.fit(folded.where(part)).stages[0]
        rows = lambda m: sorted(map(tuple, m.node_rows(folded.sparkSession).collect()))
        assert rows(model) == rows(alone) and model.featureImportances == alone.featureImportances


def test_machines_of_all_folds_share_jobs_and_end_where_linear_svc_does(folded, monkeypatch):
    calls, plain = [], hinge.losses
    monkeypatch.setattr(hinge, "losses", lambda *given: calls.append(len(given[2])) or plain(*given))
    svm = stages.KernelSVM(components=40, calibrationFolds=2)
    parts = [F.col("fold") != f for f in range(3)]
    found = svm.fit_parts(folded, parts)
    assert max(calls) == 3 * 3 and len(calls) < 400          # nine machines, each up to 100 steps

    def objective(machine, rows):
        """Of LinearSVC, with balanced classes."""
        data = [(r.y, r.kernel_features.toArray()) for r in rows.select("y", "kernel_features").collect()]
        y, z = np.array([d[0] for d in data]), np.stack([d[1] for d in data])
        w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
        c = machine.coefficients.toArray()
        return w @ np.maximum(0, 1 - (2 * y - 1) * (z @ c + machine.intercept)) / w.sum() + c @ c / (2 * w.sum())

    for model, part in zip(found, parts):
        rows = folded.where(part)
        alone, held = svm.fit(rows), svm._fit_held(rows)
        mapped = held.stages[0].transform(rows)
        assert objective(model.stages[1], mapped) == pytest.approx(objective(held.stages[1], mapped), abs=2e-3)
        one, other, third = (scored(m, folded) for m in (model, alone, held))
        assert max(abs(one[k] - other[k]) for k in one) < 0.01
        assert np.mean([abs(one[k] - third[k]) for k in one]) < 0.02


def test_cross_validation_names_the_fold_that_fails(folded):
    broken = folded.withColumn("y", F.when(F.col("fold") == 1, F.lit(2.0)).otherwise(F.col("y")))
    failures = []
    made = {"GradientBoosting": training.build("GradientBoosting", maxIter=2, maxDepth=2)}
    with pytest.raises(RuntimeError, match="fold 0: ValueError: y has classes other than 0 and 1"):
        training.cross_validate(broken, made, 3, failures=failures)


def test_folds_together_score_as_folds_one_by_one(folded):
    made = {"GradientBoosting": training.build("GradientBoosting", maxIter=6, maxDepth=3), "LogisticRegression": training.build("LogisticRegression")}
    rows = lambda found: sorted(map(tuple, found.select("model", "row_id", "pred", "score", "fold").collect()))
    together = rows(training.cross_validate(folded, made, 3))
    one_by_one = []
    for f in range(3):
        models = {n: e.fit(folded.where(F.col("fold") != f)) for n, e in made.items()}
        one_by_one += rows(training.predict(models, folded.where(F.col("fold") == f), keep=["fold"]))
    assert [r[:3] for r in together] == [r[:3] for r in sorted(one_by_one)] and len(together) == 1200
