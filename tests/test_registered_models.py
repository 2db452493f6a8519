"""The registered queries cross-validate every model; the fits themselves are replaced here."""

from pyspark.sql import functions as F

from scorelake.models import training
from scorelake.queries import learning


def test_all_models_are_cross_validated(spark, sf_dir, monkeypatch):
    fitted = []

    def cross_validate(table, estimators, n_folds, **_):
        names = F.explode(F.array(*map(F.lit, estimators)))
        return table.select(names.alias("model"), "row_id", F.col("y").cast("int").alias("y"), F.lit(1).alias("pred"),
                            F.lit(0.5).alias("score"), "fold")

    def train_all(table, estimators, **_):
        fitted.extend(estimators)
        return {}, [(name, "trained", None) for name in estimators]

    monkeypatch.setattr(training, "cross_validate", cross_validate)
    monkeypatch.setattr(training, "train_all", train_all)
    for run in (learning.cross_validate, learning.train_cv):
        assert {r.model for r in run(spark, sf_dir).collect()} == set(training.MODEL_NAMES)
    assert fitted == training.MODEL_NAMES
