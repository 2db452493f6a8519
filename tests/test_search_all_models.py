"""A search covers every model; candidates of a model grow together and score as fits of their own do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.models import boosting, forest, training, tuning
from scorelake.queries import learning


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(500, 3)), 2)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(scale=0.5, size=500) > 0.4).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), *map(float, x[i]), i % 3) for i in range(500)], "id long, y int, a double, b double, c double, fold int")
    return training.assemble(rows, "id", "y", ["a", "b", "c"], keep=["fold"], partitions=2).persist()


def test_the_query_searches_every_model(spark, sf_dir, monkeypatch):
    asked = []

    def search(table, name, candidates, *_):
        asked.append((name, len(candidates)))
        scores = [{"params": c, "mean": 1.0 - k / 100, "std": 0.0} for k, c in enumerate(candidates)]
        return tuning.SearchResult(name, candidates[0], 1.0, None, scores)

    monkeypatch.setattr(tuning, "search", search)
    found = learning.random_search(spark, sf_dir).collect()
    assert sorted(asked) == sorted((name, 20) for name in training.MODEL_NAMES)
    assert {(r.model, r.candidates, r.different, r.position_follows_score) for r in found} == {(name, 20, 20, True) for name in training.MODEL_NAMES}


def test_a_failing_model_fails_the_query(spark, sf_dir, monkeypatch):
    def search(table, name, *_):
        raise ValueError(f"no {name}")

    monkeypatch.setattr(tuning, "search", search)
    with pytest.raises(RuntimeError, match="search failed.*no SVM"):
        learning.random_search(spark, sf_dir)


def rows_of(model, spark):
    return sorted(map(tuple, model.node_rows(spark).collect()))


def test_boosted_candidates_are_the_models_of_their_own_fits(folded):
    unseen = [F.col("fold") != f for f in range(3)]
    made = [training.build("GradientBoosting", **p).getStages()[0] for p in (
        dict(maxIter=3, maxDepth=2), dict(maxIter=13, maxDepth=4, stepSize=0.2, subsamplingRate=0.8), dict(maxIter=11, maxDepth=3, columnRate=0.7))]
    jobs = [(m, f) for m in made for f in (0, 2)]
    together = boosting.BoostedTrees.fit_many(folded, unseen, jobs)
    for (m, f), model in zip(jobs, together):
        alone = m.fit(folded.where(unseen[f]))
        assert rows_of(model, folded.sparkSession) == rows_of(alone, folded.sparkSession) and model.featureImportances == alone.featureImportances


def test_forests_of_a_search_grow_from_their_own_rows(folded, monkeypatch):
    unseen = [F.col("fold") != f for f in range(3)]
    made = [training.build("RandomForest", **p).getStages()[0] for p in (
        dict(numTrees=3, maxDepth=3), dict(numTrees=7, minInstancesPerNode=4, featureSubsetStrategy="all"))]
    jobs = [(m, f) for m in made for f in range(3)]
    tables = lambda models: [sorted(tuple(round(v, 9) for v in r) for r in rows_of(m, folded.sparkSession)) for m in models]
    together = forest.BaggedForest.fit_many(folded, unseen, jobs)
    assert [m.getNumTrees for m in together] == [3, 3, 3, 7, 7, 7]
    assert [m.getOrDefault("nodeCount") for m in together] == [len(t) for t in tables(together)]
    for (m, f), model in zip(jobs, together):
        own = folded.where(unseen[f])
        alone = m.fit(own)
        votes = lambda fitted: {r.row_id: r.probability[1] for r in fitted.transform(own).collect()}
        one, other = votes(model), votes(alone)
        assert np.mean([abs(one[k] - other[k]) for k in one]) < 0.02
        assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9
    monkeypatch.setattr(forest, "SHARED_VALUES", 500 * 3 * 8)             # in several deals, or alone
    again = forest.BaggedForest.fit_many(folded, unseen, jobs)
    assert tables(again)[:2] == tables(together)[:2] and len(again) == 6


def test_search_scores_are_those_of_fits_one_by_one(folded):
    candidates = [dict(maxIter=4, maxDepth=2), dict(maxIter=9, maxDepth=3), dict(maxIter=4, maxDepth=2)]
    found = tuning.search(folded, "GradientBoosting", candidates)
    assert len(found.scores) == 3
    for s in found.scores:
        values = []
        for f in range(3):
            model = training.build("GradientBoosting", **s["params"]).fit(folded.where(F.col("fold") != f))
            values.append(model.transform(folded.where(F.col("fold") == f)).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0])
        assert s["mean"] == pytest.approx(np.mean(values), abs=1e-12)
