"""Grid and randomized search with the accuracy of stratified folds."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake import config
from scorelake.models.training import build, by_parts, registry, run_fits
from scorelake.session import scratch_root


def combinations(grid: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All combinations, in the order of the grid."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def sampled_combinations(grid: Mapping[str, Sequence[Any]], n: int, seed: int = config.RANDOM_STATE) -> list[dict]:
    """``n`` different combinations drawn with the seed; all of them when the grid is smaller."""
    every = combinations(grid)
    return every if n >= len(every) else random.Random(seed).sample(every, n)


@dataclass
class SearchResult:
    name: str
    best_params: dict[str, Any]
    best_score: float
    best_model: PipelineModel
    scores: list[dict[str, Any]]

    def table(self, spark: SparkSession) -> DataFrame:
        """(model, params, mean_score, std_score, position), best first by position."""
        rows = [(self.name, json.dumps(s["params"]), s["mean"], s["std"], i)
                for i, s in enumerate(self.scores, 1)]
        return spark.createDataFrame(
            rows, "model string, params string, mean_score double, std_score double, position int")


def _settled(model: PipelineModel) -> bool:
    """The fit ended before its limit of iterations: any larger limit gives this very model."""
    last = model.stages[-1]
    return isinstance(last, LogisticRegressionModel) and last.hasSummary and last.summary.totalIterations < last.getMaxIter()


def search(table: DataFrame, name: str, candidates: Sequence[dict], n_folds: int = 3, parallelism: int = 2) -> SearchResult:
    """Score every candidate on every fold of ``table`` (column ``fold``), refit the best on all rows.

    Candidates that differ in ``maxIter`` alone share the fit with the smallest limit where that fit ended before it.
    Forests grow together, boosted models side by side, kernel machines take the folds side by side. Only accuracies
    reach the driver. Equal scores keep the order of the candidates.
    """
    scratch_root(table.sparkSession)
    kind = registry([name])[name]
    many = hasattr(kind.getStages()[0], "fit_many")
    together = not many and by_parts(kind) is not None
    alike: dict[str, list[int]] = {}
    for c, params in enumerate(candidates):
        shared = params if together or many else {k: v for k, v in params.items() if k != "maxIter"}
        alike.setdefault(json.dumps(shared, sort_keys=True), []).append(c)
    groups = [sorted(group, key=lambda c: candidates[c].get("maxIter", 0)) for group in alike.values()]
    unseen = [F.col("fold") != f for f in range(n_folds)]

    def accuracy(model, f):
        hit = (F.col("prediction") == F.col("y")).cast("double")
        found = model.transform(table.where(F.col("fold") == f)).agg(F.avg(hit).alias("a")).first()["a"]
        if found is None:
            raise ValueError(f"fold {f} has no rows")
        return found

    def score(job):
        group, f, *model = job
        if many:
            return [(c, f, accuracy(*model, f)) for c in group]
        if f is None:
            return [(c, g, accuracy(model, g)) for c in group
                    for g, model in enumerate(by_parts(build(name, **candidates[c])).fit_parts(table, unseen))]
        found, settled, value = [], False, None
        for c in group:
            if not settled:
                model = build(name, **candidates[c]).fit(table.where(unseen[f]))
                value, settled = accuracy(model, f), "maxIter" in candidates[c] and _settled(model)
            found.append((c, f, value))
        return found

    folds = [None] if together else range(n_folds)
    jobs = [(group, f) for group in groups for f in folds]
    if many:
        asked = [(build(name, **candidates[c]).getStages()[0], f) for (c, *_), f in jobs]
        jobs = [(*job, model) for job, model in zip(jobs, asked[0][0].fit_many(table, unseen, asked))]
    found = {(c, f): a for part in run_fits(table.sparkSession, jobs, score, parallelism) for c, f, a in part}
    scores = []
    for c, params in enumerate(candidates):
        values = [found[c, f] for f in range(n_folds)]
        mean = sum(values) / len(values)
        std = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
        scores.append({"params": params, "mean": mean, "std": std})
    scores.sort(key=lambda s: -s["mean"])
    best = scores[0]
    return SearchResult(name, best["params"], best["mean"], build(name, **best["params"]).fit(table), scores)


def grid_search(table: DataFrame, name: str, grid: Mapping[str, Sequence[Any]] | None = None, n_folds: int = 3,
                parallelism: int = 2) -> SearchResult:
    return search(table, name, combinations(grid or config.PARAM_GRIDS[name]), n_folds, parallelism)


def random_search(table: DataFrame, names: Sequence[str] = tuple(config.PARAM_GRIDS), n_iter: int = 20, n_folds: int = 3,
                  seed: int = config.RANDOM_STATE, grids: Mapping[str, Mapping] | None = None,
                  parallelism: int = 2) -> dict[str, SearchResult | Exception]:
    """Randomized search for several models; a failing model is returned as its exception."""
    def one(name):
        try:
            return search(table, name, sampled_combinations((grids or {}).get(name, config.PARAM_GRIDS[name]), n_iter, seed), n_folds, parallelism)
        except Exception as e:
            return e

    return dict(zip(names, run_fits(table.sparkSession, list(names), one, parallelism)))
