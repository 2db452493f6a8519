"""Forests grown in tasks against a plain tree, and their two ways of scoring."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from scorelake.models import forest, inspection, training


def gini_drop(y, w, left):
    def part(m):
        a, b = w[m & (y == 0)].sum(), w[m & (y == 1)].sum()
        return (a * a + b * b) / (a + b) if a + b else 0.0
    return part(left) + part(~left)


def plain_tree(x, y, w, least, depth):
    """Predictions of a tree on its own rows, by recursion over all cuts; also the depth reached."""
    out, deepest = np.zeros(len(y)), 0

    def split(rows, level):
        nonlocal deepest
        deepest = max(deepest, level)
        yr, wr = y[rows], w[rows]
        out[rows] = wr[yr == 1].sum() / wr.sum()
        if len(set(yr)) < 2 or (depth and level >= depth):
            return
        best = max(((gini_drop(yr, wr, x[rows, f] <= c), -f, -c) for f in range(x.shape[1]) for c in np.unique(x[rows, f])[:-1]
                    if least <= (x[rows, f] <= c).sum() <= len(rows) - least), default=None)
        if best:
            left = x[rows, -best[1]] <= -best[2]
            split(rows[left], level + 1)
            split(rows[~left], level + 1)

    split(np.arange(len(y)), 0)
    return out, deepest


@pytest.mark.parametrize("least, depth", [(1, 0), (3, 0), (1, 2)])
def test_tree_is_the_plain_tree(least, depth):
    rng = np.random.default_rng(least)
    for _ in range(10):
        x = rng.normal(size=(80, 3))                      # no equal gains between unlike cuts
        y, w = rng.integers(0, 2, 80), rng.uniform(0.5, 2, 80)
        t = forest.grow(x, y, w, 3, least, depth, 1)
        n = len(t["feature"])
        votes = forest.Block(np.zeros(n, int), np.arange(n), t["feature"], t["cut"], t["left"], t["right"], t["share"]).votes(x)
        assert np.allclose(votes, plain_tree(x, y, w, least, depth)[0])


def test_depth_has_no_limit():
    """Labels that only a comb of cuts can tell apart."""
    n = 2_000
    x = np.arange(n, dtype=float)[:, None]
    y = (np.arange(n) % 2).astype(int)
    t = forest.grow(x, y, np.ones(n), 1, 1, 0, 1)
    level = np.zeros(len(t["feature"]), int)
    for k in np.flatnonzero(t["feature"] >= 0):
        level[[t["left"][k], t["right"][k]]] = level[k] + 1
    assert level.max() > 40 and set(t["share"][t["feature"] < 0]) == {0.0, 1.0}


@pytest.fixture(scope="module")
def ring(spark):
    rng = random.Random(3)
    rows = [(k, *(rng.uniform(-1, 1) for _ in range(4))) for k in range(900)]
    df = spark.createDataFrame([(r[0], int(r[1] ** 2 + r[2] ** 2 < 0.5), *r[1:]) for r in rows], "row_id long, y int, a double, b double, c double, d double")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df.repartition(4)).select("row_id", "y", "features")


def test_forest_ranks_unseen_rows(ring):
    train, test = ring.where("row_id % 3 > 0"), ring.where("row_id % 3 = 0")
    model = training.build("RandomForest", numTrees=30).fit(train)
    hit = model.transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    own = model.transform(train).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert hit > 0.85 and own > 0.97
    found = inspection.feature_importance(ring.sparkSession, {"f": model}, list("abcd")).collect()
    assert {r.feature for r in found[:2]} == {"a", "b"} and abs(sum(r.importance for r in found) - 1) < 1e-9


def test_same_forest_whatever_the_partitions(ring):
    def nodes(table):
        model = training.build("RandomForest", numTrees=5).fit(table).stages[-1]
        return sorted(map(tuple, model.node_rows(table.sparkSession).collect()))

    assert nodes(ring) == nodes(ring.repartition(7)) and len({n[0] for n in nodes(ring)}) == 5


def test_dealt_rows_get_the_same_votes(ring):
    model = training.build("RandomForest", numTrees=7).fit(ring).stages[-1]
    near = {r.row_id: r.probability[1] for r in model.transform(ring).collect()}
    dealt = {r.row_id: r.probability[1] for r in model._transform(ring, block_nodes=150).collect()}
    assert near.keys() == dealt.keys() and all(abs(near[k] - dealt[k]) < 1e-12 for k in near)


def test_bags_are_draws_with_replacement(ring):
    for rate in (1.0, 0.25):
        times = ring.select(forest.draws(F.col("row_id"), F.lit(3), 42, rate).alias("t")).groupBy("t").count().collect()
        found = {r.t: r["count"] for r in times}
        assert abs(sum(k * n for k, n in found.items()) / 900 - rate) < 0.12
        assert abs(found[0] / 900 - np.exp(-rate)) < 0.06
    model = training.build("RandomForest", numTrees=4, maxBagRows=50).fit(ring)        # a bag of about 50 rows
    assert model.stages[-1].getOrDefault("nodeCount") < 4 * 100


def test_reload_and_odd_tables(ring, tmp_path):
    model = training.build("RandomForest", numTrees=3, maxDepth=4).fit(ring)
    model.write().overwrite().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m")
    rows = lambda m: sorted((r.row_id, r.prediction, r.probability[1]) for r in m.transform(ring).collect())
    assert rows(model) == rows(again)
    assert model.transform(ring.where("false")).count() == 0
    one = training.build("RandomForest", numTrees=2).fit(ring.where("y = 1"))
    assert {r.prediction for r in one.transform(ring).collect()} == {1.0}
    flat = training.build("RandomForest", numTrees=2).fit(ring.withColumn("features", F.lit(None)).drop("features").join(
        ring.limit(1).select("features")))                                          # equal rows, both classes
    assert {round(r.probability[1], 6) for r in flat.transform(ring).collect()} == {
        round(sum(x) / 2, 6) for x in [[n.share for n in flat.stages[-1].node_rows(ring.sparkSession).collect()]]}
    with pytest.raises(ValueError):
        training.build("RandomForest").fit(ring.where("false"))


def test_a_large_forest_is_read_by_the_tasks_and_rows_stay(ring):
    """Neither rows nor trees are shuffled or joined for it, and rows may share an id."""
    model = training.build("RandomForest", numTrees=9).fit(ring).stages[-1]
    twice = ring.unionByName(ring)
    dealt = model._transform(twice, block_nodes=150)
    steps = [[df._jdf.queryExecution().executedPlan().toString().count(s) for s in ("Exchange", "Join")] for df in (twice, dealt)]
    assert steps[0] == steps[1]
    votes = {}
    for r in dealt.collect():
        votes.setdefault(r.row_id, []).append(r.probability[1])
    near = {r.row_id: r.probability[1] for r in model._transform(ring).collect()}
    assert all(len(v) == 2 and abs(v[0] - near[k]) < 1e-9 and abs(v[1] - near[k]) < 1e-9 for k, v in votes.items())
    assert len(votes) == len(near)
