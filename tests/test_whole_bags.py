"""A bag has as many draws as the table has rows, however many these are; tasks stay bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.models import bags, forest, training


def table_of(spark, x, y, parts=3):
    rows = spark.createDataFrame([(k, int(y[k]), [float(v) for v in x[k]]) for k in range(len(y))], "row_id long, y int, x array<double>")
    return rows.repartition(parts)


def by_tree(nodes):
    out = {}
    for r in nodes.orderBy("tree", "node").collect():
        out.setdefault(r.tree, []).append(r)
    return out


def votes(nodes, x):
    """Of each tree alone."""
    of = lambda rows, k: np.array([r[k] for r in rows])
    return {t: forest.Block(*(of(rows, k) for k in forest._USED)).votes(x) for t, rows in by_tree(nodes).items()}


def test_every_row_is_drawn_from_at_full_rate(spark, monkeypatch):
    """Also beyond a million rows; before, trees of larger tables saw a sample."""
    seen = []

    class Grown(Exception):
        pass

    def grown(*given, **_):
        seen.append(given)
        raise Grown

    monkeypatch.setattr(forest, "class_counts", lambda *_: {0.0: 3_000_000, 1.0: 3_000_000})
    monkeypatch.setattr(forest, "node_table", grown)
    monkeypatch.setattr(forest, "large_node_table", grown, raising=False)
    rows = spark.createDataFrame([(1, 1, 0.5)], "row_id long, y int, a double")
    with pytest.raises(Grown):
        training.build("RandomForest").fit(training.assemble(rows, "row_id", "y", ["a"]))
    assert seen[0][-2] == 1.0


def test_packed_bags_hold_the_draws_of_plain_ones(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 62), 123456789] + list(range(1000, 3000))
    rows = spark.createDataFrame([(i,) for i in ids], "row_id long")
    for tree, seed, rate in ((0, 42, 1.0), (99, 7, 0.3), (5, 1 << 40, 2.0)):
        found = {r.row_id: r.t for r in rows.select("row_id", forest.draws(F.col("row_id"), F.lit(tree), seed, rate).alias("t")).collect()}
        places, times = bags.drawn(np.array(ids), tree, seed, bags.limits(rate))
        assert {ids[p]: int(t) for p, t in zip(places, times)} == {i: t for i, t in found.items() if t}


def test_packed_bags_grow_the_same_trees(spark):
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(700, 3)), 1), rng.integers(0, 2, 700)
    rows, given = table_of(spark, x, y), (4, 2, 1, 0, 9, 1.0, {0.0: 1.0, 1.0: 0.75})
    plain, packed = forest.node_table(rows, *given), forest.large_node_table(rows, 700, 3, *given)
    assert by_tree(plain) == by_tree(packed) and len(by_tree(plain)[0]) > 100


def purity(w, y):
    a, b = w[y == 0].sum(), w[y == 1].sum()
    return (a * a + b * b) / (a + b) if a + b else 0.0


def check_node(nodes, k, x, y, w, least, depth, level=0):
    """By all cuts of the rows below: the node has the best one, or there is none; how many nodes there are."""
    r, gains = nodes[k], []
    if len(set(y)) == 2 and not (depth and level >= depth):
        for f in range(x.shape[1]):
            for c in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= c
                if least <= left.sum() <= len(y) - least:
                    gains.append(purity(w[left], y[left]) + purity(w[~left], y[~left]) - purity(w, y))
    assert np.isclose(r.share, w[y == 1].sum() / w.sum())
    if not gains:
        assert r.feature == -1
        return 1
    left = x[:, r.feature] <= r.cut
    assert least <= left.sum() <= len(y) - least and np.isclose(r.gain, max(0.0, max(gains)), atol=1e-4)
    assert np.isclose(purity(w[left], y[left]) + purity(w[~left], y[~left]) - purity(w, y), r.gain, atol=1e-4)
    return 1 + check_node(nodes, r.left, x[left], y[left], w[left], least, depth, level + 1) + check_node(
        nodes, r.right, x[~left], y[~left], w[~left], least, depth, level + 1)


@pytest.mark.parametrize("least, depth, most, run", [(1, 0, 40, 300), (4, 0, 100, 400), (1, 5, 20, 100_000), (1, 3, 1, 500)])
def test_upper_nodes_of_large_bags_are_exact(spark, monkeypatch, least, depth, most, run):
    """All features are tried, so every node has the best cut of its rows; values repeat and lie in several runs."""
    monkeypatch.setattr(bags, "RUN_VALUES", run)
    rng = np.random.default_rng(most)
    x = np.stack([np.round(rng.normal(size=400), 2), rng.integers(0, 3, 400).astype(float), rng.normal(size=400)], axis=1)
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(scale=0.4, size=400) > 0.4).astype(int)
    found = by_tree(forest.large_node_table(table_of(spark, x, y), 400, 3, 2, 3, least, depth, 9, 1.0, {0.0: 1.0, 1.0: 1.5}, task_values=3 * most))
    assert found.keys() == {0, 1}
    for tree, rows in found.items():
        own, times = bags.drawn(np.arange(400), tree, 9, bags.limits(1.0))
        nodes = {r.node: r for r in rows}
        assert check_node(nodes, 0, x[own], y[own], times * np.where(y[own] == 1, 1.5, 1.0), least, depth) == len(nodes) == len(rows) > 7


def test_no_task_grows_from_more_rows_than_it_may(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(600, 4)), rng.integers(0, 2, 600)
    monkeypatch.setattr(bags, "RUN_VALUES", 400)
    rows = table_of(spark, x, y)
    runs = bags.sorted_runs(rows.select(bags.as_ids(rows), "y", "x"), 4, 600)
    assert all(len(ys) <= 300 for ys in runs.map(lambda r: r.y).collect())
    tops = bags.grow_tops(runs, 5, 4, 2, 1, 0, 3, 1.0, {}, 50)
    units = [bags.Unit(tree, 3, 1.0) for tree in range(5)]
    pieces, groups = bags.dealt(rows.select(bags.as_ids(rows), "y", "x"), 600, 4, units, tops, 200)
    found = pieces.groupBy("unit", "node").agg(F.sum(F.length("c")).alias("n"), F.count_distinct("part").alias("parts")).collect()
    assert {(r.unit, r.node): r.n for r in found} == {(t, k): n for t, top in enumerate(tops) for k, n in top.ready.items()}
    assert max(r.n for r in found) <= 50 and {r.parts for r in found} == {1} and len(groups) == len(found) > 5


def test_rows_that_nothing_tells_apart_and_odd_ids(spark):
    flat = table_of(spark, np.ones((200, 2)), np.arange(200) % 2)
    found = by_tree(forest.large_node_table(flat, 200, 2, 2, 1, 1, 0, 9, 1.0, {}, task_values=20))
    assert all(len(rows) == 1 and rows[0].feature == -1 and 0 < rows[0].share < 1 for rows in found.values()) and len(found) == 2
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    named = table_of(spark, x, x[:, 0] > 0).withColumn("row_id", F.when(F.col("row_id") % 7 > 0, F.concat(F.lit("id"), F.col("row_id") % 150)))
    found = votes(forest.large_node_table(named, 300, 2, 8, 1, 1, 0, 9, 1.0, {}, task_values=100), x)
    assert len(found) == 8 and np.mean((np.mean(list(found.values()), axis=0) > 0.5) == (x[:, 0] > 0)) > 0.9
