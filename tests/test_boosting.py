"""Boosted trees against a plain version of the same rules."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from scorelake.models import boosting, inspection, training


def frame(spark, x, y, parts=3):
    names = [f"f{k}" for k in range(x.shape[1])]
    rows = [(k, int(y[k]), *map(float, x[k])) for k in range(len(y))]
    df = spark.createDataFrame(rows, "row_id long, y int, " + ", ".join(f"{n} double" for n in names)).repartition(parts)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).select("row_id", "y", "features")


def plain(x, y, rounds, depth, step, positive, ridge=1.0, least=1.0):
    """Margins after some rounds; every value but the largest is a cut."""
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, positive, 1.0)
        g, h = (p - y) * w, p * (1 - p) * w

        def grow(rows, level):
            best = None
            if level < depth:
                for f in range(x.shape[1]):
                    for c in np.unique(x[:, f])[:-1]:
                        left = x[rows, f] <= c
                        hl, hr = h[rows][left].sum(), h[rows][~left].sum()
                        if hl < least or hr < least:
                            continue
                        gl, gr = g[rows][left].sum(), g[rows][~left].sum()
                        gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, left)
            if best is None:
                margin[rows] += -g[rows].sum() / (h[rows].sum() + ridge) * step * (level > 0)
                return
            grow(rows[best[1]], level + 1)
            grow(rows[~best[1]], level + 1)

        grow(np.arange(len(y)), 0)
    return margin


@pytest.mark.parametrize("rounds, depth, positive", [(1, 1, 1.0), (3, 3, 4.0), (12, 2, 2.0)])
def test_margins_are_the_plain_margins(spark, rounds, depth, positive):
    rng = np.random.default_rng(rounds)
    x = rng.integers(0, 9, (160, 3)).astype(float)
    y = ((x[:, 0] + x[:, 1] + rng.normal(0, 2, 160)) > 8).astype(int)
    table = frame(spark, x, y)
    model = training.build("GradientBoosting", maxIter=rounds, maxDepth=depth, positiveWeight=positive).fit(table)
    got = np.array([r.probability[1] for r in model.transform(table).orderBy("row_id").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-plain(x, y, rounds, depth, 0.1, positive))), atol=1e-4)


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=3000), rng.integers(0, 4, 3000)], axis=1)
    table = frame(spark, x, (x[:, 0] > 0.3).astype(int))
    cuts = boosting.bin_cuts(table.select(vector_to_array("features").alias("x")), 2, 16)
    assert len(cuts[0]) == 15 and cuts[1].tolist() == [0, 1, 2]
    shares = np.diff([0, *(np.mean(x[:, 0] <= c) for c in cuts[0]), 1])
    assert shares.min() > 0.03 and shares.max() < 0.1
    model = training.build("GradientBoosting", maxIter=3, maxBins=64).fit(table)
    hit = model.transform(table).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert hit > 0.97
    found = inspection.feature_importance(spark, {"b": model}, ["f0", "f1"]).collect()
    assert found[0].feature == "f0" and abs(sum(r.importance for r in found) - 1) < 1e-9


def test_columns_are_drawn_per_tree(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (300, 4)).astype(float)
    table = frame(spark, x, (x.sum(axis=1) > 10).astype(int))
    model = training.build("GradientBoosting", maxIter=8, maxDepth=4, columnRate=0.5, subsamplingRate=0.7).fit(table).stages[-1]
    used = {}
    for r in model.node_rows(spark).where("feature >= 0").collect():
        used.setdefault(r.tree, set()).add(r.feature)
    assert max(map(len, used.values())) == 2 and len(set(map(frozenset, used.values()))) > 2


def test_same_trees_whatever_the_partitions_and_reload(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (400, 3)).astype(float)
    y = (x[:, 0] * x[:, 1] > 90).astype(int)
    models = [training.build("GradientBoosting", maxIter=11, maxDepth=3).fit(frame(spark, x, y, parts)) for parts in (1, 6)]
    one, two = (sorted(map(tuple, m.stages[-1].node_rows(spark).collect())) for m in models)
    assert one == two and {n[0] for n in one} == set(range(11))
    models[0].write().overwrite().save(f"{tmp_path}/m")
    table = frame(spark, x, y)
    rows = lambda m: sorted((r.row_id, r.probability[1]) for r in m.transform(table).collect())
    assert rows(PipelineModel.load(f"{tmp_path}/m")) == rows(models[0])


def test_odd_tables(spark):
    x = np.ones((5, 2))
    model = training.build("GradientBoosting", maxIter=2).fit(frame(spark, x, np.array([0, 1, 0, 1, 1])))      # nothing to cut
    assert {r.probability[1] for r in model.transform(frame(spark, x, np.zeros(5))).collect()} == {0.5}
    assert model.transform(frame(spark, x, np.zeros(5)).where("false")).count() == 0
    with pytest.raises(ValueError):
        training.build("GradientBoosting").fit(frame(spark, x, np.zeros(5)).where("false"))


def test_a_level_adds_up_one_child_of_two(spark, monkeypatch):
    """The other child's sums are its parent's rest, and margins go on from tree to tree."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 20, (500, 3)).astype(float)
    asked, plain_sums = [], boosting.level_sums
    monkeypatch.setattr(boosting, "level_sums", lambda rows, tree, columns, bins, leaves: (
        asked.append(list(leaves)) or plain_sums(rows, tree, columns, bins, leaves)))
    training.build("GradientBoosting", maxIter=3, maxDepth=4).fit(frame(spark, x, (x[:, 0] * x[:, 1] > 90).astype(int)))
    assert max(map(len, asked)) > 2
    for leaves in asked:
        assert leaves == [1] or len({k // 2 for k in leaves}) == len(leaves)
