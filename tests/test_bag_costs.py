"""What a bag and a tree read again and again is kept small."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.models import boosting, forest


def test_one_digest_decides_whether_a_row_is_drawn(spark):
    rows = spark.range(2000).select(F.col("id").alias("row_id"), F.lit(1).alias("y"), F.array(F.lit(1.0)).alias("x"))
    plan = forest.node_table(rows, 4, 1, 1, 0, 7, 0.3, {1.0: 1.0})._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if "Filter" in line]
    assert sum(line.count("xxhash64") for line in conditions) == 1
    times = forest.draws(F.col("row_id"), F.lit(2), 7, 0.3)
    found = rows.select(times.alias("times"), (forest._uniform(F.col("row_id"), F.lit(2), 7) >= F.lit(float(np.exp(-0.3)))).alias("drawn")).collect()
    assert all((r.times > 0) == r.drawn for r in found) and 0 < sum(r.drawn for r in found) < 2000


@pytest.mark.parametrize("subset", [1, 2, 3])
def test_cuts_are_sought_for_tried_features_only(monkeypatch, subset):
    rng = np.random.default_rng(2)
    x, weight = np.round(rng.normal(size=(400, 3)), 1), rng.integers(1, 4, 400) * 0.37
    y = (x[:, 0] * x[:, 1] > rng.normal(scale=0.2, size=400)).astype(int)
    asked, plain = [], forest.best_cuts

    def all_nodes(v, at, w0, w1, least, n, tried=None):
        asked.append(n if tried is None else int(tried.sum()))
        return plain(v, at, w0, w1, least, n)

    one = forest.grow(x, y, weight, subset, 1, 0, 9)
    monkeypatch.setattr(forest, "best_cuts", all_nodes)
    other = forest.grow(x, y, weight, subset, 1, 0, 9)
    assert all(np.array_equal(one[k], other[k]) for k in one) and len(one["feature"]) > 50
    assert sum(asked[:3]) == subset and max(one["feature"]) == 2


@pytest.mark.parametrize("positive, size", [(4.0, 4), (5000.0, 8)])
def test_gradients_take_as_many_bytes_as_the_weight_asks_for(positive, size):
    block = boosting.Block({"part": 0, "y": np.array([0, 1], np.int8).tobytes(), "margin": np.array([40.0, -40.0]).tobytes(),
                            "digest": np.zeros(2, np.int64).tobytes(), "bins": np.zeros(2, np.int16).tobytes()})
    block.aim(None, positive, (1, 1 << 30))
    assert block.g.dtype.itemsize == block.h.dtype.itemsize == size
    assert block.g.tolist() == [boosting.UNIT, -positive * boosting.UNIT]
