import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.operators import sampling
from scorelake.operators.ordering import id_key, keys_at_ranks


def table(spark, n, positive, partitions=4):
    return spark.range(0, n, 1, partitions).select(F.col("id").alias("row_id"), F.expr(f"cast({positive} as int)").alias("y"))


def test_published_split_sizes():
    quota = sampling.split_quotas({0.0: 4250, 1.0: 1081}, 0.3)
    assert quota == {0.0: 2974, 1.0: 757}


def test_published_sample_sizes():
    quota = sampling.sample_quotas({0.0: 4250, 1.0: 1081}, 5331, 200)
    assert quota == {0.0: 159, 1.0: 40}


def test_sample_keeps_one_row_of_a_rare_class_and_takes_it_from_the_largest():
    assert sampling.sample_quotas({0: 995, 1: 5}, 1000, 10) == {0: 9, 1: 1}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 5), st.integers(1, 500), min_size=1), st.floats(0.05, 0.95))
def test_split_quotas_add_up(counts, share):
    quota = sampling.split_quotas(counts, share)
    n = sum(counts.values())
    assert sum(quota.values()) == n - math.ceil(n * share)
    assert all(0 <= quota[c] <= counts[c] for c in counts)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 4), st.integers(1, 60), min_size=1), st.integers(2, 7))
def test_fold_blocks_follow_the_laid_out_positions(counts, k):
    ends = sampling.fold_ends(counts, k)
    start = 0
    for c in sorted(counts):
        want = Counter((start + i) % k for i in range(counts[c]))
        cuts = [0, *ends[c], counts[c]]
        assert [b - a for a, b in zip(cuts, cuts[1:])] == [want[f] for f in range(k)]
        start += counts[c]


def test_fixture_fold_sizes():
    ends = sampling.fold_ends({0: 8019, 1: 1981}, 5)
    assert [b - a for a, b in zip([0, *ends[0]], [*ends[0], 8019])] == [1604, 1604, 1604, 1604, 1603]
    assert sorted(b - a for a, b in zip([0, *ends[1]], [*ends[1], 1981])) == [396, 396, 396, 396, 397]


def test_split_is_complete_and_independent_of_partitions(spark):
    def rows(parts, ranked):
        df = sampling.stratified_split(table(spark, 3000, "id % 10 = 0", parts), "row_id", "y", ranked_rows=ranked)
        return {(r.row_id, r.y, r.split) for r in df.collect()}

    one = rows(1, 200_000)
    assert len(one) == 3000
    assert Counter((y, s) for _, y, s in one) == {(0, "train"): 1890, (0, "test"): 810, (1, "train"): 210, (1, "test"): 90}
    assert rows(8, 1) == one and rows(64, 5) == one


def test_dominant_class(spark):
    df = sampling.stratified_split(table(spark, 2000, "id < 7"), "row_id", "y", ranked_rows=3)
    assert {(r.y, r.split): r["count"] for r in df.groupBy("y", "split").count().collect()} == {
        (0, "train"): 1395, (0, "test"): 598, (1, "train"): 5, (1, "test"): 2}


def test_groups_looked_at_to_different_depth(spark):
    """One class is refined to longer prefixes, the other is not, and both share leading digits."""
    keys = ["aaa" + f"{i:013x}" for i in range(40)]
    rows = [("big", k) for k in keys] + [("small", k) for k in keys[::10]]
    df = spark.createDataFrame(rows, "g string, k string")
    counts, cuts = keys_at_ranks(df, lambda c: {"big": [1, 17, 39], "small": [1, 3, 4]}, ranked_rows=10)
    assert counts == {"big": 40, "small": 4}
    assert cuts == {"big": [keys[0], keys[16], keys[38]], "small": [keys[0], keys[20], "g"]}


def test_single_row_class_falls_back_to_random(spark):
    df = sampling.stratified_split(table(spark, 10, "id = 3"), "row_id", "y")
    assert {r.split: r["count"] for r in df.groupBy("split").count().collect()} == {"train": 7, "test": 3}


def test_split_needs_a_target_everywhere(spark):
    df = table(spark, 10, "id % 2 = 0").withColumn("y", F.expr("if(row_id = 4, null, y)"))
    with pytest.raises(ValueError):
        sampling.stratified_split(df, "row_id", "y")


def repeated(spark, n=600):
    """A third of all rows are one row, a third share one id, the others share ids by tens."""
    e = F.col("id")
    return spark.range(0, n, 1, 5).select(
        F.when(e % 3 == 0, -1).when(e % 3 == 1, -2).otherwise(F.floor(e / 30)).alias("row_id"),
        F.when(e % 3 == 0, 0.5).otherwise(e.cast("double")).alias("v.x"),
        F.when(e % 3 == 0, 0).otherwise((e % 4 == 0).cast("int")).alias("y"), F.lit("g").alias("g"))


@pytest.mark.parametrize("ranked", [1, 7, 200_000])
def test_exact_sizes_with_repeated_ids_and_rows(spark, ranked):
    df = repeated(spark)
    every = Counter(map(tuple, df.collect()))
    classes = Counter(r[2] for r in every.elements())
    for n in (1, 150, 299, 599):
        assert sampling.random_sample(df, "row_id", n, ranked_rows=ranked).count() == n
    split = sampling.stratified_split(df, "row_id", "y", 0.3, ranked_rows=ranked)
    assert Counter(tuple(r)[:4] for r in split.collect()) == every and split.columns == [*df.columns, "split"]
    want = sampling.split_quotas(classes, 0.3)
    assert {(r.y, r.split): r["count"] for r in split.groupBy("y", "split").count().collect()} == {
        (y, s): q if s == "train" else classes[y] - q for y, q in want.items() for s in ("train", "test")}
    for folds in (sampling.stratified_folds(df, "row_id", "y", 7, ranked_rows=ranked), sampling.ordered_folds(df, "row_id", "y", 7, ranked_rows=ranked)):
        ends = sampling.fold_ends(classes, 7)
        sizes = {(y, f): b - a for y in classes for f, (a, b) in enumerate(zip([0, *ends[y]], [*ends[y], classes[y]]))}
        assert {(r.y, r.fold): r["count"] for r in folds.groupBy("y", "fold").count().collect()} == {k: n for k, n in sizes.items() if n}
        assert Counter(tuple(r)[:4] for r in folds.collect()) == every


def test_rows_with_one_id_follow_their_content(spark):
    """The same rows are chosen whatever the partitions, and a larger sample holds the smaller one."""
    df = repeated(spark)

    def chosen(n, parts, ranked):
        return Counter(map(tuple, sampling.random_sample(df.repartition(parts), "row_id", n, ranked_rows=ranked).collect()))

    for n in (40, 250, 420):
        assert chosen(n, 1, 200_000) == chosen(n, 6, 3)
        assert chosen(n, 2, 50) <= chosen(n + 33, 3, 10)


def test_one_row_again_and_again(spark):
    df = spark.range(0, 1000, 1, 4).select(F.lit(1).alias("row_id"), F.lit(None).cast("string").alias("x"))
    for ranked in (2, 200_000):
        assert sampling.random_sample(df, "row_id", 3, ranked_rows=ranked).count() == 3
        assert {r["count"] for r in sampling.random_split(df, "row_id", 0.25, ranked_rows=ranked).groupBy("split").count().collect()} == {250, 750}


def test_repeated_ids_away_from_the_cut_do_no_harm(spark):
    df = spark.range(40).select(F.when(F.col("id") < 10, 7).otherwise(F.col("id")).alias("row_id"))
    rows = sorted((r.k, r.row_id) for r in df.select("row_id", sampling.hash_key(F.col("row_id"), 42).alias("k")).collect())
    last = max(i for i, r in enumerate(rows) if r[1] == 7) + 1
    for ranked in (2, 200_000):
        got = sampling.random_sample(df, "row_id", last, ranked_rows=ranked)
        assert sorted(r.row_id for r in got.collect()) == sorted(r[1] for r in rows[:last])


def test_any_number_of_classes(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 600).alias("y"))
    folds = sampling.stratified_folds(df, "row_id", "y", 5, ranked_rows=2).groupBy("y", "fold").count().collect()
    assert len(folds) == 3000 and {r["count"] for r in folds} == {1}
    split = sampling.stratified_split(df, "row_id", "y", 0.2).groupBy("y", "split").count().collect()
    assert {(r.split, r["count"]) for r in split} == {("train", 4), ("test", 1)} and len(split) == 1200
    assert sampling.stratified_sample(df, "row_id", "y", 1200).groupBy("y").count().where("count = 2").count() == 600


def test_assigning_rows_moves_no_data(spark):
    df = table(spark, 200, "id % 4 = 0")
    plan = sampling.stratified_split(df, "row_id", "y")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_sample_ignores_missing_targets_and_caps(spark):
    df = table(spark, 100, "id % 4 = 0").withColumn("y", F.expr("if(row_id % 10 = 0, null, y)"))
    got = sampling.stratified_sample(df, "row_id", "y", 40).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {0: 28, 1: 8}
    assert sampling.random_sample(df, "row_id", 1000).count() == 100
    assert sampling.stratified_sample(df.drop("y"), "row_id", "y", 7).count() == 7


def test_empty_table(spark):
    empty = table(spark, 10, "id > 5").where("row_id < 0")
    assert sampling.random_split(empty, "row_id").count() == 0
    assert sampling.random_sample(empty, "row_id", 5).count() == 0
    assert sampling.stratified_split(empty, "row_id", "y").count() == 0


def test_id_key_sorts_like_the_number(spark):
    ids = [-(2**63), -5, -1, 0, 1, 15, 16, 255, 2**40, 2**63 - 1]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", id_key(F.col("i")).alias("k")).collect()
    assert [r.i for r in sorted(rows, key=lambda r: r.k)] == ids


def test_ordered_folds_are_consecutive(spark):
    df = sampling.ordered_folds(table(spark, 100, "id % 2 = 0"), "row_id", "y", 4, ranked_rows=2)
    for y in (0, 1):
        folds = [r.fold for r in df.where(F.col("y") == y).orderBy("row_id").collect()]
        assert folds == sorted(folds) and set(Counter(folds).values()) <= {12, 13}


def test_split_is_one_narrow_projection(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = sampling.random_split(events, "event_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
