import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.operators import compare, curves, metrics, significance

SCHEMA = "model string, row_id long, y int, pred int, score double"


def table(spark, cells, model="m"):
    """cells: (tn, fp, fn, tp)"""
    pairs = [(0, 0)] * cells[0] + [(0, 1)] * cells[1] + [(1, 0)] * cells[2] + [(1, 1)] * cells[3]
    return spark.createDataFrame([(model, i, y, p, float(p)) for i, (y, p) in enumerate(pairs)], SCHEMA)


def test_published_ten_rows(spark):
    r = metrics.model_metrics(table(spark, (6, 2, 1, 1))).first()
    got = [round(r[c], 4) for c in ("accuracy", "precision_positive", "recall_positive", "f1_positive", "mcc")]
    assert got == [0.7, 0.3333, 0.5, 0.4, 0.2182]
    assert r["recall_weighted"] == pytest.approx(r["accuracy"])


def test_published_accuracies(spark):
    df = spark.createDataFrame([("a", 0.7994), ("b", 0.6619), ("c", 0.6394), ("d", 0.8094)], "model string, accuracy double")
    r = compare.accuracy_summary(df).first()
    assert (round(r.mean_accuracy, 4), round(r.std_accuracy, 4), round(r.accuracy_range, 4)) == (0.7275, 0.0893, 0.17)


def test_absent_cells_and_single_class(spark):
    r = metrics.model_metrics(table(spark, (5, 0, 0, 0))).first()
    assert r["accuracy"] == 1.0 and r["precision_positive"] == 0.0 and r["mcc"] == 0.0
    assert r["auc_roc"] is None and r["auc_pr"] is None
    shares = {(x.actual, x.predicted): x.share for x in metrics.confusion_normalized(table(spark, (5, 0, 0, 0))).collect()}
    assert shares[(0, 0)] == 1.0 and shares[(1, 0)] is None


def test_model_without_predictions_keeps_a_row(spark):
    df = spark.createDataFrame([("none", 1, 0, None, None), ("none", 2, 1, None, None)], SCHEMA)
    r = metrics.model_metrics(df).first()
    assert (r["attempted"], r["valid"], r["success_rate"], r["accuracy"]) == (2, 0, 0.0, None)
    assert metrics.classification_report(df).count() == 0
    assert compare.metric_sanity(metrics.model_metrics(df)).first()["sane"] is False


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert metrics.model_metrics(empty).count() == 0 and curves.roc_curve(empty).count() == 0


def brute(points):
    pos = [s for y, s in points if y]
    neg = [s for y, s in points if not y]
    if not pos or not neg:
        return None, None
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    area, last = 0.0, (0.0, 1.0)
    for t in sorted({s for _, s in points}, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        now = (tp / len(pos), tp / (tp + fp))
        area += (now[0] - last[0]) * (now[1] + last[1]) / 2
        last = now
    return auc, area


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(-4, 12)), min_size=1, max_size=40), st.sampled_from([2, 7, 10**6]))
def test_areas_against_brute_force(spark, points, rows_per_bucket):
    rows = [("m", i, int(y), 0, s / 8) for i, (y, s) in enumerate(points)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = curves.areas(df, rows_per_bucket=rows_per_bucket).first()
    auc, pr = brute([(y, s / 8) for y, s in points])
    assert got["auc_roc"] == (None if auc is None else pytest.approx(auc))
    assert got["auc_pr"] == (None if pr is None else pytest.approx(pr))


def test_reversed_scores_and_missing_scores(spark):
    rows = [("m", i, i % 3 == 0, 0, ((i * 37) % 11) / 11) for i in range(200)]
    df = spark.createDataFrame([(m, i, int(y), p, s) for m, i, y, p, s in rows], SCHEMA)
    one = curves.roc_auc(df).first()["auc_roc"]
    other = curves.roc_auc(df.withColumn("score", 1 - F.col("score"))).first()["auc_roc"]
    assert one + other == pytest.approx(1.0)
    holes = df.unionByName(spark.createDataFrame([("m", 900, 1, 0, None), ("m", 901, 0, 0, math.nan)], SCHEMA))
    assert curves.roc_auc(holes).first()["auc_roc"] == pytest.approx(one)


def test_bucketed_curve_equals_plain(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("model"), F.col("id").alias("row_id"),
        (F.col("id") % 5 == 0).cast("int").alias("y"), F.lit(0).alias("pred"),
        F.when(F.col("id") % 2 == 0, 0.5).otherwise((F.col("id") * 7919 % 613) / 613).alias("score"))
    for curve in (curves.roc_curve, curves.pr_curve):
        assert sorted(map(str, curve(df).collect())) == sorted(map(str, curve(df, rows_per_bucket=50).collect()))


def test_rounded_scores_bound_the_curve(spark):
    df = spark.range(500).select(F.lit("m").alias("model"), F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("y"),
                                 F.lit(0).alias("pred"), (F.col("id") / 500).alias("score"))
    assert curves.roc_curve(df, score_digits=1).count() == 12


def test_rankings_break_ties_by_name(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.9), ("d", None)], "model string, accuracy double")
    got = [(r.position, r.model) for r in compare.metric_rankings(df, ["accuracy"]).orderBy("position").collect()]
    assert got == [(1, "c"), (2, "a"), (3, "b"), (4, "d")]
    assert compare.best_model(df.where("model <> 'c'")).first()["model"] == "a"


def test_summary_text(spark):
    df = spark.createDataFrame([("a", 0.7994, 0.74821), ("b", None, None)], "model string, accuracy double, auc_roc double")
    got = {r.model: (r.accuracy, r.auc) for r in compare.summary_table(df).collect()}
    assert got == {"a": ("79.940%", "0.748"), "b": ("0.000%", "N/A")}


def test_paired_t_test(spark):
    rows = [("a", f, v) for f, v in enumerate([0.9, 0.8, 0.85, 0.95])] + [("b", f, v) for f, v in enumerate([0.8, 0.78, 0.8, 0.85])]
    r = significance.t_test(spark.createDataFrame(rows + [("c", 0, 0.1)], "model string, fold int, value double"))
    d = [0.1, 0.02, 0.05, 0.1]
    mean = sum(d) / 4
    std = math.sqrt(sum((x - mean) ** 2 for x in d) / 3)
    assert r["best_model"] == "a" and r["second_model"] == "b" and r["t_statistic"] == pytest.approx(mean / (std / 2))
    assert r["p_value"] == pytest.approx(0.0427, abs=2e-3) and r["significant"]


def test_t_test_is_undefined_for_one_pair_or_equal_differences(spark):
    schema = "model string, fold int, value double"
    one = significance.t_test(spark.createDataFrame([("a", 0, 0.9), ("b", 0, 0.8)], schema))
    same = significance.t_test(spark.createDataFrame([("a", 0, 0.9), ("b", 0, 0.8), ("a", 1, 0.9), ("b", 1, 0.8)], schema))
    assert one["t_statistic"] is None and same["t_statistic"] is None
    assert not one["significant"] and not same["significant"]


def test_t_tail_against_known_quantiles():
    for df, t in ((1, 12.706), (4, 2.776), (9, 2.262), (30, 2.042)):
        assert significance._t_tail(t, df) == pytest.approx(0.05, abs=1e-4)


def test_mcnemar(spark):
    a, b = table(spark, (8, 0, 0, 8), "a"), table(spark, (5, 3, 4, 4), "b")
    r = significance.mcnemar_test(a.unionByName(b))
    assert (r["both_right"], r["only_best_right"], r["only_second_right"], r["both_wrong"]) == (9, 7, 0, 0)
    assert r["statistic"] == pytest.approx(36 / 7) and r["significant"]


def test_top_features_by_either_weight(spark):
    df = spark.createDataFrame([("t", f"f{i}", float(i), None) for i in range(15)] + [("l", "g", None, 2.0), ("l", "h", None, 3.0)],
                               "model string, feature string, importance double, abs_coefficient double")
    got = compare.top_features(df, 10).collect()
    assert sum(r.model == "t" for r in got) == 10
    assert [r.feature for r in got if r.model == "l" and r.position == 1] == ["h"]
