import math

import pytest
from pyspark.sql import functions as F

from scorelake.operators import profile

NAN = float("nan")


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, 1.0, 0), (2, NAN, 1), (2, None, 1), (3, 4.0, None), (1, 1.0, 0), (4, 2.5, 0)]
    return spark.createDataFrame(rows, "id long, `a/b` double, y int")


def test_nan_counts_as_missing_and_equals_null(mixed):
    counts = {r.column_name: r.missing_count for r in profile.missing_by_column(mixed).collect()}
    assert counts == {"id": 0, "a/b": 2, "y": 1}
    assert profile.duplicate_count(mixed).first().asDict() == {"total_rows": 6, "duplicate_rows": 2}
    assert profile.dedupe_rows(mixed).count() == 4
    assert profile.clean_rows(mixed, "y").count() == 3
    assert profile.cleaning_report(mixed, "y").first().asDict() == {
        "rows_before": 6, "removed_duplicates": 2, "removed_missing_target": 1, "rows_after": 3}


def test_summary_matches_hand_values(mixed):
    r = {x.feature: x for x in profile.feature_summary(mixed, ["a/b"]).collect()}["a/b"]
    assert (r.value_count, r.missing_count, r.unique_count, r.min, r.max) == (4, 2, 3, 1.0, 4.0)
    assert (r.p25, r.p50, r.p75) == (1.0, 1.75, 2.875)
    assert r.missing_pct == pytest.approx(100 / 3) and r.std == pytest.approx(math.sqrt(6.1875 / 3))


def test_summary_is_the_same_in_buckets(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 1009 / 8).alias("a"), (F.col("id") % 3).cast("double").alias("b"),
                                  F.when(F.col("id") < 0, 1.0).alias("c"))
    plain, bucketed = (sorted(map(str, profile.feature_summary(df, rows_per_bucket=n).collect())) for n in (10**6, 100))
    assert plain == bucketed
    rough = {r.feature: r for r in profile.feature_summary(df, approximate=True).collect()}
    assert rough["b"].unique_count == 3 and rough["b"].p50 == 1.0


def test_summary_falls_back_to_numeric_columns(mixed):
    assert profile.summary_features(mixed, ["a/b", "absent"]) == ["id", "a/b", "y"]


def test_report(mixed):
    report = profile.validation_report(mixed, ["a/b"], "y", "id")
    rows = {(r.check_name, r.column_name): r.status for r in report.collect()}
    assert rows == {("required_columns", None): "OK", ("numeric_types", None): "OK", ("missing_values", "a/b"): "WARNING",
                    ("missing_values", "y"): "WARNING", ("target_classes", None): "OK", ("duplicate_rows", None): "WARNING"}
    assert profile.is_valid(report)


@pytest.mark.parametrize("where,detail", [("y = 0", "only one class"), ("y is null", "no class"), ("false", "no class")])
def test_report_fails_without_two_classes(mixed, where, detail):
    report = profile.validation_report(mixed.where(where), ["a/b"], "y", "id")
    assert [r.detail for r in report.where("check_name = 'target_classes'").collect()] == [detail]
    assert not profile.is_valid(report)


def test_report_without_target_column(mixed):
    report = profile.validation_report(mixed.drop("y"), ["a/b"], "y", "id")
    assert not profile.is_valid(report) and report.where("column_name = 'y'").first().status == "ERROR"


def test_exactly_ten_percent_is_not_high(spark):
    df = spark.range(20).select("id", F.expr("if(id < 2, null, id)").alias("ten"), F.expr("if(id < 3, null, id)").alias("more"))
    assert [r.column_name for r in profile.high_missing(df).collect()] == ["more"]


def test_text_feature_is_a_warning(spark):
    df = spark.createDataFrame([(1, "x", 0), (2, "y", 1)], "id long, f string, y int")
    report = profile.validation_report(df, ["f"], "y", "id")
    assert profile.is_valid(report) and report.where("check_name = 'numeric_types'").first().status == "WARNING"


def test_balance_with_missing_classes_and_ties(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (1.0,), (NAN,), (None,)], "y double")
    rows = profile.class_balance(df, "y").orderBy("class_value").collect()
    assert [(r.class_value, r.class_count, r.total_samples) for r in rows] == [(0.0, 2, 6), (1.0, 2, 6)]
    assert (rows[0].majority_class, rows[0].minority_class, rows[0].imbalance_ratio) == (0.0, 1.0, 1.0)
    assert profile.class_balance(df.where("y > 5"), "y").count() == 0


def test_weights(spark):
    df = spark.range(10).select(F.expr("cast(id < 2 as int)").alias("y"))
    got = {r.class_value: r.class_weight for r in profile.class_weights(df, "y").collect()}
    assert got == {0: pytest.approx(10 / 16), 1: pytest.approx(2.5)}
