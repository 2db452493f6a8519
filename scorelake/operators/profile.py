"""Data-quality checks, cleaning and column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import config
from scorelake.functions.missing import (
    col, is_missing, is_numeric, nan_to_null, value_or_null,
)
from scorelake.operators.cumulate import ROWS_PER_BUCKET, ordered_totals

OK, WARNING, ERROR = "OK", "WARNING", "ERROR"


# --- projections -----------------------------------------------------------------------------

def present_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Configured features that exist, in configured order."""
    return [f for f in features if f in df.columns]


def project_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns (id, target) and the features that exist."""
    return df.select([col(c) for c in [*keep, *present_features(df, features)]])


def summary_features(df: DataFrame, features: Sequence[str] | None = None) -> list[str]:
    """All configured features if every one exists, otherwise every numeric column."""
    if features and all(f in df.columns for f in features):
        return list(features)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_projection(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    return df.select([col(c) for c in summary_features(df, features)])


# --- cleaning --------------------------------------------------------------------------------

def dedupe_rows(df: DataFrame) -> DataFrame:
    """One copy of every row; null and NaN count as equal."""
    return nan_to_null(df).dropDuplicates()


def clean_rows(df: DataFrame, target: str) -> DataFrame:
    """Drop rows without a target and duplicate rows.

    The filter comes first: it commutes with duplicate removal, reaches the scan, and shrinks the shuffle.
    """
    return nan_to_null(df).where(col(target).isNotNull()).dropDuplicates()


def _distinct_rows(df: DataFrame) -> DataFrame:
    return nan_to_null(df).groupBy([col(c) for c in df.columns]).agg(F.count("*").alias("_copies"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: total rows and rows beyond the first copy."""
    return _distinct_rows(df).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        (F.coalesce(F.sum("_copies"), F.lit(0)) - F.count("*")).alias("duplicate_rows"),
    )


def cleaning_report(df: DataFrame, target: str) -> DataFrame:
    """One row: rows before, duplicates removed, distinct rows without target removed, rows after."""
    unlabelled = F.count(F.when(col(target).isNull(), 1))
    return _distinct_rows(df).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows_before"),
        (F.coalesce(F.sum("_copies"), F.lit(0)) - F.count("*")).alias("removed_duplicates"),
        unlabelled.alias("removed_missing_target"),
        (F.count("*") - unlabelled).alias("rows_after"),
    )


# --- missing values --------------------------------------------------------------------------

def _per_column(totals: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Turn one row with ``m0, m1, ...`` into one row per column."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"))
             for i, c in enumerate(columns)]
    return totals.select(*keep, F.explode(F.array(*pairs)).alias("p")).select(*keep, "p.*")


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column_name, missing_count, total_rows, missing_share), one pass over the table."""
    totals = df.agg(
        F.count("*").alias("total_rows"),
        *[F.count(F.when(is_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    return _per_column(totals, df.columns, ["total_rows"]).select(
        "column_name", "missing_count", "total_rows",
        F.when(F.col("total_rows") > 0, F.col("missing_count") / F.col("total_rows")).alias("missing_share"),
    )


def high_missing(df: DataFrame, limit: float = config.HIGH_MISSING_SHARE) -> DataFrame:
    """Columns whose missing count exceeds ``limit`` of the rows (strictly)."""
    return missing_by_column(df).where(F.col("missing_count") > F.col("total_rows") * limit)


def empty_columns(df: DataFrame) -> DataFrame:
    """Columns without a single value."""
    return missing_by_column(df).where("missing_count = total_rows").select("column_name", "total_rows")


# --- checks ----------------------------------------------------------------------------------

def missing_required(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def non_numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns and not is_numeric(df, c)]


def _finding(check: str, column: Column, status: Column, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("check_name"), column.cast("string").alias("column_name"),
                    status.cast("string").alias("status"), detail.cast("string").alias("detail"))


def _schema_findings(df: DataFrame, features: Sequence[str], target: str, id_col: str) -> list[Column]:
    absent = missing_required(df, [*features, target, id_col])
    out = [_finding("required_columns", F.lit(c), F.lit(ERROR), F.lit("missing column")) for c in absent]
    if not absent:
        out.append(_finding("required_columns", F.lit(None), F.lit(OK), F.lit(None)))
    odd = non_numeric(df, [*features, target])
    out += [_finding("numeric_types", F.lit(c), F.lit(WARNING), F.lit(df.schema[c].dataType.simpleString()))
            for c in odd]
    if not odd:
        out.append(_finding("numeric_types", F.lit(None), F.lit(OK), F.lit(None)))
    return out


def _target_finding(lo: Column, hi: Column) -> Column:
    """The smallest and largest class tell zero, one and several classes apart, without a distinct count."""
    status = F.when(lo.isNull() | (lo == hi), F.lit(ERROR)).otherwise(F.lit(OK))
    detail = F.when(lo.isNull(), F.lit("no class")).when(lo == hi, F.lit("only one class"))
    return _finding("target_classes", F.lit(None), status, detail)


def check_required(df: DataFrame, features: Sequence[str], target: str, id_col: str) -> DataFrame:
    """One row per required column: present or not, with the number of rows looked at."""
    required = [*features, target, id_col]
    rows = df.agg(F.count("*").alias("total_rows"))
    found = [F.struct(F.lit(c).alias("column_name"),
                      F.lit(OK if c in df.columns else ERROR).alias("status")) for c in required]
    return rows.select(F.explode(F.array(*found)).alias("f"), "total_rows").select("f.*", "total_rows")


def check_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per listed column that exists: numeric or not, with its number of values."""
    present = [c for c in columns if c in df.columns]
    totals = df.agg(*[F.count(value_or_null(df, c)).alias(f"m{i}") for i, c in enumerate(present)])
    kinds = F.create_map(*[x for c in present for x in (
        F.lit(c), F.lit(OK if is_numeric(df, c) else WARNING))])
    return _per_column(totals, present).select(
        "column_name", kinds[F.col("column_name")].alias("status"), F.col("missing_count").alias("value_count"))


def check_target(df: DataFrame, target: str) -> DataFrame:
    """One row: error when the target has fewer than two classes."""
    y = value_or_null(df, target)
    return df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).select(
        _target_finding(F.col("lo"), F.col("hi")).alias("f")).select("f.check_name", "f.status", "f.detail")


def validation_report(df: DataFrame, features: Sequence[str], target: str, id_col: str,
                      limit: float = config.HIGH_MISSING_SHARE) -> DataFrame:
    """All checks as rows (check_name, column_name, status, detail, passed).

    ``passed`` is the overall verdict: no error (warnings do not fail). Missing counts, class range and
    duplicates come from one grouping of the whole rows, so the table is read and shuffled once.
    """
    distinct = _distinct_rows(df)
    aggs = [F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"), F.count("*").alias("distinct_rows")]
    aggs += [F.coalesce(F.sum(F.when(col(c).isNull(), F.col("_copies"))), F.lit(0)).alias(f"m{i}")
             for i, c in enumerate(df.columns)]
    if target in df.columns:
        aggs += [F.min(col(target)).alias("lo"), F.max(col(target)).alias("hi")]
    totals = distinct.agg(*aggs)

    total = F.col("total_rows")
    findings = [F.array(*_schema_findings(df, features, target, id_col))]
    missing = [_finding("missing_values", F.lit(c), F.lit(WARNING), F.col(f"m{i}")) for i, c in enumerate(df.columns)]
    flags = [F.col(f"m{i}") > total * limit for i in range(len(df.columns))]
    kept = F.filter(F.array(*[F.when(flag, m) for flag, m in zip(flags, missing)]), lambda x: x.isNotNull())
    none = F.array(_finding("missing_values", F.lit(None), F.lit(OK), F.lit(None)))
    findings.append(F.when(F.size(kept) > 0, kept).otherwise(none))
    if target in df.columns:
        findings.append(F.array(_target_finding(F.col("lo"), F.col("hi"))))
    extra = total - F.col("distinct_rows")
    findings.append(F.array(_finding("duplicate_rows", F.lit(None),
                                     F.when(extra > 0, F.lit(WARNING)).otherwise(F.lit(OK)), extra)))
    rows = F.concat(*findings)
    failed = F.exists(rows, lambda f: f["status"] == ERROR)
    return totals.select(F.explode(rows).alias("f"), (~failed).alias("passed")).select("f.*", "passed")


def is_valid(report: DataFrame) -> bool:
    """Verdict of a :func:`validation_report`."""
    return bool(report.agg(F.bool_and("passed").alias("ok")).first()["ok"])


def validate_columns(df: DataFrame, expected: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Short form of the checks: expected columns, empty columns, numeric types.

    Only a missing column is an error; empty and non-numeric columns are warnings.
    """
    absent = missing_required(df, expected)
    fixed = [_finding("required_columns", F.lit(c), F.lit(ERROR), F.lit("missing column")) for c in absent]
    fixed += [_finding("numeric_types", F.lit(c), F.lit(WARNING), F.lit(df.schema[c].dataType.simpleString()))
              for c in non_numeric(df, numeric)]
    totals = df.agg(F.count("*").alias("total_rows"),
                    *[F.count(value_or_null(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    empty = F.array(*[
        F.when(F.col(f"n{i}") == 0, _finding("empty_columns", F.lit(c), F.lit(WARNING), F.col("total_rows")))
        for i, c in enumerate(df.columns)])
    found = F.filter(empty, lambda x: x.isNotNull())
    rows = F.concat(F.array(*fixed), found) if fixed else found
    return totals.select(F.explode(rows).alias("f")).select("f.*", F.lit(not absent).alias("passed"))


# --- classes ---------------------------------------------------------------------------------

def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class_value, class_count), most frequent first; missing targets are left out."""
    y = value_or_null(df, target)
    return (df.select(y.alias("class_value")).where("class_value is not null")
            .groupBy("class_value").agg(F.count("*").alias("class_count"))
            .orderBy(F.desc("class_count"), "class_value"))


def class_balance(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Per class: count and share of all rows (rows without a class included in the total).

    Every row also carries the total, the majority and minority class and the ratio of their counts.
    Classes with equal counts are taken in ascending order of the class. Only the counts, a few rows,
    pass through the window.
    """
    by = list(by)
    counts = (df.select(*[col(b) for b in by], value_or_null(df, target).alias("class_value"))
              .groupBy(*by, "class_value").agg(F.count("*").alias("class_count")))
    whole = Window.partitionBy(*by)
    ranked = F.when(F.col("class_value").isNotNull(), F.struct(-F.col("class_count"), "class_value"))
    known = F.when(F.col("class_value").isNotNull(), F.col("class_count"))
    return counts.select(
        *by, "class_value", "class_count",
        F.sum("class_count").over(whole).alias("total_samples"),
        F.min(ranked).over(whole)["class_value"].alias("majority_class"),
        F.max(ranked).over(whole)["class_value"].alias("minority_class"),
        (F.max(known).over(whole) / F.min(known).over(whole)).alias("imbalance_ratio"),
    ).where("class_value is not null").select(
        *by, "class_value", "class_count",
        (F.col("class_count") / F.col("total_samples")).alias("class_proportion"),
        "total_samples", "majority_class", "minority_class", "imbalance_ratio",
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = target_distribution(df, target)
    whole = Window.partitionBy()
    return counts.select(
        "class_value", "class_count",
        (F.sum("class_count").over(whole) / (F.count("*").over(whole) * F.col("class_count"))).alias("class_weight"))


# --- column statistics -----------------------------------------------------------------------

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _native(df: DataFrame, feature: str) -> Column:
    """Text that tells values apart which share a double: large longs and decimals. Empty for all others."""
    c, kind = col(feature), df.schema[feature].dataType
    if isinstance(kind, T.LongType):
        return F.when(F.abs(c.cast("double")) >= 2**53, c.cast("string")).otherwise(F.lit(""))
    return c.cast("string") if isinstance(kind, T.DecimalType) else F.lit("")


def _long_values(df: DataFrame, features: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(i).alias("feature_no"), value_or_null(df, f).cast("double").alias("value"), _native(df, f).alias("native"))
             for i, f in enumerate(features)]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("value is not null")


def _interpolated(share: float) -> Column:
    """Quantile by linear interpolation between the two neighbouring ranks (counted from 0)."""
    position = F.lit(share) * (F.col("n_total") - 1)
    below, above = F.floor(position), F.ceil(position)

    def at(rank: Column) -> Column:
        inside = (F.col("n_upto") - F.col("n") <= rank) & (rank < F.col("n_upto"))
        return F.max(F.when(inside, F.col("value")))

    part = F.max(position - below)
    return at(below) + (at(above) - at(below)) * part


def feature_summary(df: DataFrame, features: Sequence[str] | None = None, approximate: bool = False,
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per feature: count, mean, sample std, min, quartiles, max, missing count and percentage, distinct values.

    Moments and counts need one pass without a shuffle of values. Exact quartiles and distinct counts
    come from the merged value counts of all features, with running totals per value bucket, so no task
    holds a whole column. Statistics are doubles; distinct values are counted in the column's own type. ``approximate`` replaces those two by sketches and saves that shuffle.
    """
    features = summary_features(df, features)
    simple, extra = [], []
    for i, f in enumerate(features):
        v = value_or_null(df, f).cast("double")
        stats = {"value_count": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v),
                 "max": F.max(v), "total_rows": F.count("*")}
        if approximate:
            stats |= {"quartiles": F.percentile_approx(v, list(QUARTILES.values())),
                      "unique_count": F.approx_count_distinct(v)}
        simple.append(F.struct(*[F.col(f"{s}_{i}").alias(s) for s in stats], F.lit(f).alias("feature"), F.lit(i).alias("feature_no")))
        extra += [c.alias(f"{s}_{i}") for s, c in stats.items()]
    moments = df.agg(*extra).select(F.explode(F.array(*simple)).alias("s")).select("s.*")
    missing = F.col("total_rows") - F.col("value_count")
    head = ["feature", "value_count", "mean", "std", "min"]
    tail = ["max", missing.alias("missing_count"),
            F.when(F.col("total_rows") > 0, missing / F.col("total_rows") * 100).alias("missing_pct")]
    if approximate:
        quartiles = [F.col("quartiles")[i].alias(q) for i, q in enumerate(QUARTILES)]
        return moments.select(*head, *quartiles, *tail, "unique_count")
    weights = {"n": F.count("*")}
    unique = F.count("*")
    if any(isinstance(df.schema[f].dataType, (T.LongType, T.DecimalType)) for f in features):
        weights["distinct"] = F.count_distinct("native")    # native values per double; adds up over doubles
        unique = F.sum("distinct")
    ordered = ordered_totals(_long_values(df, features), ["feature_no"], "value", weights,
                             row_count=df.count() * len(features), rows_per_bucket=rows_per_bucket)
    ranks = ordered.groupBy("feature_no").agg(
        *[_interpolated(share).alias(q) for q, share in QUARTILES.items()], unique.alias("unique_count"))
    return moments.join(ranks, "feature_no", "left").select(
        *head, *QUARTILES, *tail, F.coalesce("unique_count", F.lit(0)).alias("unique_count"))


def table_profile(df: DataFrame, target: str | None = None) -> DataFrame:
    """Shape, types, missing counts, duplicates, class counts and class shares as rows.

    Columns: ``section``, ``item``, ``text``, ``number``.
    """
    distinct = _distinct_rows(df)
    totals = distinct.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"), F.count("*").alias("distinct_rows"),
        *[F.coalesce(F.sum(F.when(col(c).isNull(), F.col("_copies"))), F.lit(0)).alias(f"m{i}")
          for i, c in enumerate(df.columns)])

    def fact(section: str, item: str | Column, text: Column, number: Column) -> Column:
        item = F.lit(item) if isinstance(item, str) else item
        return F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"),
                        text.cast("string").alias("text"), number.cast("double").alias("number"))

    null = F.lit(None)
    facts = [fact("shape", "rows", null, F.col("total_rows")),
             fact("shape", "columns", null, F.lit(len(df.columns))),
             fact("duplicates", "rows", null, F.col("total_rows") - F.col("distinct_rows"))]
    facts += [fact("type", f.name, F.lit(f.dataType.simpleString()), null) for f in df.schema]
    facts += [fact("missing", c, null, F.col(f"m{i}")) for i, c in enumerate(df.columns)]
    out = totals.select(F.explode(F.array(*facts)).alias("f")).select("f.*")
    if target is None or target not in df.columns:
        return out
    classes = class_balance(df, target).select(F.explode(F.array(
        fact("class_count", F.col("class_value"), null, F.col("class_count")),
        fact("class_proportion", F.col("class_value"), null, F.col("class_proportion")),
    )).alias("f")).select("f.*")
    return out.unionByName(classes)
