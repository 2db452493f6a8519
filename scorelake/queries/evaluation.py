"""Metrics, curves and comparisons over the predictions table."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.operators import compare, curves, metrics, significance
from scorelake.operators.sampling import ordered_folds
from scorelake.plans import evaluate
from scorelake.queries import inputs
from scorelake.queries.inputs import IMPORTANCE_SQL, PREDICTIONS_SQL
from scorelake.queries.registry import query
from scorelake.session import scratch_path
from scorelake.sources import tables

CELLS_SQL = """
cells as (
  select model, count(*) as attempted, count(pred) as valid,
    count(*) filter (where y = 0 and pred = 0) as tn, count(*) filter (where y = 0 and pred = 1) as fp,
    count(*) filter (where y = 1 and pred = 0) as fn, count(*) filter (where y = 1 and pred = 1) as tp
  from predictions group by model)
"""

# Class by class from the definitions; an undefined ratio is 0.
CLASSES_SQL = """
classes as (
  select model, c as class_value, valid, hit, actual as support,
    case when predicted = 0 then 0.0::double else hit / predicted::double end as precision,
    case when actual = 0 then 0.0::double else hit / actual::double end as recall,
    case when actual + predicted = 0 then 0.0::double else 2.0::double * hit / (actual + predicted) end as f1
  from (select model, valid, 0 as c, tn as hit, tn + fp as actual, tn + fn as predicted from cells
        union all select model, valid, 1, tp, tp + fn, tp + fp from cells) k)
"""

HARD_SQL = """
hard as (
  select model, sum(hit) / max(valid)::double as accuracy,
    sum(precision * support) / max(valid) as precision_weighted, sum(recall * support) / max(valid) as recall_weighted,
    sum(f1 * support) / max(valid) as f1_weighted,
    max(case when class_value = 1 then precision end) as precision_positive,
    max(case when class_value = 1 then recall end) as recall_positive,
    max(case when class_value = 1 then f1 end) as f1_positive,
    max(case when class_value = 0 then recall end) as specificity,
    max(case when class_value = 1 then recall end) as sensitivity
  from classes group by model),
mcc as (select model, coalesce(corr(cast(y as double), cast(pred as double)), 0) as mcc from predictions
        where pred is not null group by model)
"""

# Area under ROC from average ranks, precision-recall area from ordered points.
AREA_SQL = """
ranked as (
  select model, y, rank() over (partition by model order by score)
    + (count(*) over (partition by model, score) - 1) / 2.0::double as r from predictions),
roc as (select model, (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0::double)
               / (sum(y) * (count(*) - sum(y)))::double as auc_roc from ranked group by model),
distinct_scores as (select model, score, sum(y)::double as pos, (count(*) - sum(y))::double as neg from predictions group by 1, 2),
points as (
  select model, score, sum(pos) over w as tp, sum(neg) over w as fp,
    sum(pos) over (partition by model) as np, sum(neg) over (partition by model) as nn
  from distinct_scores window w as (partition by model order by score desc rows unbounded preceding)),
steps as (
  select model, tp / np as recall, tp / (tp + fp) as precision,
    coalesce(lag(tp / np) over w, 0) as recall0, coalesce(lag(tp / (tp + fp)) over w, 1) as precision0
  from points window w as (partition by model order by score desc)),
pr as (select model, sum((recall - recall0) * (precision + precision0) / 2) as auc_pr from steps group by model)
"""

BASE = [PREDICTIONS_SQL, CELLS_SQL, CLASSES_SQL, HARD_SQL]
FULL = [*BASE, AREA_SQL, """
record as (select * from cells join hard using (model) join mcc using (model) join roc using (model) join pr using (model))
"""]


def _r(*names):
    return ", ".join(f"round({n}, 6) + 0.0::double as {n}" for n in names)


RECORD = _r(*metrics.RECORD_METRICS, "auc_roc", "auc_pr")


@query("confusion_matrix", PREDICTIONS_SQL, CELLS_SQL, """
select model, 0 as actual, 0 as predicted, tn as n from cells union all select model, 0, 1, fp from cells
union all select model, 1, 0, fn from cells union all select model, 1, 1, tp from cells""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(inputs.predictions(spark, sf_dir))


@query("confusion_normalized", PREDICTIONS_SQL, """
select model, y as actual, pred as predicted, round(count(*) / sum(count(*)) over (partition by model, y), 6) as share
from predictions where pred is not null group by model, y, pred
union all select 'm1', 0, 1, 0.0::double union all select 'm1', 1, 0, 0.0::double""")
def confusion_normalized(spark, sf_dir):
    """The perfect model m1 has no wrong cells; they appear as zeros."""
    return metrics.confusion_normalized(inputs.predictions(spark, sf_dir))


@query("confusion_cells", PREDICTIONS_SQL, CELLS_SQL, "select model, tn, fp, fn, tp from cells")
def confusion_cells(spark, sf_dir):
    return metrics.confusion_cells(inputs.predictions(spark, sf_dir))


@query("hard_metrics", *BASE, f"select model, {_r(*metrics.HARD_METRICS)} from hard")
def hard_metrics(spark, sf_dir):
    return metrics.hard_metrics(inputs.predictions(spark, sf_dir))


@query("positive_metrics", *BASE, f"select model, {_r('accuracy', *metrics.POSITIVE_METRICS)} from hard")
def positive_metrics(spark, sf_dir):
    return metrics.positive_metrics(inputs.predictions(spark, sf_dir))


@query("per_class_metrics", *BASE, f"select model, class_value, {_r('precision', 'recall', 'f1')}, support from classes")
def per_class_metrics(spark, sf_dir):
    return metrics.per_class_metrics(inputs.predictions(spark, sf_dir))


@query("mcc", *BASE, f"select model, {_r('mcc')} from mcc")
def mcc(spark, sf_dir):
    return metrics.mcc(inputs.predictions(spark, sf_dir))


@query("sens_spec", *BASE, f"select model, {_r('specificity', 'sensitivity')} from hard")
def sens_spec(spark, sf_dir):
    return metrics.sens_spec(inputs.predictions(spark, sf_dir))


@query("classification_report", *BASE, f"""
select model, label, {_r('precision', 'recall', 'f1')}, support from (
  select model, cast(class_value as varchar) as label, precision, recall, f1, support from classes
  union all select model, 'accuracy', null, null, sum(hit) / max(valid)::double, max(valid) from classes group by model
  union all select model, 'macro avg', avg(precision), avg(recall), avg(f1), max(valid) from classes group by model
  union all select model, 'weighted avg', sum(precision * support) / max(valid), sum(recall * support) / max(valid),
            sum(f1 * support) / max(valid), max(valid) from classes group by model) k""")
def classification_report(spark, sf_dir):
    return metrics.classification_report(inputs.predictions(spark, sf_dir))


@query("success_rate", PREDICTIONS_SQL, """
select model, count(pred) as valid, count(*) as attempted, round(count(pred) / count(*), 6) as success_rate
from predictions group by model""")
def success_rate(spark, sf_dir):
    return metrics.success_rate(inputs.predictions(spark, sf_dir))


@query("roc_auc", *FULL, f"select model, {_r('auc_roc')} from roc")
def roc_auc(spark, sf_dir):
    return curves.roc_auc(inputs.predictions(spark, sf_dir))


@query("roc_auc_bucketed", *FULL, f"select model, {_r('auc_roc')} from roc")
def roc_auc_bucketed(spark, sf_dir):
    """The form used on large tables: score ranges spread over tasks."""
    return curves.roc_auc(inputs.predictions(spark, sf_dir), rows_per_bucket=1000)


@query("auc_pr", *FULL, f"select model, {_r('auc_pr')} from pr")
def auc_pr(spark, sf_dir):
    return curves.auc_pr(inputs.predictions(spark, sf_dir))


_THRESHOLDED = """
thresholds as (
  select model, threshold, sum(y)::double as pos, (count(*) - sum(y))::double as neg
  from (select model, score as threshold, y from predictions) s group by 1, 2),
upto as (
  select model, threshold, sum(pos) over w as tp, sum(neg) over w as fp,
    sum(pos) over (partition by model) as np, sum(neg) over (partition by model) as nn
  from thresholds window w as (partition by model order by threshold desc rows unbounded preceding))
"""


@query("roc_curve", PREDICTIONS_SQL, _THRESHOLDED, """
select model, 'roc' as kind, round(threshold, 6) as threshold, round(fp / nn, 6) as x, round(tp / np, 6) as y from upto
union all select distinct model, 'roc', cast(null as double), 0.0::double, 0.0::double from upto""")
def roc_curve(spark, sf_dir):
    return curves.roc_curve(inputs.predictions(spark, sf_dir))


@query("pr_curve", PREDICTIONS_SQL, _THRESHOLDED, """
select model, 'pr' as kind, round(threshold, 6) as threshold, round(tp / np, 6) as x, round(tp / (tp + fp), 6) as y from upto
union all select distinct model, 'pr', cast(null as double), 0.0::double, 1.0::double from upto""")
def pr_curve(spark, sf_dir):
    return curves.pr_curve(inputs.predictions(spark, sf_dir))


@query("pr_curve_bucketed", PREDICTIONS_SQL, _THRESHOLDED, """
select model, 'pr' as kind, round(threshold, 6) as threshold, round(tp / np, 6) as x, round(tp / (tp + fp), 6) as y from upto
union all select distinct model, 'pr', cast(null as double), 0.0::double, 1.0::double from upto""")
def pr_curve_bucketed(spark, sf_dir):
    """The form used on large tables."""
    return curves.pr_curve(inputs.predictions(spark, sf_dir), rows_per_bucket=1000)


_RECORD_SELECT = f"""
select model, attempted, valid, round(valid / attempted, 6) as success_rate, tn, fp, fn, tp, {RECORD} from record"""


@query("model_metrics", *FULL, _RECORD_SELECT)
def model_metrics(spark, sf_dir):
    return metrics.model_metrics(inputs.predictions(spark, sf_dir))


@query("metrics_json_roundtrip", *FULL, _RECORD_SELECT)
def metrics_json_roundtrip(spark, sf_dir):
    record = metrics.model_metrics(inputs.predictions(spark, sf_dir))
    path = scratch_path(spark, "metrics")
    tables.write_json(record, path)
    return tables.read_json(spark, path, record.schema)


@query("metrics_sink", PREDICTIONS_SQL, """
select 'metrics' as artefact, count(distinct model) as total_rows from predictions
union all select 'rankings', count(distinct model) * 5 from predictions
union all select 'curves', 2 * (count(distinct (model, score)) + count(distinct model)) from predictions""")
def metrics_sink(spark, sf_dir):
    rows = inputs.predictions(spark, sf_dir)
    root = scratch_path(spark, "evaluation")
    evaluate(spark, rows, root)

    def count(df, name):
        return df.agg(F.count("*").alias("total_rows")).select(F.lit(name).alias("artefact"), "total_rows")

    return (count(tables.read_json(spark, f"{root}/metrics"), "metrics")
            .unionByName(count(tables.read_json(spark, f"{root}/rankings"), "rankings"))
            .unionByName(count(spark.read.parquet(f"{root}/curves"), "curves")))


# --- comparison ------------------------------------------------------------------------------

@query("comparison_table", *FULL, f"""
select 'trained' as family, model, {_r(*compare.TRAINED_COLUMNS)}, null::double as precision_positive,
  null::double as recall_positive, null::double as f1_positive, null::double as success_rate, null::bigint as valid from record
union all select 'scored', model, round(accuracy, 6), null, null, null, null, null, round(mcc, 6) + 0.0::double, round(precision_positive, 6),
  round(recall_positive, 6), round(f1_positive, 6), round(valid / attempted, 6), valid from record""")
def comparison_table(spark, sf_dir):
    record = metrics.model_metrics(inputs.predictions(spark, sf_dir))
    return compare.comparison_table(record, record)


_LONG_SQL = """
long as (select model, metric, value from (select model, {names} from record) unpivot (value for metric in ({names})))
"""
_RANKED = _LONG_SQL.format(names=", ".join(compare.RANKED_METRICS))
_POSITIVE = _LONG_SQL.format(names=", ".join(compare.RANKED_POSITIVE))


@query("metrics_long", *FULL, _RANKED, f"select model, metric, {_r('value')} from long")
def metrics_long(spark, sf_dir):
    return compare.metrics_long(metrics.model_metrics(inputs.predictions(spark, sf_dir)), compare.RANKED_METRICS)


@query("metric_rankings", *FULL, _RANKED, f"""
select metric, cast(row_number() over (partition by metric order by value desc, model) as integer) as position,
  model, {_r('value')} from long""")
def metric_rankings(spark, sf_dir):
    return compare.metric_rankings(metrics.model_metrics(inputs.predictions(spark, sf_dir), areas=False))


@query("best_per_metric", *FULL, _POSITIVE, f"""
select metric, model, {_r('value')} from long
qualify row_number() over (partition by metric order by value desc, model) = 1""")
def best_per_metric(spark, sf_dir):
    return compare.best_per_metric(metrics.model_metrics(inputs.predictions(spark, sf_dir), areas=False))


@query("best_model", *BASE, """
select 'accuracy' as metric, model, round(accuracy, 6) as value from hard order by accuracy desc, model limit 1""")
def best_model(spark, sf_dir):
    return compare.best_model(metrics.hard_metrics(inputs.predictions(spark, sf_dir)))


@query("overall_rank", *BASE, f"""
select model, {_r('f1_positive')}, cast(row_number() over (order by f1_positive desc, model) as integer) as position from hard""")
def overall_rank(spark, sf_dir):
    return compare.overall_rank(metrics.positive_metrics(inputs.predictions(spark, sf_dir)))


@query("accuracy_summary", *BASE, """
select round(avg(accuracy), 6) as mean_accuracy, round(stddev_samp(accuracy), 6) as std_accuracy,
  round(max(accuracy), 6) as best_accuracy, round(min(accuracy), 6) as worst_accuracy,
  round(max(accuracy) - min(accuracy), 6) as accuracy_range from hard""")
def accuracy_summary(spark, sf_dir):
    return compare.accuracy_summary(metrics.hard_metrics(inputs.predictions(spark, sf_dir)))


_FOLD_SCORES = """
laid as (select event_id as row_id, cast(case when event_type = 'purchase' then 1 else 0 end as integer) as y from events),
placed as (select row_id, y, row_number() over (order by y, row_id) - 1 as pos,
                  row_number() over (partition by y order by row_id) as rn from laid),
sizes as (select y, pos % 5 as f, count(*) as size from placed group by 1, 2),
ends as (select y, f, sum(size) over (partition by y order by f) as last from sizes),
folds as (select p.row_id, min(e.f) as fold from placed p join ends e on e.y = p.y and p.rn <= e.last group by p.row_id),
scores as (select model, fold, avg(case when pred = y then 1.0::double else 0.0::double end) as value
           from predictions join folds using (row_id) where pred is not null group by 1, 2)
"""


def _fold_scores(spark, sf_dir):
    from scorelake.models.training import fold_scores
    rows = ordered_folds(inputs.predictions(spark, sf_dir).where("model = 'm1'").select("row_id", "y"), "row_id", "y", 5)
    return fold_scores(inputs.predictions(spark, sf_dir).join(rows.select("row_id", "fold"), "row_id"))


@query("cv_summary", PREDICTIONS_SQL, _FOLD_SCORES, """
select model, count(value) as folds, round(avg(value), 6) as mean_score, round(stddev_pop(value), 6) as std_score,
  round(max(value) filter (where fold = 0), 6) as score_0, round(max(value) filter (where fold = 1), 6) as score_1,
  round(max(value) filter (where fold = 2), 6) as score_2, round(max(value) filter (where fold = 3), 6) as score_3,
  round(max(value) filter (where fold = 4), 6) as score_4
from scores group by model""")
def cv_summary(spark, sf_dir):
    found = compare.cv_summary(_fold_scores(spark, sf_dir))
    return found.select("*", *[F.col("fold_scores")[i].alias(f"score_{i}") for i in range(5)]).drop("fold_scores")


@query("paired_t_stat", PREDICTIONS_SQL, _FOLD_SCORES, """
means as (select model, row_number() over (order by avg(value) desc, model) as position, avg(value) as m from scores group by model),
d as (select a.fold, a.value - b.value as d from scores a join scores b using (fold)
      where a.model = (select model from means where position = 1) and b.model = (select model from means where position = 2))
""", """
select (select model from means where position = 1) as best_model, (select model from means where position = 2) as second_model,
  round((select m from means where position = 1), 6) as best_score, round((select m from means where position = 2), 6) as second_score,
  count(*) as pairs, round(avg(d), 6) as mean_difference,
  round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as t_statistic from d""")
def paired_t_stat(spark, sf_dir):
    return significance.paired_t_stat(_fold_scores(spark, sf_dir))


@query("mcnemar_cells", *BASE, """
ranked as (select model, row_number() over (order by accuracy desc, model) as position from hard),
pairs as (select a.pred = a.y as a, b.pred = b.y as b from predictions a join predictions b using (row_id)
          where a.model = (select model from ranked where position = 1) and b.model = (select model from ranked where position = 2)
            and a.pred is not null and b.pred is not null)
""", """
select (select model from ranked where position = 1) as best_model, (select model from ranked where position = 2) as second_model,
  count(*) filter (where a and b) as both_right, count(*) filter (where a and not b) as only_best_right,
  count(*) filter (where not a and b) as only_second_right, count(*) filter (where not a and not b) as both_wrong from pairs""")
def mcnemar_cells(spark, sf_dir):
    return significance.mcnemar_cells(inputs.predictions(spark, sf_dir))


@query("top_features", IMPORTANCE_SQL, """
select model, feature, importance, cast(row_number() over (partition by model order by importance desc, feature) as integer)
  as position from importance
qualify row_number() over (partition by model order by importance desc, feature) <= 10""")
def top_features(spark, sf_dir):
    return compare.top_features(inputs.importance(spark, sf_dir), 10)


@query("summary_table", *FULL, """
select model, printf('%.3f%%', accuracy * 100) as accuracy, printf('%.3f', auc_roc) as auc from record""")
def summary_table(spark, sf_dir):
    return compare.summary_table(metrics.model_metrics(inputs.predictions(spark, sf_dir)))


@query("metric_sanity", *FULL, """
select model, accuracy between 0.5 and 1 as accuracy_ok, auc_roc between 0.5 and 1 as auc_ok,
  accuracy between 0.5 and 1 and auc_roc between 0.5 and 1 as sane from record""")
def metric_sanity(spark, sf_dir):
    return compare.metric_sanity(metrics.model_metrics(inputs.predictions(spark, sf_dir)))
