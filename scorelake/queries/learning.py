"""Training, tuning and prompt scoring.

Model queries learn the planted label. Fitted models are kept per session and data set, so that queries
that only look at a model do not train it again.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.models import inspection, training, tuning
from scorelake.operators import compare, metrics, sampling, scoring
from scorelake.operators.metrics import model_metrics
from scorelake.functions.text import parse_prediction, render_prompt
from scorelake.queries import inputs
from scorelake.queries.data import _folds_sql, split_sql
from scorelake.queries.evaluation import CELLS_SQL, CLASSES_SQL, HARD_SQL, _fold_scores, _FOLD_SCORES, _r
from scorelake.queries.inputs import ANSWERS_SQL, FEATURES, FEATURES_SQL, PREDICTIONS_SQL
from scorelake.queries.registry import query
from scorelake.session import scratch_path
from scorelake.sources.models import load_models, save_models

_tables: dict[tuple, DataFrame] = {}
_models: dict[tuple, object] = {}


ROWS_PER_PARTITION = 12_500


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled rows with their split, in memory for the fits."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        split = sampling.stratified_split(inputs.planted(spark, sf_dir), "row_id", "y")
        _tables[key] = training.assemble(
            split, "row_id", "y", FEATURES, keep=["split"], rows_per_partition=ROWS_PER_PARTITION).persist()
    return _tables[key]


def _train(spark, sf_dir):
    return _table(spark, sf_dir).where("split = 'train'")


def _test(spark, sf_dir):
    return _table(spark, sf_dir).where("split = 'test'")


def _fitted(spark, sf_dir, *names) -> dict:
    key = (spark.sparkContext.applicationId, sf_dir)
    absent = [n for n in names if (*key, n) not in _models]
    if absent:
        models, status = training.train_all(_train(spark, sf_dir), training.registry(absent), parallelism=4)
        failed = [s for s in status if s[1] != "trained"]
        if failed:
            raise RuntimeError(f"training failed: {failed}")
        _models.update({(*key, n): m for n, m in models.items()})
    return {n: _models[(*key, n)] for n in names}


def _stored(spark, predictions) -> DataFrame:
    """Written once: the metrics read predictions several times, and every read would apply the models again."""
    path = scratch_path(spark, "predictions")
    predictions.write.parquet(path)
    return spark.read.parquet(path)


def _evaluate(spark, sf_dir, *names) -> DataFrame:
    return model_metrics(_stored(spark, training.predict(_fitted(spark, sf_dir, *names), _test(spark, sf_dir))))


@query("split_train_evaluate")
def split_train_evaluate(spark, sf_dir):
    return _evaluate(spark, sf_dir, "LogisticRegression")


# Learned numbers differ from engine to engine; these rows hold what is fixed (rows and class supports of the test split)
# and whether the learned part meets its bound.
_TEST_SQL = [FEATURES_SQL, "planted as (select * exclude (y), cast(case when f_value + (row_id * 7919) % 40 > 80 then 1 else 0 end as integer) as y from features)",
             split_sql("planted"), "test as (select row_id, y from split where split = 'test')"]


def _record_sql(*names):
    models = " union all ".join(f"select '{n}' as model" for n in names)
    return f"""
select model, count(*) as attempted, count(*) as valid, count(*) filter (where y = 0) as support_0,
  count(*) filter (where y = 1) as support_1, true as ranks_well from test cross join ({models}) m group by model"""


def _checked(record: DataFrame, bound: float = 0.8) -> DataFrame:
    return record.select("model", "attempted", "valid", (F.col("tn") + F.col("fp")).alias("support_0"),
                         (F.col("fn") + F.col("tp")).alias("support_1"), (F.col("auc_roc") > bound).alias("ranks_well"))


@query("train_lr", *_TEST_SQL, _record_sql("LogisticRegression"))
def train_lr(spark, sf_dir):
    return _checked(_evaluate(spark, sf_dir, "LogisticRegression"))


@query("model_record", *_TEST_SQL, f"""
select r.*, case model when 'Ensemble' then 'SoftVote' else 'LogisticRegressionModel' end as model_type
from ({_record_sql("LogisticRegression", "Ensemble")}) r""")
def model_record(spark, sf_dir):
    """The record of a model and of its vote with itself, with the kind of model."""
    models = _fitted(spark, sf_dir, "LogisticRegression")
    twice = {**models, "Again": models["LogisticRegression"]}
    predicted = _stored(spark, training.predict(twice, _test(spark, sf_dir), ensemble=True).where("model <> 'Again'"))
    return inspection.with_model_type(_checked(model_metrics(predicted)), models)


@query("fold_predictions", *_TEST_SQL[:2], *_folds_sql("row_id", 3, "planted")[:1], f"""
select 'LogisticRegression' as model, fold, count(*) as attempted, count(*) filter (where y = 1) as support_1, true as ranks_well
from ({_folds_sql("row_id", 3, "planted")[1]}) f group by fold""")
def fold_predictions(spark, sf_dir):
    """Out-of-fold predictions: every row once, by a model that hasn't seen its fold."""
    found = training.cross_validate(_folds(spark, sf_dir, 3), training.registry(["LogisticRegression"]), 3, parallelism=3)
    found = _stored(spark, found)
    parts = found.withColumn("model", F.concat_ws("|", "model", "fold"))
    record = model_metrics(parts)
    fold = F.split("model", r"\|")
    return record.select(fold[0].alias("model"), fold[1].cast("int").alias("fold"), "attempted", (F.col("fn") + F.col("tp")).alias("support_1"),
                         (F.col("auc_roc") > 0.8).alias("ranks_well"))


@query("train_rf", *_TEST_SQL, _record_sql("RandomForest"))
def train_rf(spark, sf_dir):
    return _checked(_evaluate(spark, sf_dir, "RandomForest"))


@query("train_svm", *_TEST_SQL, _record_sql("SVM"))
def train_svm(spark, sf_dir):
    return _checked(_evaluate(spark, sf_dir, "SVM"))


@query("train_gbt", *_TEST_SQL, _record_sql("GradientBoosting"))
def train_gbt(spark, sf_dir):
    return _checked(_evaluate(spark, sf_dir, "GradientBoosting"))


@query("train_all", *_TEST_SQL, f"""
select *, 'trained' as status, null::varchar as error from ({_record_sql(*training.MODEL_NAMES)}) r
union all select *, null, null from ({_record_sql("Ensemble")}) r""")
def train_all(spark, sf_dir):
    models = _fitted(spark, sf_dir, *training.MODEL_NAMES)
    status = training.status_table(spark, [(n, "trained", None) for n in models])
    predicted = _stored(spark, training.predict(models, _test(spark, sf_dir), ensemble=True))
    return _checked(model_metrics(predicted)).join(status, "model", "left")


@query("predict_all", *_TEST_SQL, """
select model, row_id, y, true as in_range, true as class_follows_score from test
cross join (select unnest(['RandomForest', 'LogisticRegression', 'SVM', 'GradientBoosting', 'Ensemble']) as model) m""")
def predict_all(spark, sf_dir):
    found = training.predict(_fitted(spark, sf_dir, *training.MODEL_NAMES), _test(spark, sf_dir), ensemble=True)
    follows = (F.col("pred") == (F.col("score") > 0.5).cast("int")) | (F.abs(F.col("score") - 0.5) < 1e-9)
    # The linear machine decides by its margin, its score is the calibrated margin.
    return found.select("model", "row_id", "y", F.col("score").between(0.0, 1.0).alias("in_range"),
                        (follows | (F.col("model") == "SVM")).alias("class_follows_score"))


_CUT_COLUMNS = ["f0", "f_hour", "f_k"]


def _cuts_sql(name: str, rows: str, by: str) -> str:
    """Best cut per node: all values tried, gains of second order with ridge term 1."""
    return f"""
{name} as (
  select node, feature, v as cut, gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1) as gain
  from (select node, feature, v, gl, hl, sum(g) over w - gl as gr, sum(h) over w - hl as hr
        from (select *, sum(g) over (partition by node, feature order by v) as gl, sum(h) over (partition by node, feature order by v) as hl
              from (select {by} as node, feature, v, sum(g) as g, sum(h) as h from {rows} group by 1, 2, 3) s) s
        window w as (partition by node, feature)) s
  where hl >= 1 and hr >= 1
  qualify row_number() over (partition by node order by gain desc, feature, v) = 1)"""


@query("boosted_first_splits", FEATURES_SQL, _TEST_SQL[1], """
gh as (select row_id, floor(f_value / 10) as f0, f_hour, f_k, case when y = 1 then -2.0::double else 0.5 end as g,
              case when y = 1 then 1.0::double else 0.25 end as h from planted)""", """
long as (select row_id, 0 as feature, f0 as v, g, h from gh union all select row_id, 1, f_hour, g, h from gh
         union all select row_id, 2, f_k, g, h from gh)""", _cuts_sql("top", "long", "1"), """
sides as (select l.*, case when r.v <= t.cut then 2 else 3 end as side
          from long l join top t on true join long r on r.row_id = l.row_id and r.feature = t.feature)""",
       _cuts_sql("below", "sides", "side"),
       "select cast(node as integer) as node, cast(feature as integer) as feature, cut, round(gain, 6) as gain from (select * from top union all select * from below) n")
def boosted_first_splits(spark, sf_dir):
    """The two upper levels of the first boosted tree: features, cuts and gains."""
    rows = inputs.planted(spark, sf_dir).withColumn("f0", F.floor(F.col("f_value") / 10).cast("double"))
    table = training.assemble(rows, "row_id", "y", _CUT_COLUMNS, rows_per_partition=ROWS_PER_PARTITION)
    model = training.build("GradientBoosting", maxIter=1, maxDepth=2).fit(table).stages[-1]
    return model.node_rows(spark).where("feature >= 0").select("node", "feature", "cut", "gain")


@query("importance", f"""
select model, feature, 1.0::double as total from (select unnest({FEATURES}) as feature) f
cross join (select unnest(['RandomForest', 'GradientBoosting']) as model) m""")
def importance(spark, sf_dir):
    """Features per model; their importance adds up to one."""
    models = _fitted(spark, sf_dir, "RandomForest", "GradientBoosting")
    found = inspection.feature_importance(spark, models, FEATURES)
    return found.select("model", "feature", F.sum("importance").over(Window.partitionBy("model")).alias("total"))


@query("coefficients")
def coefficients(spark, sf_dir):
    models = _fitted(spark, sf_dir, "LogisticRegression")
    return inspection.feature_importance(spark, models, FEATURES).select(
        "model", "feature", "coefficient", "abs_coefficient")


@query("model_roundtrip", """
select 'LogisticRegression' as model, cast(ceil(count(*) * cast(0.3 as double)) as bigint) as compared,
  cast(0 as bigint) as different from events""")
def model_roundtrip(spark, sf_dir):
    """A stored and reloaded model predicts the same classes and scores under the same name."""
    models = _fitted(spark, sf_dir, "LogisticRegression")
    path = scratch_path(spark, "models")
    save_models(spark, models, path)
    test = _test(spark, sf_dir)
    pair = {"before": models["LogisticRegression"], **load_models(spark, path)}
    both = training.with_scores(test.select("row_id", "y", "features"), pair)
    same = (F.col("pred_0") == F.col("pred_1")) & (F.col("score_0") == F.col("score_1"))
    return both.agg(F.count("*").alias("compared"), F.count(F.when(~same, 1)).alias("different")).select(
        F.lit(list(pair)[1]).alias("model"), "compared", "different")


def _folds(spark, sf_dir, n):
    folded = sampling.ordered_folds(inputs.planted(spark, sf_dir), "row_id", "y", n)
    return training.assemble(
        folded, "row_id", "y", FEATURES, keep=["fold"], rows_per_partition=ROWS_PER_PARTITION).persist()


@query("cross_validate")
def cross_validate(spark, sf_dir):
    """Five folds of all models: mean and deviation of the fold accuracies."""
    found = training.cross_validate(_folds(spark, sf_dir, 5), training.registry(), 5, parallelism=4)
    return compare.cv_summary(training.fold_scores(found)).drop("fold_scores")


def _follows():
    """Scores of a model fall with the position."""
    return F.col("mean_score") <= F.lag("mean_score", 1, 2.0).over(Window.partitionBy("model").orderBy("position"))


@query("grid_search", """
select '{"C": ' || c || ', "penalty": "' || p || '", "maxIter": ' || m || '}' as params, true as position_follows_score
from (select unnest(['0.001', '0.01', '0.1', '1.0', '10.0', '100.0']) as c) a
cross join (select unnest(['l1', 'l2']) as p) b cross join (select unnest(['1000', '2000', '5000']) as m) d""")
def grid_search(spark, sf_dir):
    """All 36 combinations of the logistic regression's grid."""
    return tuning.grid_search(_folds(spark, sf_dir, 3), "LogisticRegression", parallelism=4).table(spark).select("params", _follows().alias("position_follows_score"))


@query("random_search", f"""
select model, cast(20 as bigint) as candidates, cast(20 as bigint) as different, true as position_follows_score
from (select unnest({training.MODEL_NAMES}) as model) m""")
def random_search(spark, sf_dir):
    """Twenty combinations for each of the models."""
    found = tuning.random_search(_folds(spark, sf_dir, 3), n_iter=20, parallelism=4)
    failed = {name: str(e) for name, e in found.items() if isinstance(e, Exception)}
    if failed:
        raise RuntimeError(f"search failed: {failed}")
    rows = reduce(DataFrame.unionByName, [result.table(spark) for result in found.values()]).withColumn("follows", _follows())
    return rows.groupBy("model").agg(F.count("*").alias("candidates"), F.count_distinct("params").alias("different"),
                                     F.bool_and("follows").alias("position_follows_score"))


@query("train_cv")
def train_cv(spark, sf_dir):
    """Cross-validate all models, then fit them on all rows; the history rows keep the mean scores."""
    table = _folds(spark, sf_dir, 5)
    estimators = training.registry()
    summary = compare.cv_summary(training.fold_scores(training.cross_validate(table, estimators, 5, parallelism=4)))
    _, status = training.train_all(table, estimators)
    if any(s != "trained" for _, s, _ in status):
        raise RuntimeError(f"training failed: {status}")
    path = scratch_path(spark, "history")
    training.append_history(training.history_rows(summary, "cross_validation", "5 folds", "mean_score"), path)
    return training.training_summary(spark.read.parquet(path)).drop("trained_at")


@query("training_history", PREDICTIONS_SQL, _FOLD_SCORES, """
select model, cast(n as integer) as training, method, detail, best_score from (
  select model, 1 as n, 'cross_validation' as method, '5 folds' as detail, round(avg(value), 6) as best_score from scores group by model
  union all select model, 2, 'hyperparameter_tuning', '5 folds', round(max(value), 6) from scores group by model) h""")
def training_history(spark, sf_dir):
    scores = _fold_scores(spark, sf_dir)
    path = scratch_path(spark, "history")
    training.append_history(
        training.history_rows(compare.cv_summary(scores), "cross_validation", "5 folds", "mean_score"), path)
    best = scores.groupBy("model").agg(F.max("value").alias("best"))
    training.append_history(training.history_rows(best, "hyperparameter_tuning", "5 folds", "best"), path)
    return training.training_summary(spark.read.parquet(path)).drop("trained_at")


@query("soft_vote", """
select event_id as row_id, round(s, 6) as score, cast(case when s > 0.5 then 1 else 0 end as integer) as pred
from (select event_id, (((event_id * 7919) % 1000) / 1000.0::double + ((event_id * 104729) % 1000) / 1000.0::double
                        + ((event_id * 1299709) % 1000) / 1000.0::double) / 3 as s from events) e""")
def soft_vote(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        *[(F.col("event_id") * a % 1000 / F.lit(1000.0)).alias(f"s{i}") for i, a in enumerate((7919, 104729, 1299709))])
    return training.soft_vote(rows, ["s0", "s1", "s2"]).select("row_id", "score", "pred")


# --- prompt scoring --------------------------------------------------------------------------

# The wording of the prompt.
_PROMPT_SQL = """
'You are a clinical prediction expert. Based on the following health and demographic features, predict the Health Status (0 = Good Health, 1 = Poor Health).'
  || chr(10) || chr(10) || 'Features:' || chr(10)
  || '- f_value: ' || printf('%.2f', f_value) || chr(10) || '- f_user: ' || printf('%.2f', f_user) || chr(10)
  || '- f_hour: ' || printf('%.2f', f_hour) || chr(10) || '- f_k: ' || printf('%.2f', f_k) || chr(10) || chr(10)
  || 'Please analyze these features and provide your prediction for Health Status.' || chr(10)
  || 'Respond with ONLY a single number: 0 for Good Health or 1 for Poor Health.' || chr(10)
  || 'Do not provide any explanation or additional text.'
"""


@query("row_to_map", FEATURES_SQL, """
select row_id, 'f_value' as feature, round(f_value, 6) as value from features
union all select row_id, 'f_user', f_user from features union all select row_id, 'f_hour', f_hour from features
union all select row_id, 'f_k', f_k from features""")
def row_to_map(spark, sf_dir):
    maps = scoring.row_to_map(inputs.features(spark, sf_dir), "row_id", FEATURES)
    return maps.select("row_id", F.explode("features").alias("feature", "value"))


@query("render_prompt", FEATURES_SQL, f"select row_id, {_PROMPT_SQL} as prompt from features")
def prompt_text(spark, sf_dir):
    rows = inputs.features(spark, sf_dir)
    return rows.select("row_id", render_prompt(rows, FEATURES).alias("prompt"))


PARSED_SQL = """
parsed as (
  select *, case
    when t like '%0%' and t not like '%1%' then 0
    when t like '%1%' and t not like '%0%' then 1
    when regexp_matches(t, 'good|healthy|excellent|positive') then 0
    when regexp_matches(t, 'poor|unhealthy|bad|negative') then 1
    when try_cast(nullif(regexp_extract(t, '[0-9]+'), '') as bigint) in (0, 1)
      then cast(regexp_extract(t, '[0-9]+') as integer) end as pred
  from (select *, lower(trim(raw)) as t from answers) a)
"""


@query("parse_prediction", ANSWERS_SQL, PARSED_SQL, "select row_id, raw, pred from parsed")
def parsed_answers(spark, sf_dir):
    return inputs.answers(spark, sf_dir).select("row_id", "raw", parse_prediction(F.col("raw")).alias("pred"))


def threshold_scorer() -> scoring.Scorer:
    """Stands in for a language model: a fixed rule on two features named in the prompt.

    Defined inside a function, so that tasks receive the code itself and need not import this module.
    """
    def answer(model: str, prompts: list[str]) -> list[str | None]:
        limit = 40.0 if model == "alpha" else 60.0
        answers: list[str | None] = []
        for text in prompts:
            value, k = (float(re.search(rf"- {f}: (\S+)", text).group(1)) for f in ("f_value", "f_k"))
            if k % 5 == 0:
                answers.append(None)
            elif k % 5 == 1:
                answers.append("cannot tell")
            else:
                answers.append("Poor health" if value > limit else "0")
        return answers

    return answer


_SCORED_SQL = """
scored as (
  select m.model, row_id, y,
    case cast(f_k as bigint) % 5 when 0 then null when 1 then 'cannot tell'
      else case when f_value > m.bound then 'Poor health' else '0' end end as raw,
    cast(case when cast(f_k as bigint) % 5 in (0, 1) then 3 else 1 end as integer) as attempts,
    cast(case when cast(f_k as bigint) % 5 in (0, 1) then null when f_value > m.bound then 1 else 0 end as integer) as pred
  from features cross join (select 'alpha' as model, 40.0::double as bound union all select 'beta', 60.0) m)
"""


def _responses(spark, sf_dir, models):
    pending = scoring.prompts(inputs.features(spark, sf_dir), "row_id", "y", FEATURES, models)
    return scoring.score(pending, threshold_scorer())


@query("batch_score", FEATURES_SQL, _SCORED_SQL,
       "select model, row_id, y, raw, attempts, pred, cast(null as varchar) as error from scored where model = 'alpha'")
def batch_score(spark, sf_dir):
    return _responses(spark, sf_dir, ["alpha"])


@query("score_all_models", FEATURES_SQL, _SCORED_SQL, "select model, row_id, y, raw, attempts, pred, cast(null as varchar) as error from scored")
def score_all_models(spark, sf_dir):
    return _responses(spark, sf_dir, ["alpha", "beta"])


def slow_scorer() -> scoring.Scorer:
    """The threshold rule, but prompts with two certain values never get an answer."""
    rule = threshold_scorer()

    def answer(model: str, prompts: list[str]) -> list[str | None]:
        import time

        if any("- f_hour: 5.00" in text and "- f_k: 13.00" in text for text in prompts):
            time.sleep(3600)
        return rule(model, prompts)

    return answer


@query("score_with_time_limit", FEATURES_SQL, _SCORED_SQL, """
select model, row_id, s.y, case when hangs then null else raw end as raw, case when hangs then null else pred end as pred,
  case when hangs then 'TimeoutError: no answer within 1 s' end as error
from scored s join (select row_id, f_hour = 5 and f_k = 13 as hangs from features) f using (row_id) where model = 'alpha'""")
def score_with_time_limit(spark, sf_dir):
    """Some prompts hang: their calls are ended, four are in flight per task, all other rows get their answers."""
    pending = scoring.prompts(inputs.features(spark, sf_dir), "row_id", "y", FEATURES, ["alpha"])
    found = scoring.score(pending, slow_scorer(), max_attempts=2, batch_size=4, partitions=8, time_limit=1.0, window=4)
    return found.select("model", "row_id", "y", "raw", "pred", "error")


@query("resume_scoring", FEATURES_SQL, _SCORED_SQL, "select model, row_id, attempts, pred from scored")
def resume_scoring(spark, sf_dir):
    """A run that stopped after the first model goes on with the rows not stored yet."""
    path = scratch_path(spark, "responses")
    _responses(spark, sf_dir, ["alpha"]).write.mode("append").parquet(path)
    pending = scoring.prompts(inputs.features(spark, sf_dir), "row_id", "y", FEATURES, ["alpha", "beta"])
    left = scoring.unscored(pending, spark.read.parquet(path))
    scoring.score(left, threshold_scorer()).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("model", "row_id", "attempts", "pred")


_SCORED_METRICS = [
    PARSED_SQL, "predictions as (select model, row_id, y, pred from parsed)", CELLS_SQL, CLASSES_SQL, HARD_SQL]


@query("llm_metrics", ANSWERS_SQL, *_SCORED_METRICS, f"""
select model, attempted, valid, round(valid / attempted, 6) as success_rate, tn, fp, fn, tp,
  {_r(*metrics.RECORD_METRICS)}, null::double as auc_roc, null::double as auc_pr
from cells join hard using (model) join mcc using (model)""")
def llm_metrics(spark, sf_dir):
    answers = inputs.answers(spark, sf_dir)
    return scoring.scored_metrics(answers.withColumn("pred", parse_prediction(F.col("raw"))))
