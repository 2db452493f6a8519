"""Sources and sinks, projections, checks, statistics, splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.operators import profile, sampling
from scorelake.plans import prepare
from scorelake.queries import inputs
from scorelake.queries.inputs import DIRTY_SQL, FEATURES, FEATURES_SQL, IMPORTANCE_SQL, PREDICTIONS_SQL
from scorelake.queries.registry import query
from scorelake.session import scratch_path
from scorelake.sources import tables

EXPECTED = ["v", "u", "z", "w"]     # "w" does not exist

# --- sources and sinks -----------------------------------------------------------------------

_FEATURE_ROWS = "select row_id, round(f_value, 6) as f_value, f_user, f_hour, f_k, y from features"


def _stored_csv(spark, df, name):
    path = scratch_path(spark, name) + ".csv"
    tables.write_table(df, path)
    return path


@query("csv_scan", FEATURES_SQL, "select row_id, round(f_value, 6) as f_value, f_user, f_hour, f_k, cast(y as double) as y from features")
def csv_scan(spark, sf_dir):
    path = _stored_csv(spark, inputs.features(spark, sf_dir), "scan")
    return tables.read_table(spark, path, tables.record_schema(FEATURES, "y", "row_id"))


@query("csv_roundtrip", FEATURES_SQL, "select row_id, round(f_value, 6) as f_value, f_user, f_hour, f_k, y from features where y is not null")
def csv_roundtrip(spark, sf_dir):
    cleaned = profile.clean_rows(inputs.features(spark, sf_dir), "y")
    schema = cleaned.schema
    return tables.read_table(spark, _stored_csv(spark, cleaned, "processed"), schema)


@query("scan_guard", """
select c.source_case, c.outcome, (select count(*) from events) as total_rows
from (select 'present' as source_case, 'rows' as outcome union all select 'missing', 'FileNotFoundError'
      union all select 'empty', 'ValueError') c""")
def scan_guard(spark, sf_dir):
    source = f"{sf_dir}/events.parquet"
    empty = scratch_path(spark, "empty")
    inputs.table(spark, sf_dir, "events").where("false").write.parquet(empty)

    def outcome(path):
        try:
            tables.read_table(spark, path)
            return "rows"
        except (FileNotFoundError, ValueError) as e:
            return type(e).__name__

    cases = {"present": source, "missing": scratch_path(spark, "missing"), "empty": empty}
    found = F.array(*[F.struct(F.lit(c).alias("source_case"), F.lit(outcome(p)).alias("outcome"))
                      for c, p in cases.items()])
    return (inputs.table(spark, sf_dir, "events").agg(F.count("*").alias("total_rows"))
            .select(F.explode(found).alias("f"), "total_rows").select("f.*", "total_rows"))


def split_sql(table, test_size="0.3"):
    """Stratified split by ranking every row, as a check of the cut keys."""
    return f"""
c as (select y, count(*) as c from {table} group by y),
n as (select cast(sum(c) as bigint) as n from c),
q as (select y, c * (n - ceil(n * cast({test_size} as double))) / n as exact,
             cast(n - ceil(n * cast({test_size} as double)) as bigint) as tr from c cross join n),
q2 as (select y, cast(floor(exact) as bigint) + case when row_number() over (order by exact - floor(exact) desc, y)
                 <= tr - sum(cast(floor(exact) as bigint)) over () then 1 else 0 end as quota from q),
r as (select *, row_number() over (partition by y order by md5(concat_ws('|', 42, row_id)), row_id) as rn from {table}),
split as (select r.*, case when rn <= quota then 'train' else 'test' end as split from r join q2 on r.y = q2.y)
"""


@query("split_sink", FEATURES_SQL, split_sql("features"),
       "select row_id, round(f_value, 6) as f_value, f_user, f_hour, f_k, y, split from split")
def split_sink(spark, sf_dir):
    split = sampling.stratified_split(inputs.features(spark, sf_dir), "row_id", "y")
    path = scratch_path(spark, "splits")
    tables.write_splits(split, path, FEATURES, "y", keep=["row_id"])
    return spark.read.parquet(path)


_BALANCE_SQL = """
b as (select split, y as class_value, count(*) as class_count from split group by split, y),
balance as (
  select split, class_value, class_count,
    round(class_count / sum(class_count) over (partition by split), 6) as class_proportion,
    cast(sum(class_count) over (partition by split) as bigint) as total_samples,
    first_value(class_value) over (partition by split order by class_count desc, class_value) as majority_class,
    first_value(class_value) over (partition by split order by class_count, class_value desc) as minority_class,
    round(max(class_count) over (partition by split) / min(class_count) over (partition by split), 6) as imbalance_ratio
  from b)
"""


@query("split_metadata", FEATURES_SQL, split_sql("features"), _BALANCE_SQL, """
select max(case when split = 'train' then total_samples end) as train_samples,
  max(case when split = 'test' then total_samples end) as test_samples,
  'f_value,f_user,f_hour,f_k' as features,
  max(case when split = 'train' and class_value = 1 then class_count end) as train_class_1,
  max(case when split = 'test' and class_value = 1 then class_count end) as test_class_1,
  max(case when split = 'train' and class_value = 0 then class_proportion end) as train_share_0,
  max(case when split = 'train' then majority_class end) as train_majority,
  max(case when split = 'test' then imbalance_ratio end) as test_ratio,
  cast(0.3 as double) as test_size, cast(42 as bigint) as random_state
from balance""")
def split_metadata(spark, sf_dir):
    split = sampling.stratified_split(inputs.features(spark, sf_dir), "row_id", "y")
    meta = tables.split_metadata(split, FEATURES, "y", 0.3, 42)
    path = scratch_path(spark, "metadata")
    tables.write_json(meta, path)
    return tables.read_json(spark, path, meta.schema).select(
        "train_samples", "test_samples", F.array_join("features", ",").alias("features"),
        F.col("train_balance.class_counts")["1"].alias("train_class_1"),
        F.col("test_balance.class_counts")["1"].alias("test_class_1"),
        F.col("train_balance.class_proportions")["0"].alias("train_share_0"),
        F.col("train_balance.majority_class").alias("train_majority"),
        F.col("test_balance.imbalance_ratio").alias("test_ratio"), "test_size", "random_state")


_SAMPLE_SQL = """
n as (select count(*) as n, least(count(*), 200) as size from {t}),
c as (select y, count(*) as c from {t} where y is not null group by y),
q as (select y, greatest(1, cast(floor(c / n * size) as bigint)) as q, size from c cross join n),
q2 as (select y, q - case when row_number() over (order by q desc, y) = 1
                          then greatest(0, cast(sum(q) over () as bigint) - size) else 0 end as quota from q),
r as (select *, row_number() over (partition by y order by md5(concat_ws('|', 42, {id})), {id}) as rn from {t}),
sample as (select r.* from r join q2 on r.y = q2.y where rn <= quota)
"""


@query("sample_sink", DIRTY_SQL, "base as (select distinct * from dirty)", _SAMPLE_SQL.format(t="base", id="event_id"),
       "select event_id, round(v, 6) as v, u, z, y from sample")
def sample_sink(spark, sf_dir):
    """Stratified sample of rows whose label is sometimes missing, through a CSV file."""
    rows = profile.dedupe_rows(inputs.dirty(spark, sf_dir))
    sample = sampling.stratified_sample(rows, "event_id", "y", 200)
    return tables.read_table(spark, _stored_csv(spark, sample, "sample"), sample.schema)


@query("importance_sink", IMPORTANCE_SQL, "select model, feature, importance from importance")
def importance_sink(spark, sf_dir):
    path = scratch_path(spark, "importance")
    tables.write_importance(inputs.importance(spark, sf_dir), path)
    schema = T.StructType.fromDDL("feature string, importance double, model string")
    return tables.read_table(spark, path, schema, fmt="csv").select("model", "feature", "importance")


# --- projections -----------------------------------------------------------------------------

@query("project_features", FEATURES_SQL, "select row_id, round(f_value, 6) as f_value, f_k, f_user from features")
def project_features(spark, sf_dir):
    return profile.project_features(inputs.features(spark, sf_dir), ["f_value", "absent", "f_k", "f_user"], ["row_id"])


@query("numeric_projection", "select p_partkey, p_size, round(p_retailprice, 6) as p_retailprice from part")
def numeric_projection(spark, sf_dir):
    return profile.numeric_projection(inputs.table(spark, sf_dir, "part"), ["p_size", "absent"])


@query("clean_rows", DIRTY_SQL, "select distinct event_id, round(v, 6) as v, u, z, y from dirty where y is not null")
def clean_rows(spark, sf_dir):
    return profile.clean_rows(inputs.dirty(spark, sf_dir), "y")


@query("cleaning_report", DIRTY_SQL, """
select (select count(*) from dirty) as rows_before,
  (select count(*) from dirty) - count(*) as removed_duplicates,
  count(*) - count(y) as removed_missing_target, count(y) as rows_after
from (select distinct * from dirty)""")
def cleaning_report(spark, sf_dir):
    return profile.cleaning_report(inputs.dirty(spark, sf_dir), "y")


@query("valid_predictions", PREDICTIONS_SQL,
       "select model, row_id, y, pred, round(score, 6) as score from predictions where pred is not null")
def valid_predictions(spark, sf_dir):
    from scorelake.operators import metrics
    return metrics.valid_predictions(inputs.predictions(spark, sf_dir))


# --- checks ----------------------------------------------------------------------------------

@query("check_required", DIRTY_SQL, """
select c.column_name, c.status, (select count(*) from dirty) as total_rows
from (select 'v' as column_name, 'OK' as status union all select 'u', 'OK' union all select 'z', 'OK'
      union all select 'w', 'ERROR' union all select 'y', 'OK' union all select 'event_id', 'OK') c""")
def check_required(spark, sf_dir):
    return profile.check_required(inputs.dirty(spark, sf_dir), EXPECTED, "y", "event_id")


@query("check_numeric", """
select 'c_acctbal' as column_name, 'OK' as status, count(c_acctbal) as value_count from customer
union all select 'c_mktsegment', 'WARNING', count(c_mktsegment) from customer
union all select 'c_nationkey', 'OK', count(c_nationkey) from customer""")
def check_numeric(spark, sf_dir):
    return profile.check_numeric(inputs.table(spark, sf_dir, "customer"),
                                 ["c_acctbal", "c_mktsegment", "absent", "c_nationkey"])


_MISSING_SQL = """
missing as (
  select u.column_name, n.total_rows, cast(u.missing_count as bigint) as missing_count,
         round(u.missing_count / n.total_rows, 6) as missing_share
  from (select count(*) as total_rows, count(*) - count(event_id) as event_id, count(*) - count(v) as v,
               count(*) - count(u) as u, count(*) - count(z) as z, count(*) - count(y) as y from dirty) n
  cross join lateral (values ('event_id', n.event_id), ('v', n.v), ('u', n.u), ('z', n.z), ('y', n.y))
    u(column_name, missing_count))
"""
_MISSING_COLUMNS = "column_name, missing_count, total_rows, missing_share"


@query("missing_by_column", DIRTY_SQL, _MISSING_SQL, f"select {_MISSING_COLUMNS} from missing")
def missing_by_column(spark, sf_dir):
    return profile.missing_by_column(inputs.dirty(spark, sf_dir))


@query("high_missing", DIRTY_SQL, _MISSING_SQL,
       f"select {_MISSING_COLUMNS} from missing where missing_count > total_rows * 0.1")
def high_missing(spark, sf_dir):
    return profile.high_missing(inputs.dirty(spark, sf_dir))


@query("empty_columns", DIRTY_SQL, _MISSING_SQL,
       "select column_name, total_rows from missing where missing_count = total_rows")
def empty_columns(spark, sf_dir):
    return profile.empty_columns(inputs.dirty(spark, sf_dir))


@query("check_target", DIRTY_SQL, """
select 'target_classes' as check_name, case when count(distinct y) < 2 then 'ERROR' else 'OK' end as status,
  case count(distinct y) when 0 then 'no class' when 1 then 'only one class' end as detail from dirty""")
def check_target(spark, sf_dir):
    return profile.check_target(inputs.dirty(spark, sf_dir), "y")


@query("duplicate_count", DIRTY_SQL, """
select (select count(*) from dirty) as total_rows, (select count(*) from dirty) - count(*) as duplicate_rows
from (select distinct * from dirty)""")
def duplicate_count(spark, sf_dir):
    return profile.duplicate_count(inputs.dirty(spark, sf_dir))


@query("dedupe_rows", DIRTY_SQL, "select distinct event_id, round(v, 6) as v, u, z, y from dirty")
def dedupe_rows(spark, sf_dir):
    return profile.dedupe_rows(inputs.dirty(spark, sf_dir))


@query("validation_report", DIRTY_SQL, _MISSING_SQL, """
found as (
  select 'required_columns' as check_name, 'w' as column_name, 'ERROR' as status, 'missing column' as detail
  union all select 'numeric_types', null, 'OK', null
  union all select 'missing_values', column_name, 'WARNING', cast(missing_count as varchar) from missing
            where missing_count > total_rows * 0.1
  union all select 'target_classes', null, case when count(distinct y) < 2 then 'ERROR' else 'OK' end,
            case count(distinct y) when 0 then 'no class' when 1 then 'only one class' end from dirty
  union all select 'duplicate_rows', null, case when d > 0 then 'WARNING' else 'OK' end, cast(d as varchar)
            from (select (select count(*) from dirty) - count(*) as d from (select distinct * from dirty)))
""", "select *, (select count(*) from found where status = 'ERROR') = 0 as passed from found")
def validation_report(spark, sf_dir):
    return profile.validation_report(inputs.dirty(spark, sf_dir), EXPECTED, "y", "event_id")


@query("validate_columns", DIRTY_SQL, """
select 'empty_columns' as check_name, 'z' as column_name, 'WARNING' as status,
  cast(count(*) as varchar) as detail, true as passed from dirty where (select count(z) from dirty) = 0""")
def validate_columns(spark, sf_dir):
    return profile.validate_columns(inputs.dirty(spark, sf_dir), ["event_id", "v", "z"], ["v", "u"])


@query("table_profile", DIRTY_SQL, _MISSING_SQL, """
select 'shape' as section, 'rows' as item, cast(null as varchar) as text, cast(count(*) as double) as number from dirty
union all select 'shape', 'columns', null, 5.0
union all select 'duplicates', 'rows', null, (select count(*) from dirty) - count(*) from (select distinct * from dirty)
union all select 'type', c, t, null from (values ('event_id', 'bigint'), ('v', 'double'), ('u', 'double'),
                                                 ('z', 'double'), ('y', 'int')) k(c, t)
union all select 'missing', column_name, null, missing_count from missing
union all select 'class_count', cast(y as varchar), null, count(*) from dirty where y is not null group by y
union all select 'class_proportion', cast(y as varchar), null, round(count(*) / (select count(*) from dirty), 6)
  from dirty where y is not null group by y""")
def table_profile(spark, sf_dir):
    return profile.table_profile(inputs.dirty(spark, sf_dir), "y")


# --- class counts and column statistics ------------------------------------------------------

@query("class_balance", DIRTY_SQL, """
select y as class_value, count(*) as class_count, round(count(*) / (select count(*) from dirty), 6) as class_proportion,
  (select count(*) from dirty) as total_samples,
  first_value(y) over (order by count(*) desc, y) as majority_class,
  first_value(y) over (order by count(*), y desc) as minority_class,
  round(max(count(*)) over () / min(count(*)) over (), 6) as imbalance_ratio
from dirty where y is not null group by y""")
def class_balance(spark, sf_dir):
    return profile.class_balance(inputs.dirty(spark, sf_dir), "y")


@query("label_balance", """
select quality as class_value, count(*) as class_count, round(count(*) / sum(count(*)) over (), 6) as class_proportion,
  cast(sum(count(*)) over () as bigint) as total_samples,
  first_value(quality) over (order by count(*) desc, quality) as majority_class,
  first_value(quality) over (order by count(*), quality desc) as minority_class,
  round(max(count(*)) over () / min(count(*)) over (), 6) as imbalance_ratio
from labels where quality is not null group by quality""")
def label_balance(spark, sf_dir):
    return profile.class_balance(inputs.table(spark, sf_dir, "labels"), "quality")


@query("target_distribution", "select event_type as class_value, count(*) as class_count from events group by event_type")
def target_distribution(spark, sf_dir):
    return profile.target_distribution(inputs.table(spark, sf_dir, "events"), "event_type")


def _summary_sql(table, features):
    return "\nunion all\n".join(f"""
select '{f}' as feature, count({f}) as value_count, round(avg({f}), 6) as mean, round(stddev_samp({f}), 6) as std,
  round(min({f}), 6) as min, round(quantile_cont({f}, 0.25), 6) as p25, round(quantile_cont({f}, 0.5), 6) as p50,
  round(quantile_cont({f}, 0.75), 6) as p75, round(max({f}), 6) as max, count(*) - count({f}) as missing_count,
  round((count(*) - count({f})) / count(*) * 100, 6) as missing_pct, count(distinct {f}) as unique_count
from {table}""" for f in features)


@query("feature_summary", DIRTY_SQL, _summary_sql("dirty", ["v", "u", "z"]))
def feature_summary(spark, sf_dir):
    return profile.feature_summary(inputs.dirty(spark, sf_dir), ["v", "u", "z"])


@query("feature_summary_bucketed", _summary_sql("lineitem", ["l_quantity", "l_extendedprice", "l_tax"]))
def feature_summary_bucketed(spark, sf_dir):
    """The form used on large tables: value ranges spread over tasks."""
    return profile.feature_summary(
        inputs.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], rows_per_bucket=20_000)


@query("large_integer_summary", """
select 'big' as feature, count(*) as value_count, count(distinct 9007199254740993 + l_orderkey) as unique_count from lineitem""")
def large_integer_summary(spark, sf_dir):
    """Integers that share doubles are counted apart."""
    rows = inputs.table(spark, sf_dir, "lineitem").select((F.lit(9007199254740993) + F.col("l_orderkey")).alias("big"))
    return profile.feature_summary(rows, ["big"]).select("feature", "value_count", "unique_count")


@query("class_weights", FEATURES_SQL, """
select y as class_value, count(*) as class_count,
  round(sum(count(*)) over () / (count(*) over () * count(*)), 6) as class_weight from features group by y""")
def class_weights(spark, sf_dir):
    return profile.class_weights(inputs.features(spark, sf_dir), "y")


# --- splits, samples, folds ------------------------------------------------------------------

@query("stratified_split", FEATURES_SQL, split_sql("features"), "select row_id, y, split from split")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(inputs.features(spark, sf_dir), "row_id", "y").select("row_id", "y", "split")


@query("stratified_split_bucketed", FEATURES_SQL, split_sql("features"), "select row_id, y, split from split")
def stratified_split_bucketed(spark, sf_dir):
    """The form used on large tables: several rounds of prefix counts."""
    return sampling.stratified_split(inputs.features(spark, sf_dir), "row_id", "y", ranked_rows=2).select(
        "row_id", "y", "split")


@query("random_split", """
select event_id as row_id, case when row_number() over (order by md5(concat_ws('|', 42, event_id)))
  <= count(*) over () - ceil(count(*) over () * cast(0.3 as double)) then 'train' else 'test' end as split
from events""")
def random_split(spark, sf_dir):
    rows = inputs.features(spark, sf_dir).select("row_id")
    return sampling.random_split(rows, "row_id")


@query("stratified_sample", FEATURES_SQL, _SAMPLE_SQL.format(t="features", id="row_id"), "select row_id, y from sample")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(inputs.features(spark, sf_dir), "row_id", "y").select("row_id", "y")


def _random_sample_sql(n, seed):
    return f"""
select event_id as row_id from events
qualify row_number() over (order by md5(concat_ws('|', {seed}, event_id))) <= {n}"""


@query("random_sample", _random_sample_sql(200, 42))
def random_sample(spark, sf_dir):
    return sampling.stratified_sample(inputs.features(spark, sf_dir).select("row_id"), "row_id", None)


@query("eval_sample", _random_sample_sql(137, 7))
def eval_sample(spark, sf_dir):
    from scorelake.operators.scoring import evaluation_sample
    return evaluation_sample(inputs.features(spark, sf_dir), "row_id", 137, seed=7).select("row_id")


@query("shuffle_key", "select event_id as row_id, md5(concat_ws('|', 42, event_id)) as shuffle_key from events")
def shuffle_key(spark, sf_dir):
    return sampling.with_shuffle_key(inputs.features(spark, sf_dir).select("row_id"), "row_id")


def _folds_sql(order, k, table="features"):
    return f"""
laid as (select row_id, y, row_number() over (order by y, {order}) - 1 as pos,
                row_number() over (partition by y order by {order}) as rn from {table}),
sizes as (select y, pos % {k} as f, count(*) as size from laid group by 1, 2),
ends as (select y, f, sum(size) over (partition by y order by f) as last from sizes)
""", """
select l.row_id, l.y, cast(min(e.f) as integer) as fold from laid l join ends e on e.y = l.y and l.rn <= e.last
group by l.row_id, l.y"""


@query("stratified_folds", FEATURES_SQL, *_folds_sql("md5(concat_ws('|', 42, row_id))", 5))
def stratified_folds(spark, sf_dir):
    return sampling.stratified_folds(inputs.features(spark, sf_dir), "row_id", "y").select("row_id", "y", "fold")


_MANY_SQL = "many as (select row_id, cast(row_id % 150 as integer) as y from features)"


def _many(spark, sf_dir):
    """A target of 150 classes."""
    return inputs.features(spark, sf_dir).select("row_id", (F.col("row_id") % 150).cast("int").alias("y"))


@query("stratified_split_many_classes", FEATURES_SQL, _MANY_SQL, split_sql("many"), "select row_id, y, split from split")
def stratified_split_many_classes(spark, sf_dir):
    return sampling.stratified_split(_many(spark, sf_dir), "row_id", "y")


@query("stratified_folds_many_classes", FEATURES_SQL, _MANY_SQL, *_folds_sql("md5(concat_ws('|', 42, row_id))", 5, "many"))
def stratified_folds_many_classes(spark, sf_dir):
    return sampling.stratified_folds(_many(spark, sf_dir), "row_id", "y")


_PREPARED_FOLDS = _folds_sql("md5(concat_ws('|', 43, row_id))", 5, "train")


@query("prepared_folds", FEATURES_SQL, split_sql("features"), "train as (select row_id, y from split where split = 'train')",
       _PREPARED_FOLDS[0], f"""
select 'train' as split, fold, y, count(*) as total_rows from ({_PREPARED_FOLDS[1]}) f group by fold, y
union all select 'test', null, y, count(*) from split where split = 'test' group by y""")
def prepared_folds(spark, sf_dir):
    """Rows per split, fold and class as the workflow stores them: folds divide the training rows."""
    path = scratch_path(spark, "prepared")
    prepare(spark, inputs.features(spark, sf_dir), path, FEATURES, "y", "row_id")
    return spark.read.parquet(f"{path}/splits").groupBy("split", "fold", "y").agg(F.count("*").alias("total_rows"))


@query("ordered_folds", FEATURES_SQL, *_folds_sql("row_id", 3))
def ordered_folds(spark, sf_dir):
    return sampling.ordered_folds(inputs.features(spark, sf_dir), "row_id", "y", 3).select("row_id", "y", "fold")


# Ids that repeat: rows of one id lie in the order of their content. The checks list (id, class, side), so they hold for
# whatever order a check gives the rows of one id.

_USERS_SQL = "users as (select user_id as row_id, cast(case when event_type = 'purchase' then 1 else 0 end as integer) as y, event_id from events)"


def _users(spark, sf_dir):
    """Events under the id of their user."""
    return inputs.features(spark, sf_dir).select(F.col("f_user").cast("long").alias("row_id"), "y", F.col("row_id").alias("event_id"))


@query("split_dirty_rows", DIRTY_SQL, "base as (select event_id as row_id, y from dirty where y is not null)", split_sql("base"),
       "select row_id, y, split from split")
def split_dirty_rows(spark, sf_dir):
    """Repeated ids, some of equal rows and some of rows that differ in a missing value."""
    rows = inputs.dirty(spark, sf_dir).where("y is not null").withColumnRenamed("event_id", "row_id")
    return sampling.stratified_split(rows, "row_id", "y").select("row_id", "y", "split")


@query("split_repeated_ids", _USERS_SQL, split_sql("users"), "select row_id, y, split from split")
def split_repeated_ids(spark, sf_dir):
    return sampling.stratified_split(_users(spark, sf_dir), "row_id", "y", ranked_rows=20).select("row_id", "y", "split")


@query("split_lines", """
select l_orderkey as row_id, case when row_number() over (order by md5(concat_ws('|', 42, l_orderkey)))
  <= count(*) over () - ceil(count(*) over () * cast(0.3 as double)) then 'train' else 'test' end as split from lineitem""")
def split_lines(spark, sf_dir):
    """All lines under their order's key."""
    lines = inputs.table(spark, sf_dir, "lineitem")
    return sampling.random_split(lines, "l_orderkey").select(F.col("l_orderkey").alias("row_id"), "split")


@query("sample_repeated_ids", _USERS_SQL, _SAMPLE_SQL.format(t="users", id="event_id").replace("|', 42, event_id", "|', 42, row_id"),
       "select row_id, y from sample")
def sample_repeated_ids(spark, sf_dir):
    return sampling.stratified_sample(_users(spark, sf_dir), "row_id", "y").select("row_id", "y")


def _repeated_folds_sql(order, k):
    return _folds_sql(order, k, "users")[0], """
select l.row_id, l.y, cast(min(e.f) as integer) as fold from laid l join ends e on e.y = l.y and l.rn <= e.last
group by l.row_id, l.y, l.rn"""


@query("folds_repeated_ids", _USERS_SQL, *_repeated_folds_sql("md5(concat_ws('|', 42, row_id))", 5))
def folds_repeated_ids(spark, sf_dir):
    return sampling.stratified_folds(_users(spark, sf_dir), "row_id", "y").select("row_id", "y", "fold")


@query("ordered_folds_repeated_ids", _USERS_SQL, *_repeated_folds_sql("row_id", 3))
def ordered_folds_repeated_ids(spark, sf_dir):
    return sampling.ordered_folds(_users(spark, sf_dir), "row_id", "y", 3, ranked_rows=5).select("row_id", "y", "fold")


@query("split_summary", FEATURES_SQL, split_sql("features"), _BALANCE_SQL, """
select split, class_value, class_count, class_proportion, total_samples, majority_class, minority_class,
  imbalance_ratio, 4 as n_features from balance""")
def split_summary(spark, sf_dir):
    split = sampling.stratified_split(inputs.features(spark, sf_dir), "row_id", "y")
    return sampling.split_summary(split, "y", len(FEATURES))
