"""Stand-in tables derived from the given ones: features, predictions, dirty rows, answers, importance.

Every table exists twice: as a Spark DataFrame and as the SQL text the checks start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["f_value", "f_user", "f_hour", "f_k"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_purchase():
    return F.when(F.col("event_type") == "purchase", 1).otherwise(0)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; label: is it a purchase."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("value").alias("f_value"),
        F.col("user_id").cast("double").alias("f_user"),
        F.hour("ts").cast("double").alias("f_hour"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("f_k"),
        _is_purchase().alias("y"))


FEATURES_SQL = """
features as (
  select event_id as row_id, value as f_value, cast(user_id as double) as f_user,
         cast(extract(hour from ts) as double) as f_hour,
         cast(regexp_extract(props, '([0-9]+)', 1) as double) as f_k,
         cast(case when event_type = 'purchase' then 1 else 0 end as integer) as y
  from events)
"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same features with a label that depends on them, for models to learn."""
    signal = F.col("f_value") + (F.col("row_id") * 7919) % 40
    return features(spark, sf_dir).withColumn("y", F.when(signal > 80, 1).otherwise(0))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models over all events, with ties, nulls (m3) and a perfect model (m1)."""
    models = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(a).alias("a"), F.lit(k).alias("k"))
        for m, a, k in (("m1", 7919, 1), ("m2", 104729, 3), ("m3", 1299709, 9))])
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), _is_purchase().alias("y"), F.explode(models).alias("m"))
    level = (F.col("row_id") * F.col("m.a")) % 1000 * F.col("m.k") + 1000 * F.col("y")
    unanswered = (F.col("m.model") == "m3") & ((F.col("row_id") * 31) % 50 == 0)
    return rows.select(
        "m.model", "row_id", "y",
        F.when(~unanswered, F.when(level >= (F.col("m.k") + 1) * 500, 1).otherwise(0)).alias("pred"),
        (level.cast("double") / ((F.col("m.k") + 1) * 1000).cast("double")).alias("score"))


PREDICTIONS_SQL = """
predictions as (
  select m.model, e.event_id as row_id,
    cast(case when e.event_type = 'purchase' then 1 else 0 end as integer) as y,
    case when m.model = 'm3' and (e.event_id * 31) % 50 = 0 then null
         else cast(case when ((e.event_id * m.a) % 1000) * m.k
                             + 1000 * (case when e.event_type = 'purchase' then 1 else 0 end)
                             >= (m.k + 1) * 500 then 1 else 0 end as integer) end as pred,
    cast(((e.event_id * m.a) % 1000) * m.k
         + 1000 * (case when e.event_type = 'purchase' then 1 else 0 end) as double)
      / cast((m.k + 1) * 1000 as double) as score
  from events e cross join (select 'm1' as model, 7919 as a, 1 as k union all select 'm2', 104729, 3
                            union all select 'm3', 1299709, 9) m)
"""


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values (null and NaN), an empty column and duplicate rows."""
    events = table(spark, sf_dir, "events")

    def rows(df: DataFrame) -> DataFrame:
        e = F.col("event_id")
        return df.select(
            "event_id",
            F.when(e % 9 == 0, F.lit(float("nan")) if df is not events else F.lit(None))
            .otherwise(F.col("value")).alias("v"),
            F.when(e % 20 != 0, F.col("user_id").cast("double")).alias("u"),
            F.lit(None).cast("double").alias("z"),
            F.when(e % 100 != 0, _is_purchase()).alias("y"))

    return rows(events).unionByName(rows(events.where(F.col("event_id") % 50 == 0)))


DIRTY_SQL = """
dirty_once as (
  select event_id, case when event_id % 9 = 0 then null else value end as v,
    case when event_id % 20 = 0 then null else cast(user_id as double) end as u, cast(null as double) as z,
    case when event_id % 100 = 0 then null
         else cast(case when event_type = 'purchase' then 1 else 0 end as integer) end as y
  from events),
dirty as (select * from dirty_once union all select * from dirty_once where event_id % 50 = 0)
"""

# Example answers, one per parsing rule.
ANSWERS = ["0", " 1 ", "Poor Health", "unhealthy", "10", "0 or 1", "cannot tell", "class 12", "", None]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of one model for every event."""
    texts = F.array(*[F.lit(a) for a in ANSWERS])
    return table(spark, sf_dir, "events").select(
        F.lit("reader").alias("model"), F.col("event_id").alias("row_id"), _is_purchase().alias("y"),
        texts[(F.col("event_id") % 10).cast("int")].alias("raw"))


ANSWERS_SQL = """
answers as (
  select 'reader' as model, event_id as row_id,
    cast(case when event_type = 'purchase' then 1 else 0 end as integer) as y,
    case cast(event_id % 10 as integer) when 0 then '0' when 1 then ' 1 ' when 2 then 'Poor Health'
      when 3 then 'unhealthy' when 4 then '10' when 5 then '0 or 1' when 6 then 'cannot tell'
      when 7 then 'class 12' when 8 then '' end as raw
  from events)
"""


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An importance table of the usual shape: mean value per event type ("model") and property ("feature")."""
    return table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("model"),
        F.concat(F.lit("k"), F.regexp_extract("props", r"(\d+)", 1)).alias("feature"),
    ).agg(F.round(F.avg("value"), 6).alias("importance"))


IMPORTANCE_SQL = """
importance as (
  select event_type as model, 'k' || regexp_extract(props, '([0-9]+)', 1) as feature,
         round(avg(value), 6) as importance
  from events group by 1, 2)
"""
