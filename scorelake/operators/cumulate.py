"""Running totals along an ordered value, without sending a whole group to one task.

A plain ``sum().over(partitionBy(group).orderBy(value))`` sorts a group in a single task, and two
models (or a handful of features) then occupy a handful of tasks however large the cluster is. Here
equal values are merged, the merged rows are parted by range of (group, value) and stored with the number of their part;
the window runs per (group, part), and the totals of the earlier parts of the group are added from a table with one row
per (group, part). Where the parts are cut is Spark's range partitioner's business: neither the plan nor the driver holds cuts.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.session import scratch_path

ROWS_PER_BUCKET = 1_000_000     # the number of parts has no limit


def ordered_totals(rows: DataFrame, group: Sequence[str], value: str, weights: Mapping[str, Column],
                   descending: bool = False, row_count: int | None = None,
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per (group, distinct value) with totals and running totals of every weight.

    ``rows`` holds raw rows; ``value`` must be a double without null or NaN. ``weights`` maps a name
    to an aggregate that adds up over values (``F.sum(...)``, ``F.count(...)``). Result: ``group``, ``value``, and per weight
    ``<w>`` (this value), ``<w>_upto`` (this value and all before it) and ``<w>_total`` (the group).

    Equal values are merged before the shuffle, so a value shared by a third of all rows costs one
    row per task. The number of parts grows with the row count (``row_count``, an upper bound will do).
    """
    group = list(group)
    n = rows.count() if row_count is None else row_count
    parts = math.ceil(n / rows_per_bucket)
    order = F.col(value).desc() if descending else F.col(value).asc()
    merged = rows.groupBy(*group, value).agg(*[agg.alias(w) for w, agg in weights.items()])
    whole = Window.partitionBy(*group)
    if parts <= 1:
        upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return merged.select(
            "*",
            *[F.sum(w).over(upto).alias(f"{w}_upto") for w in weights],
            *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights],
        )

    path = scratch_path(rows.sparkSession, "ordered")
    spread = merged.repartitionByRange(parts, *group, order)
    spread.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    # Read again, so that parts are what they were even if a task has to be run again.
    parted = rows.sparkSession.read.parquet(path)
    by_part = [*group, "_part"]
    within = Window.partitionBy(*by_part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy(*by_part).agg(*[F.sum(w).alias(w) for w in weights])
        .select(
            *by_part,
            *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_{w}_before") for w in weights],
            *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights],
        )
    )
    hist = parted.select("*", *[F.sum(w).over(within).alias(f"_{w}_in") for w in weights])
    # No broadcast hint: both sides end up partitioned by (group, part), and adaptive execution broadcasts only when it fits.
    return hist.join(offsets, by_part).select(
        *group, value, *weights,
        *[(F.col(f"_{w}_in") + F.col(f"_{w}_before")).alias(f"{w}_upto") for w in weights],
        *[f"{w}_total" for w in weights],
    )
