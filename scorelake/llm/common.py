"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorelake.functions.missing import col
from scorelake.session import scratch_path

# Bytes that part words of the licence and decontamination contracts (ASCII except letters and digits).
_PARTING = [b for b in range(128) if not chr(b).isalnum()]
ALNUM_WORDS = bytes.maketrans(bytes(_PARTING) + bytes(range(65, 91)), b" " * len(_PARTING) + bytes(range(97, 123)))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared scratch folder and read it from there: later steps survive a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns under names of our own, and all columns in a struct ``row``: whatever they are called, they can't
    clash with columns that an operator adds. ``select("row.*")`` gives them back."""
    return docs.select(*[col(name).alias(own) for own, name in wanted.items()], F.struct(*map(col, docs.columns)).alias("row"))


def text_bytes(column: str) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(col(column).cast("string"), F.lit("")).cast("binary")


def text_of(column: str) -> Column:
    return F.coalesce(col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that, and faster, where every character takes one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def map_batches(df: DataFrame, schema: str | StructType, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch],
                rows: int = 512) -> DataFrame:
    """Apply ``work`` to slices of at most ``rows`` rows inside the tasks, so that results stay small in memory."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = work(batch.slice(start, rows))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
    return df.mapInArrow(run, schema)


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``row_number`` (from 1) in the given order. Rows are parted by range, equal ones by a salt; a row's number is its
    place in its part plus the rows of the parts before, one count each."""
    spread = rows.withColumn("salt", F.rand(1)).repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = stored(spread.select(*rows.columns, F.spark_partition_id().alias("part"), inside.alias("inside")), name)
    before = (spread.groupBy("part").agg(F.count("*").alias("n"))
              .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    return spread.join(before, "part").select(*rows.columns, (F.col("before") + F.col("inside") + 1).alias("row_number"))
