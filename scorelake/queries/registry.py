"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits: the order of a sum changes the last bits."""
    return df.select([
        (F.round(F.col(f.name), 6) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema])


def query(name: str, *sql: str) -> Callable[[Query], Query]:
    """Register ``name``; ``sql`` holds common table expressions and, last, the select statement."""
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            *tables, select = sql
            ORACLES[name] = ("with " + ",".join(tables) if tables else "") + "\n" + select.strip()
        return fn
    return add
