import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from texts import TEXTS  # noqa: E402

# Names that the operators use for columns of their own.
EXTRA = ("id", "raw", "h", "spans", "fp", "words", "part", "n", "found", "y", "item", "shard", "kind")


@pytest.fixture(scope="session")
def docs(spark):
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          *(T.StructField(name, T.StringType()) for name in EXTRA)])
    return spark.createDataFrame([(i, t, *["x"] * len(EXTRA)) for i, t in TEXTS], shape).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
