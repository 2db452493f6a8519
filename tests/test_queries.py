"""Every query with SQL gives the same rows, types and column names in both engines."""

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, db, name):
    df = entry_module.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = db.sql(entry_module.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    assert [TYPES[df.schema[c].dataType.simpleString()] for c in columns] == [str(rel.types[i]) for i in places]
    expected = [tuple(r[i] for i in places) for r in rel.fetchall()]
    assert _sorted(tuple(r) for r in df.select(columns).collect()) == _sorted(expected)


def test_sql_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    row = entry_module.entry(spark).first()
    assert row["model"] == "LogisticRegression" and row["valid"] == 300 and row["auc_roc"] > 0.9
