"""Stages that filter or rewrite rows: any column names, tied rows, no rows."""

import pytest
from pyspark.sql import functions as F

from scorelake.llm import decontam, pii, simhash, toxicity

NAMES = ["__id", "__class", "__found", "__spans", "__th", "__n_hit", "a.b", "row", "id", "key", "class", "spans", "kept_id", "digest", "x y"]
SENTENCE = "the quick brown fox jumps over the lazy dog near the old river bank today"
ROWS = [(1, f"first {SENTENCE}"), (2, f"first {SENTENCE}"), (3, "mail me at some.one@example.com or call"), (4, None), (5, ""),
        (None, "a row without an id"), (6, "one two three four five six seven eight nine ten eleven twelve")]


@pytest.fixture(scope="module")
def docs(spark):
    shape = "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *(f"{n}{k}" for n in NAMES)) for k, r in enumerate(ROWS)], shape).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(9, "two three four five six seven eight nine ten eleven", "x")], "item_id long, text string, `a.b` string")


@pytest.fixture(scope="module")
def stages(spark, items, sf_dir):
    learned = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return {"simhash": simhash.keep_one, "decontam": lambda d: decontam.keep_clean(d, items), "pii": pii.redact,
            "toxicity": lambda d: toxicity.keep_clean(d, labels) if d.limit(1).count() == 0 else
            toxicity.keep_clean(d.union(learned.select("doc_id", "text", *[F.lit(None).cast("string") for _ in NAMES])), labels)}


def test_rows_come_back_whole(docs, stages):
    before = {r.doc_id: r for r in docs.collect()}
    lost = {"simhash": {2, 5}, "decontam": {6}, "pii": set()}
    for name in lost:
        after = stages[name](docs)
        assert after.columns == docs.columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        found = {r.doc_id: r for r in after.collect()}
        assert found.keys() == before.keys() - lost[name]
        for i, r in found.items():
            assert tuple(r)[2:] == tuple(before[i])[2:]
            assert r.text == ("mail me at [EMAIL] or call" if name == "pii" and i == 3 else before[i].text)
    toxic = stages["toxicity"](docs)
    assert toxic.columns == docs.columns and {r.doc_id for r in toxic.where(F.col("__id").isNotNull()).collect()} == before.keys()


def test_no_rows(docs, stages):
    for name, stage in stages.items():
        none = stage(docs.where("false"))
        assert none.columns == docs.columns and none.count() == 0, name


def test_tied_rows_are_chosen_by_content(spark):
    rows = [(7, "same text of this row", x, y) for x, y in (("A", None), ("B", 1.0), ("A", 2.0), ("C", None))]
    kept = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        for parts in (1, 3):
            frame = spark.createDataFrame(order, "doc_id long, text string, source string, `n.x` double").repartition(parts)
            kept.add(tuple(map(tuple, simhash.keep_one(frame).collect())))
    assert len(kept) == 1 and len(next(iter(kept))) == 1
