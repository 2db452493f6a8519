import brute

from scorelake.llm import simhash

WORDS = "amber brook cedar delta ember frost grove heron inlet jade kelp lark moss north opal pine quartz reed slate tide".split()


def text(k):
    return " ".join(WORDS[(k * j * j + k + j) % len(WORDS)] + str(k) for j in range(30))


def test_each_class_keeps_a_row(spark):
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (7, text(5)),
            (8, text(5)), (9, text(1)), (10, text(6)), (11, text(6)), (7, None), (None, "")]
    assert len({brute.simhash(t) for _, t in rows}) == len(set(brute.classes([brute.simhash(t) for _, t in rows]))) == 7
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns and kept.schema["doc_id"].dataType == frame.schema["doc_id"].dataType
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(9, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (10, text(6)), (7, None)], key=repr)
