from pyspark.sql import functions as F

from scorelake.llm import pii


def test_long_secrets_go_whole(spark):
    secrets = ["Ab3" * n for n in (10, 85, 86, 120, 2000)]                 # 30 to 6000 characters
    rows = [(k, f"the api_key = {s} is set") for k, s in enumerate(secrets)] + [(9, "token: " + "a" * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.report(frame.where("doc_id < 9")).collect()}
    assert all(f"secret:14:{14 + len(s)}" in found[k].split(",") for k, s in enumerate(secrets))
    assert {r.text for r in pii.redact(frame.where("doc_id < 9")).collect()} == {"the api_key = [SECRET] is set"}
    span = pii.label(frame.where("doc_id = 9")).select(F.explode("spans").alias("s")).where("s.kind = 'secret'").first().s
    assert (span.start, span.end, span.votes[1]) == (7, 300_007, -1)       # no digit, found in one pass
