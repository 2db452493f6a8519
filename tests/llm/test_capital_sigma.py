import brute

from scorelake.llm import decontam


def test_copies_with_capital_sigma_are_found(spark):
    items = [(1, "Δ.Ε.Σ. ΟΔΟΣ.ΑΘΗΝΑ x"), (2, "ΟΔΟΣ'S one two three ΛΟΓΟΣ:ΠΕΡΙ four five ΦΩΣ seven"), (3, "İstanbul Σ ΑΣ.Β")]
    texts = [(1, "before Δ.Ε.Σ. ΟΔΟΣ.ΑΘΗΝΑ X after"), (2, "so ΟΔΟΣ's One Two Three ΛΟΓΟΣ:ΠΕΡΙ four five ΦΩΣ Seven."),
             (3, "δ.ε.ς. οδος.αθηνα x"), (4, "an İstanbul Σ ΑΣ.Β b")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    found = decontam.report(decontam.find(frame, spark.createDataFrame(items, "item_id long, text string")))
    want = [(i, *brute.contamination(t, items)) for i, t in texts]
    assert sorted(map(tuple, found.collect())) == want and [w[-1] for w in want] == [True, True, False, True]
