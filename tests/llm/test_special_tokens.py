import brute
import public_tokenizers as P
from tokenizers import Tokenizer

from scorelake.llm import tokenfiles

JSON = P.path("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [f"end {END} next", f" {END}", f"{END}{END} a  b", f" x{END}y z", f"one\n{END}  two ", "plain words here", f" word {END}",
         " <|endoftext |> <|endoftext", f"é {END}é 　{END}"] * 3


def test_special_tokens_get_their_ids(spark):
    tokenizer = Tokenizer.from_file(JSON)
    want, start = [], 0
    for k, text in enumerate(TEXTS):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        want.append((k, start, len(ids), brute.crc(ids)))
        start += len(ids)
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, tokenfiles.roundtrip(frame, JSON).collect())) == want


def test_special_tokens_as_text(spark, tmp_path):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    tokenfiles.write(frame, f"file://{tmp_path}/t", JSON, special_as_text=True)
    got = {r.doc_id: r.tokens for r in spark.read.parquet(f"file://{tmp_path}/t").collect()}
    assert got == {k: tokenizer.encode(t, add_special_tokens=False).ids + [0] for k, t in enumerate(TEXTS)}
