"""``start`` is the place in the files, whatever the ids."""

import zlib

import numpy as np
import public_tokenizers as P

from scorelake.llm import tokenfiles

JSON = P.path("byte_bpe_50k.json")


def test_start_is_the_place_in_the_files(spark, tmp_path):
    rows = [(1, "x"), (5, "z"), (5, "a a a a a a"), (7, "q"), (None, "n"), (None, "n n"), (5, None)] + [(5, "same row")] * 40 + [
        (6, f"word {k}") for k in range(30)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, place string, `a.b` string").repartition(4)
    path = f"file://{tmp_path}/t"
    tokenfiles.write(frame, path, JSON, parts=5)
    files = spark.read.parquet(path)
    held = files.orderBy("part", "place").collect()
    assert [r.doc_id for r in held] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert max(sum(r.part == p for r in held) for p in range(5)) < 50          # equal rows are spread over parts
    whole = np.concatenate([np.array(r.tokens, "<u4") for r in held])
    found = tokenfiles.read(files).collect()
    assert len(found) == len(rows) and sum(r.n_tokens for r in found) == len(whole)
    assert all(zlib.crc32(whole[r.start:r.start + r.n_tokens]) == r.ids_crc32 for r in found)
    assert sorted(r.start for r in found) == np.cumsum([0, *(len(r.tokens) for r in held[:-1])]).tolist()
    assert tokenfiles.roundtrip(frame, JSON).count() == len(rows)
