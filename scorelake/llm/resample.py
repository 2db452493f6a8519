"""Importance resampling towards a target: hashed word-run features, bucket gains, Gumbel top draw.

Features are all runs of 1 to ``longest`` words (A-Z lower-cased), each hashed by CRC-32 into ``buckets``. A first pass
counts words and pairs over all rows of the corpus and of the target; the most frequent ones form the head: exact CRC states
of words and buckets of pairs, broadcast because its size is bounded (``HEAD`` entries of at most ``HEAD_BYTES`` bytes). A
task looks its features up there; features of the tail get their CRC directly, longer runs by continuing the state of the
run without its last word. Both ways give the same number, so bucket totals are exact whatever the head is.

Bucket totals are one partial count per task and bucket. The gains (one number per bucket) are small by construction. Ranks
come from range-partitioned rows: places within a partition, plus the counts of the partitions before it.

Defined cases: a null text has no words; a document without features has weight 0; an empty corpus gives no rows, an empty
target leaves every t at 0; a null id hashes like an empty one and comes last among ties, rows with equal ids are then
ordered by weight and number of features; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.missing import col
from scorelake.llm.common import ALNUM_WORDS, map_batches, numbered, stored, text_bytes

BUCKETS = 10_000
HEAD, HEAD_BYTES = 50_000, 48         # entries of each head table, bytes of a word or pair in it
SHARE, LEAST_WORDS, SEED = 10, 20, 2024
NEW = 200_000                         # distinct tail features that a worker remembers


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(ALNUM_WORDS).split()


def head(texts: list[DataFrame], longest: int = 1, size: int = HEAD) -> dict[bytes, int]:
    """CRC-32 of the most frequent words, and of the most frequent pairs where runs of two count."""
    widths = range(1, min(longest, 2) + 1)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter[bytes]] = {n: Counter() for n in widths}
        for raw in batch.column(0).to_pylist():
            words = words_of(raw)
            for n in widths:
                found[n].update(words if n == 1 else map(b" ".join, zip(words, words[1:], strict=False)))
        for n, times in found.items():
            kept = {x: c for x, c in times.items() if len(x) <= HEAD_BYTES}
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(kept), pa.int32()), pa.array(kept, pa.binary()),
                                              pa.array(kept.values(), pa.int64())], ["n", "run", "times"])

    raw = texts[0]
    for more in texts[1:]:
        raw = raw.unionByName(more)
    counted = map_batches(raw, "n int, run binary, times long", work, 4096).groupBy("n", "run").agg(F.sum("times").alias("times"))
    counted = stored(counted, "run-counts")
    # A bounded vocabulary, not a cut of the work: whatever isn't in it is hashed directly.
    chosen = [counted.where(F.col("n") == n).orderBy(F.desc("times"), "run").limit(size) for n in widths]
    return {bytes(r["run"]): zlib.crc32(r["run"]) for part in chosen for r in part.select("run").collect()}


def features(docs: DataFrame, known: dict[bytes, int], longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``id, n_words, found`` (the bucket of every feature, repeats included)."""
    chosen = docs.select(col(id_col).alias("id"), text_bytes(text_col).alias("raw"))
    id_type = chosen.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(known)
    tail: dict[bytes, int] = {}

    def state(run: list[bytes], text: bytes) -> int:
        """CRC state of a run: from the head, else its last word continued from the run before it."""
        value = shared.value.get(text)
        if value is None:
            value = tail.get(text)
        if value is None:
            value = zlib.crc32(b" " + run[-1], state(run[:-1], text[:-len(run[-1]) - 1])) if len(run) > 1 else zlib.crc32(text)
            if len(text) <= HEAD_BYTES:
                if len(tail) >= NEW:
                    tail.clear()
                tail[text] = value
        return value

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, n_words, sizes = [], [], []
        table = shared.value
        for raw in batch.column(1).to_pylist():
            words = words_of(raw)
            own = [table[w] if w in table else state([w], w) for w in words]
            for n in range(2, longest + 1):
                own += [state(list(run), b" ".join(run)) for run in zip(*(words[k:] for k in range(n)), strict=False)]
            values.append(np.array(own, np.int64) % buckets)
            n_words.append(len(words))
            sizes.append(len(own))
        edges = np.cumsum([0, *sizes]).astype(np.int32)
        flat = np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(edges, flat)],
                                          ["id", "n_words", "found"])

    return map_batches(chosen, f"id {id_type}, n_words long, found array<int>", work)


def totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            count += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], ["bucket", "n"])

    sums = found.select("found").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():                                         # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of the smoothed bucket shares."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def scores(found: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``id, n_words, n_features, weight, score``."""
    id_type = found.schema["id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = found.withColumn("h", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2)
        edges = lists.offsets.to_numpy()
        upto = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])])
        sizes = np.diff(edges).astype(np.int64)
        places = edges - edges[0]
        weight = (upto[places[1:]] - upto[places[:-1]]) // np.maximum(sizes, 1)
        noise = [math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0))) for h in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes), pa.array(weight), pa.array(weight + np.array(noise, np.int64))],
            ["id", "n_words", "n_features", "weight", "score"])

    return map_batches(drawn.select("id", "n_words", "found", "h"),
                       f"id {id_type}, n_words long, n_features long, weight long, score long", work)


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, share: int = SHARE,
             least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text", head_size: int = HEAD) -> DataFrame:
    """Every document's ``id, n_features, weight, score, rank``: of the documents with at least ``least_words`` words the
    ``share`` per cent with the highest scores get ranks from 1, others null."""
    known = head([docs.select(text_bytes(text_col).alias("raw")), target.select(text_bytes(target_text).alias("raw"))],
                 longest, head_size)
    own = stored(features(docs, known, longest, buckets, id_col, text_col), "features")
    aim = features(target.withColumn("__target_row", F.lit(0)), known, longest, buckets, "__target_row", target_text)
    scored = scores(own, gains(totals(own, buckets), totals(aim, buckets)), seed)
    asked = scored.withColumn("out", F.col("n_words") < least_words)
    ranked = numbered(asked, [F.col("out"), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight"),
                              F.col("n_features")], "scores")
    most = ranked.where(~F.col("out")).count() * share // 100
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score",
                         F.when(~F.col("out") & (F.col("row_number") <= most), F.col("row_number")).alias("rank"))
