"""Quality rules with tokeniser fertility: characters per token, byte-fallback share and token entropy.

``measure`` encodes every whole text with a public vocabulary and counts. A byte-fallback token is a single byte of a
character that takes several. ``bands`` takes robust bands per script and length class (powers of four of the number of
tokens: entropy falls with length) over all measured texts that pass the base rules: quartiles widened by ``WIDTH``
quartile distances and at least ``SLACK``. A group of fewer than ``LEAST`` texts sets no band. There are at most scripts
x 16 groups, whatever the corpus.

Defined cases: a null or empty text has no words, so it fails the base rules; its measures are 0; repeated rows each get
their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.bpe import read_ranks
from scorelake.llm.chunks import Pieces
from scorelake.llm.common import map_batches, stored, text_of
from scorelake.llm.textstats import base_counts, script

LEAST_WORDS = 50
REPEAT_PERCENT = 50
WIDTH = 6.0
LEAST = 50
SLACK = {"chars_per_token": 0.5, "fallback_share": 0.1, "entropy": 0.1}

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
            "n_tokens long, chars_per_token double, fallback_share double, entropy double")

_workers: dict[tuple[str, str], tuple[Pieces, np.ndarray]] = {}


def _tokeniser(path: str, pattern: str) -> tuple[Pieces, np.ndarray]:
    """The worker's cache, and which ids are byte fallbacks."""
    if (path, pattern) not in _workers:
        import tiktoken

        ranks = read_ranks(path)
        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(pieces):
            each = [encoding.encode_ordinary(piece) for piece in pieces]
            return np.fromiter((i for x in each for i in x), np.int32), np.array([len(x) for x in each], np.int64)

        fallback = np.zeros(max(ranks.values()) + 1, bool)
        fallback[[ranks[bytes([b])] for b in range(128, 256)]] = True
        _workers[path, pattern] = Pieces(encode), fallback
    return _workers[path, pattern]


def _entropies(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entropy of the ids of each text over the largest that so many ids can have (0 for fewer than two)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    keys, seen = np.unique(owner << 32 | ids.astype(np.int64), return_counts=True)
    share = seen / counts[keys >> 32]
    total = np.bincount(keys >> 32, -share * np.log2(share), minlength=len(counts))
    return np.where(counts > 1, total / np.log2(np.maximum(counts, 2)), 0.0)


def measure(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    chosen = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    names = [part.split()[0] for part in MEASURES.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces, fallback = _tokeniser(path, pattern)
        texts = batch.column(1).to_pylist()
        ids, counts = pieces.tokens(batch.column(1))
        edges = np.concatenate([[0], np.cumsum(counts)])
        falls = np.diff(np.concatenate([[0], np.cumsum(fallback[ids])])[edges])
        base = [base_counts(text, raw, raw.split()) for text, raw in ((t, t.encode()) for t in texts)]
        most = np.maximum(counts, 1)
        lengths = np.array([len(t) for t in texts], np.float64)
        columns = [*(pa.array(c, pa.int64()) for c in zip(*base, strict=True)), pa.array([script(t) for t in texts]),
                   pa.array(counts), pa.array(lengths / most), pa.array(falls / most), pa.array(_entropies(ids, counts))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    return map_batches(chosen, f"id {chosen.schema['id'].dataType.simpleString()}, {MEASURES}", work)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _length_class():
    return F.least(F.lit(15), F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) / 2)).cast("int")


def bands(measured: DataFrame, width: float = WIDTH, least: int = LEAST) -> DataFrame:
    """Lower and upper bound of each measure per script and length class."""
    good = measured.where(~base_failed()).groupBy("script", _length_class().alias("length_class")).agg(
        F.count("*").alias("texts"), *[F.percentile_approx(name, [0.25, 0.75], 10_000).alias(name) for name in SLACK])
    bounds = []
    for name, slack in SLACK.items():
        low, high = F.get(name, F.lit(0)), F.get(name, F.lit(1))
        room = F.greatest(width * (high - low), F.lit(slack))
        bounds += [(low - room).alias(f"{name}_low"), (high + room).alias(f"{name}_high")]
    return good.where(F.col("texts") >= least).select("script", "length_class", *bounds)


def judge(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", width: float = WIDTH,
          least: int = LEAST) -> DataFrame:
    """Measures, ``base_failed``, ``reasons`` (measures outside their band) and ``kept``."""
    measured = stored(measure(docs, path, pattern, id_col, text_col), "fertility")
    limits = bands(measured, width, least)
    joined = measured.withColumn("length_class", _length_class()).join(F.broadcast(limits), ["script", "length_class"], "left")
    outside = [F.when((F.col(name) < F.col(f"{name}_low")) | (F.col(name) > F.col(f"{name}_high")), name) for name in SLACK]
    names = [part.split()[0] for part in MEASURES.split(", ")]
    return joined.select(F.col("id").alias(id_col), *names, base_failed().alias("base_failed"), F.array_compact(F.array(*outside)).alias("reasons")
                         ).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
