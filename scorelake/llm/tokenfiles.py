"""Token-id files: Parquet with one list of ids per document, in document order, readable by column and by page.

``write`` encodes whole texts with a byte-level tokeniser of the tokenizers library, ends each document with an end id
and writes ascending document ids. Ids are dictionary-encoded (a vocabulary fits one dictionary page, so a value costs
two bytes at most before compression), document ids and counts are delta-encoded; row groups and pages have a set size,
and every file carries page indexes. So a reader that wants counts or a range of documents skips the token pages.

``read`` returns, from the files, each document's place in the whole sequence of ids. Only two numbers per document
are shuffled for it, and only one row per part is summed in one task.

Defined cases: a null or empty text has the end id alone; a special token written out in a text gets its own id; null document ids come first; rows with equal ids lie in the order
of a digest of their texts; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.missing import col
from scorelake.llm.chunks import Pieces, joined
from scorelake.llm.common import map_batches, text_of
from scorelake.session import scratch_path

FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",                         # delta encoding for whole numbers
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}
PART_BYTES = 64 << 20

_workers: dict[tuple[str, bool], Pieces] = {}


def tokenizer_pieces(path: str, special_as_text: bool = False) -> Pieces:
    """The worker's cache over the tokeniser at ``path``. Added tokens written out in a text get their own ids, as by the
    library's plain call; with ``special_as_text`` special ones are ordinary text."""
    if (path, special_as_text) not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = special_as_text
        added = [x.content for x in tokenizer.get_added_tokens_decoder().values() if not (special_as_text and x.special)]
        byte_lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, number in tokenizer.get_vocab().items():
            byte_lengths[number] = len(token)               # one character stands for one byte

        def encode_all(texts):
            return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def encode(texts):
            plain = np.array([len(t) > 1 and t[0] == " " and not t[1].isspace() for t in texts])
            for literal in added:               # only texts that are one piece can hold one
                plain &= ~pc.match_substring(pa.array(texts, pa.large_string()), literal).to_numpy(zero_copy_only=False)
            ids, lengths = [], np.zeros(len(texts), np.int64)
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            if plain.any():
                some, lengths[plain] = joined([texts[k] for k in np.flatnonzero(plain)], encode_all, byte_lengths)
                ids.append(some)
            if not plain.all():
                rest = encode_all([texts[k] for k in np.flatnonzero(~plain)])
                lengths[~plain] = [len(x) for x in rest]
                ids.append(np.fromiter(chain.from_iterable(rest), np.int32))
            flat, sizes = np.concatenate(ids), lengths[order]
            starts = np.zeros(len(texts), np.int64)
            starts[order] = np.cumsum(sizes) - sizes
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            return flat[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)], lengths

        _workers[path, special_as_text] = Pieces(encode, literals=added)
    return _workers[path, special_as_text]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
          parts: int | None = None, special_as_text: bool = False) -> None:
    """Write ``part, place, doc_id, n_tokens, tokens``; part k holds smaller documents than part k + 1, ``place`` counts the
    rows of a part in file order. The salt spreads rows with one id and text over parts."""
    chosen = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    order = ["id", "digest", "salt"]
    keyed = chosen.withColumn("digest", F.xxhash64("text")).withColumn("salt", F.rand(1))
    ordered = (keyed.repartitionByRange(parts, *order) if parts else keyed.repartitionByRange(*order)).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.select(F.spark_partition_id().alias("part"), place.alias("place"), "id", "text")
    id_type = chosen.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = tokenizer_pieces(tokenizer, special_as_text).tokens(batch.column(3))
        ends = np.cumsum(counts + 1)
        values = np.full(int(ends[-1]), end_id, np.int32)
        inside = np.ones(len(values), bool)
        inside[ends - 1] = False
        values[inside] = ids
        tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts + 1), tokens],
                                          ["part", "place", "id", "n_tokens", "tokens"])

    encoded = map_batches(ordered, f"part int, place long, id {id_type}, n_tokens long, tokens array<int>", work)
    encoded.withColumnRenamed("id", id_col).write.options(**FILE_OPTIONS).parquet(path)


def read_counts(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, id, n_tokens`` alone: the token pages are not read."""
    return files.select("part", col(id_col), "n_tokens")


def read(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: ``start`` (ids of all documents before it in the files), ``n_tokens`` and the checksum of its ids."""
    id_type = files.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        edges = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.diff(edges).astype(np.int64)), pa.array(sums, pa.int64())],
            ["part", "place", "id", "n_tokens", "ids_crc32"])

    rows = map_batches(files.select("part", "place", col(id_col).alias("id"), "tokens"),
                       f"part int, place long, id {id_type}, n_tokens long, ids_crc32 long", work)
    ordered = Window.partitionBy("part").orderBy("place")
    before = (read_counts(files, id_col).groupBy("part").agg(F.sum("n_tokens").alias("total"))
              .withColumn("before", F.sum("total").over(Window.orderBy("part")) - F.col("total")).drop("total"))
    return (rows.withColumn("inside", F.sum("n_tokens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
            .join(before, "part")
            .select(F.col("id").alias(id_col), (F.col("before") + F.col("inside") - F.col("n_tokens")).alias("start"),
                    "n_tokens", "ids_crc32"))


def roundtrip(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files into the shared scratch folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    files = docs.sparkSession.read.schema(f"part int, place long, {id_col} {id_type}, n_tokens long, tokens array<int>").parquet(path)
    return read(files, id_col)
