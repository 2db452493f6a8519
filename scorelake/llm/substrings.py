"""Substring dedup: suffix automata of reference passages, documents streamed through them.

A window is ``WINDOW`` consecutive words. Its words go from a document when the same window starts in a document with a
smaller id. Texts meet the automata in these steps, none of which needs more than narrow rows of what isn't shared:

1. Texts with equal words form a class. All but the smallest id of a class lose every word; the smallest id goes on.
2. A window's anchor is the smallest hash of its ``GRAM``-word runs: equal windows have equal anchors, and one anchor serves
   about twenty windows in a row. Anchors are counted; windows whose anchor no other document has are settled.
3. The remaining windows get a 128-bit digest. The smallest id among equal digests owns the window: its passage is the
   reference, passages of the others are routed to it. So every repeated window enters one automaton and every other place
   of it is streamed once, however many copies there are. Digests route only.
4. A reference shard is the owned passages of one document, in chunks of ``CHUNK`` windows. Its suffix automaton goes to
   all tasks that stream the shard's passages (``STREAM`` words each, so a passage that a third of all documents share is
   spread over many). The matching statistics in the automaton, word by word, tell the maximal spans that are removed.

Defined cases: null texts have no words; rows with a null id keep all words and remove none; rows with one id don't remove each
other's words, whatever their texts; repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.missing import col
from scorelake.llm.common import map_batches, stored, text_bytes

WINDOW, GRAM = 50, 8
CHUNK, STREAM = 20_000, 200_000

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))      # any odd numbers


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a size."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 500_000:
                self.clear()
            self[word] = value
        return value


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([_hashes[w] for w in words], np.uint64)


def run_hashes(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of ``width`` words."""
    powers = np.cumprod(np.full(len(h), base, np.uint64))
    inverse = np.cumprod(np.full(len(h), np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers)])
    return _mixed((sums[width:] - sums[:-width]) * inverse[:len(h) - width + 1])


def anchors(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of consecutive windows, equal neighbours merged: the anchors and the first window of each."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    least = run_hashes(_word_hashes(words), gram, _BASES[0])
    left, span = window - gram + 1, 1
    while span < left:                        # minima over 1, 2, 4 ... neighbours
        step = min(span, left - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[starts].view(np.int64), starts.astype(np.int32)


class Automaton:
    """Suffix automaton of several passages over any hashable symbols."""

    def __init__(self, passages: Iterable[list] = ()):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for passage in passages:
            self.add(passage)

    def _state(self, length: int, link: int, after: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, p: int, symbol) -> int:
        """The state that ``p`` reaches by ``symbol`` as one whose longest string is one symbol longer than that of ``p``."""
        q = self.next[p][symbol]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = twin
            p = self.link[p]
        return twin

    def add(self, passage: list) -> None:
        last = 0
        for symbol in passage:
            if symbol in self.next[last]:
                last = self._split(last, symbol)
                continue
            p, last = last, self._state(self.length[last] + 1, 0, {})
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = last
                p = self.link[p]
            if p >= 0:
                self.link[last] = self._split(p, symbol)

    def statistics(self, symbols: list) -> Iterator[int]:
        """For every place, the length of the longest string that ends there and lies in a passage."""
        state = matched = 0
        following, link, length = self.next, self.link, self.length
        for symbol in symbols:
            while state and symbol not in following[state]:
                state = link[state]
                matched = length[state]
            if symbol in following[state]:
                state = following[state][symbol]
                matched += 1
            yield matched

    def spans(self, symbols: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans (start, end) covered by matches of at least ``least`` symbols."""
        out: list[tuple[int, int]] = []
        for end, matched in enumerate(self.statistics(symbols), 1):
            if matched >= least:
                if out and out[-1][1] >= end - matched:
                    out[-1] = (min(out[-1][0], end - matched), end)
                else:
                    out.append((end - matched, end))
        return out


def _summaries(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``id, th, n_words, words_sha, anchors, starts``: all that is kept of a text before it is known to share anything."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, digests, found, starts, sizes = [], [], [], [], []
        for raw in batch.column(2).to_pylist():
            words = raw.split()
            n_words.append(len(words))
            digests.append(sha256(b" ".join(words)).hexdigest())
            own, first = anchors(words, window, gram)
            found.append(own)
            starts.append(first)
            sizes.append(len(own))
        edges = np.cumsum([0, *sizes]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(digests, pa.string()),
             pa.ListArray.from_arrays(edges, np.concatenate([np.zeros(0, np.int64), *found])),
             pa.ListArray.from_arrays(edges, np.concatenate([np.zeros(0, np.int32), *starts]))],
            ["id", "th", "n_words", "words_sha", "anchors", "starts"])

    id_type = docs.schema["id"].dataType.simpleString()
    return map_batches(docs, f"id {id_type}, th long, n_words long, words_sha string, anchors array<long>, starts array<int>", work)


def _shared_runs(firsts: DataFrame, window: int) -> DataFrame:
    """``id, th, runs`` (first window, end) of the windows whose anchor several documents have."""
    stops = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array((F.col("n_words") - window + 1).cast("int")))
    runs = (firsts.select("id", "th", F.explode(F.arrays_zip("anchors", "starts", stops.alias("stops"))).alias("r"))
            .select("id", "th", F.col("r.anchors").alias("anchor"), F.col("r.starts").alias("start"), F.col("r.stops").alias("stop")))
    shared = runs.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    # Stored, as are the owners below: a join of two plain shuffles can split a key that many rows share.
    return (runs.join(stored(shared.select("anchor"), "shared-anchors"), "anchor").groupBy("id", "th")
            .agg(F.collect_list(F.struct("start", "stop")).alias("runs")))


def _window_digests(passages: DataFrame, window: int) -> DataFrame:
    """``a, b`` (digest), ``id, th, pos`` of every window in the shared runs."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, at, sizes = [], [], [], []
        for raw, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            h = _word_hashes(raw.split())
            places = np.unique(np.concatenate([np.arange(r["start"], r["stop"], dtype=np.int64) for r in runs]))
            a.append(run_hashes(h, window, _BASES[0])[places])
            b.append(run_hashes(_mixed(h), window, _BASES[1])[places])
            at.append(places)
            sizes.append(len(places))
        source = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        return pa.RecordBatch.from_arrays(
            [np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64), batch.column(0).take(source),
             batch.column(1).take(source), pa.array(np.concatenate(at), pa.int32())], ["a", "b", "id", "th", "pos"])

    id_type = passages.schema["id"].dataType.simpleString()
    return map_batches(passages.select("id", "th", "raw", "runs"), f"a long, b long, id {id_type}, th long, pos int", work, 64)


def _segments(windows: DataFrame) -> DataFrame:
    """``id, th, owner, start, stop``: neighbouring windows with one owner, which is the smallest id that has them."""
    owned = windows.groupBy("a", "b").agg(F.min("id").alias("owner"), F.max("id").alias("most")).where("owner < most").drop("most")
    owned = stored(owned, "owners")
    text = Window.partitionBy("id", "th").orderBy("pos")
    before = F.lag(F.struct("pos", "owner")).over(text)
    new = F.coalesce((F.col("pos") > before["pos"] + 1) | (F.col("owner") != before["owner"]), F.lit(True))
    return (windows.join(owned, ["a", "b"]).withColumn("new", new.cast("int"))
            .withColumn("segment", F.sum("new").over(text.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("id", "th", "segment")
            .agg(F.min("owner").alias("owner"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop")).drop("segment"))


def _routed(segments: DataFrame, chunk: int, stream: int) -> DataFrame:
    """Segments per ``id, th`` with their shard: owner, chunk of it and, for popular shards, a salt."""
    cut = F.explode(F.sequence(F.floor(F.col("start") / chunk).cast("int"), F.floor((F.col("stop") - 1) / chunk).cast("int")))
    pieces = (segments.where("id = owner").withColumn("chunk", cut)
              .withColumn("start", F.greatest("start", F.col("chunk") * chunk))
              .withColumn("stop", F.least("stop", (F.col("chunk") + 1) * chunk)))
    others = segments.where("id > owner")
    load = others.groupBy("owner").agg(F.ceil(F.sum(F.col("stop") - F.col("start") + WINDOW) / stream).cast("int").alias("salts"))
    references = pieces.join(load, "owner").select(
        "*", F.lit(True).alias("reference"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    shards = pieces.select("owner", "chunk").distinct().join(load, "owner")
    streamed = others.join(shards, "owner").select(
        "*", F.lit(False).alias("reference"), F.pmod(F.xxhash64("id", "th"), F.col("salts")).cast("int").alias("salt"))
    shape = ["id", "th", "owner", "chunk", "salt", "reference", "start", "stop"]
    return (references.select(shape).unionByName(streamed.select(shape)).groupBy("id", "th")
            .agg(F.collect_list(F.struct(*shape[2:])).alias("pieces")))


def _merged(pieces: list[dict], window: int) -> list[dict]:
    """Pieces of one text and shard that share words become one: what lies between is in the same document anyway."""
    out: list[dict] = []
    for p in sorted(pieces, key=lambda p: (p["owner"], p["chunk"], p["salt"], p["reference"], p["start"])):
        last = out[-1] if out else None
        if last and all(last[x] == p[x] for x in ("owner", "chunk", "salt", "reference")) and p["start"] < last["stop"] + window - 1:
            last["stop"] = max(last["stop"], p["stop"])
        else:
            out.append(dict(p))
    return out


def _streamed(passages: DataFrame, routed: DataFrame, window: int) -> DataFrame:
    """``id, th, start, stop``: spans of words that an automaton of a smaller id holds."""
    id_type = passages.schema["id"].dataType.simpleString()
    names = ["owner", "chunk", "salt", "reference", "start"]

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k, (raw, pieces) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            words, pieces = raw.split(), _merged(pieces, window)
            rows = pa.array(pieces, batch.schema.field(3).type.value_type)
            own = batch.column(0).take(pa.array([k] * len(pieces))), batch.column(1).take(pa.array([k] * len(pieces)))
            texts = [b" ".join(words[p["start"]:p["stop"] + window - 1]) for p in pieces]
            yield pa.RecordBatch.from_arrays([*own, *(rows.field(n) for n in names), pa.array(texts, pa.binary())],
                                             ["id", "th", *names, "words"])

    parts = map_batches(passages.join(routed, ["id", "th"]).select("id", "th", "raw", "pieces"),
                        f"id {id_type}, th long, owner {id_type}, chunk int, salt int, reference boolean, start int, words binary", cut)
    shard = ["owner", "chunk", "salt"]
    dealt = parts.repartition(*shard).sortWithinPartitions(*shard, F.desc("reference"), "id", "th", "start")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, automaton = None, Automaton()
        for batch in batches:
            rows, starts, stops = [], [], []
            columns = [batch.column(k).to_pylist() for k in (*range(2, 6), 6, 7)]
            for k, (owner, chunk, salt, reference, start, words) in enumerate(zip(*columns, strict=True)):
                if (owner, chunk, salt) != held:
                    held, automaton = (owner, chunk, salt), Automaton()
                if reference:
                    automaton.add(words.split())
                    continue
                for a, b in automaton.spans(words.split(), window):
                    rows.append(k)
                    starts.append(start + a)
                    stops.append(start + b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), batch.column(1).take(pa.array(rows, pa.int32())),
                                              pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["id", "th", "start", "stop"])

    return dealt.mapInArrow(match, f"id {id_type}, th long, start int, stop int")


def _edited(passages: DataFrame, spans: DataFrame) -> DataFrame:
    """``id, words_sha, n_removed, kept`` of texts that lose words; ``kept`` are their other words, joined by a space."""
    per_text = spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, removed, kept = [], [], []
        for raw, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words, out, at = raw.split(), [], 0
            for s in sorted((x["start"], x["stop"]) for x in spans_):
                out += words[at:s[0]]
                at = max(at, s[1])
            out += words[at:]
            digests.append(sha256(b" ".join(words)).hexdigest())
            removed.append(len(words) - len(out))
            kept.append(b" ".join(out).decode())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests), pa.array(removed, pa.int64()), pa.array(kept)],
                                          ["id", "words_sha", "n_removed", "kept"])

    id_type = passages.schema["id"].dataType.simpleString()
    return map_batches(passages.join(per_text, ["id", "th"]).select("id", "raw", "spans"),
                       f"id {id_type}, words_sha string, n_removed long, kept string", work)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
          chunk: int = CHUNK, stream: int = STREAM) -> tuple[DataFrame, DataFrame]:
    """(per row of ``docs``: ``id, n_words, n_removed, words_sha, kept_sha256``; the new texts ``id, words_sha, kept`` of the
    smallest id of each class that loses some words and shares them with other texts)."""
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(text_bytes(text_col)).alias("th"), text_bytes(text_col).alias("raw"))
    summary = stored(_summaries(rows, window, gram), "summaries")
    long = summary.where(F.col("id").isNotNull() & (F.col("n_words") >= window))
    classes = stored(long.groupBy("words_sha").agg(F.min("id").alias("first"), F.max("id").alias("last")), "classes")
    firsts = (long.join(classes.withColumnRenamed("first", "id"), ["words_sha", "id"])
              .select("id", "th", "n_words", "anchors", "starts"))
    runs = stored(_shared_runs(stored(firsts, "firsts"), window), "shared-runs")
    passages = stored(rows.join(runs, ["id", "th"]).groupBy("id", "th").agg(F.first("raw").alias("raw"), F.first("runs").alias("runs")),
                      "passages")
    segments = stored(_segments(_window_digests(passages, window)), "segments")
    spans = stored(_streamed(passages, stored(_routed(segments, chunk, stream), "routed"), window), "spans")
    edited = stored(_edited(passages, spans).groupBy("id", "words_sha").agg(
        F.first("n_removed").alias("some"), F.first("kept").alias("kept")), "edited")
    side = (classes.join(edited.select("words_sha", "some", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha")), "words_sha", "left")
            .where("first < last or some is not null"))
    side = stored(side, "changed-classes")
    copy = F.col("id") > F.col("first")
    own = (F.col("id") == F.col("first")) & F.col("some").isNotNull()
    result = summary.select("id", "n_words", "words_sha").join(side, "words_sha", "left").select(
        "id", "n_words", F.when(copy, F.col("n_words")).when(own, F.col("some")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        "words_sha", F.when(copy, F.lit(sha256(b"").hexdigest())).when(own, F.col("kept_sha")).otherwise(F.col("words_sha")).alias("kept_sha256"))
    return result, edited.select("id", "words_sha", "kept")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    found = dedup(docs, id_col, text_col, **options)[0]
    return found.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")
