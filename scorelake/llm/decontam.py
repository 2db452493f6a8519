"""Benchmark decontamination as a prefix-filtered set join of word shingles, with DataFrame functions only.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one window). The set of a window are its shingles
of ``SHINGLE`` words. A document holds the window only if it holds all of them, so the necessary prefix is one shingle;
the rarest over the corpus is taken. Then:

1. every position of every document is hashed to its shingle and joined with the shingles of all windows; the matches
   are counted per shingle (rarity over all documents) and kept (document, position, shingle);
2. matches of prefix shingles give a window's start; the positional and length bounds drop starts before the text or
   windows that reach past its end;
3. the words at each remaining start are compared with the window's words, which is exact whatever the hashes do.

The shingles of the benchmark are joined by broadcast if their measured number is at most ``BROADCAST_ROWS`` (16 bytes
each), else by a shuffle of the hashes.

Defined cases: null texts have no words; items without words have no window; rows with equal ids are told apart by
their text, and rows that agree in both are equal in the result; windows that several items share count for each; an
empty benchmark or empty documents give counts of zero or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import ascii_lower, boxed, stored, text_of

WINDOW = 10
SHINGLE = 5
BROADCAST_ROWS = 1_000_000

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"            # of texts in lower case
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(_WORDS), F.lit(0))


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; no runs give an empty array."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - size),
                         lambda k: F.xxhash64(*[F.get(words, k + j) for j in range(size)]))
    return F.when(F.size(words) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """``words, size, items``: distinct windows and the sorted items that hold each."""
    chosen = items.select(F.col(id_col).cast("string").alias("item"), words_of(text_of(text_col)).alias("words"))
    chosen = chosen.where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    cut = chosen.select("item", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - length + 1), lambda k: F.slice(F.col("words"), k, length))).alias("words"))
    return (cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
            .withColumn("size", F.size("words")).withColumn("step", F.least("size", F.lit(shingle))))


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: ``n_words, n_hit``, the ``items`` that it holds windows of, and the ``hits`` (start, size)."""
    found = mark(docs.select(id_col, text_col), items, id_col, text_col, **options)
    return found.select(id_col, *[F.col(f"__{name}").alias(name) for name in ("n_words", "n_hit", "items", "hits")])


def mark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the columns of :func:`find`, their names led by two underscores."""
    spark = docs.sparkSession
    windows = stored(windows_of(items, item_id, item_text, window, shingle), "windows")
    # Both sides are in A-Z lower case: full lower case of a capital sigma depends on the letters around it.
    parts = windows.select("words", "items", "size", "step")
    steps = sorted(r.step for r in parts.select("step").distinct().collect())          # at most SHINGLE values
    every = None
    for step in steps:
        own = parts.where(F.col("step") == step).select(
            "words", "items", "size", F.lit(step).alias("step"), F.posexplode(_shingles(F.col("words"), step)).alias("at", "h"))
        every = own if every is None else every.union(own)
    chosen = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if every is None:
        every = parts.select("words", "items", "size", "step", F.lit(0).alias("at"), F.lit(0).cast("long").alias("h"))
    every = stored(every, "window-shingles")
    return _verified(docs, id_col, text_col, _candidates(spark, chosen, every, steps))


def _verified(docs: DataFrame, id_col: str, text_col: str, candidates: DataFrame) -> DataFrame:
    """``docs`` with ``__n_words, __n_hit, __items, __hits``: the words at each start are compared with the window's."""
    text = text_of(text_col)
    joined = docs.join(candidates, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    held = joined.withColumn("__own", F.when(F.col("__found").isNotNull(), words_of(text)))
    exact = held.withColumn("__found", F.filter("__found", lambda c: F.slice(F.col("__own"), c["start"] + 1, c["size"]) == c["words"]))
    none = F.array().cast("array<struct<start:int,size:int>>")
    no_items = F.array().cast("array<array<string>>")
    n_words = F.when(F.col("__own").isNull(), F.regexp_count(text, F.lit(_ANY_CASE))).otherwise(F.size("__own"))
    counted = exact.withColumns({
        "__n_words": n_words.cast("long"),
        "__hits": F.coalesce(F.transform("__found", lambda c: F.struct(c["start"].alias("start"), c["size"].alias("size"))), none),
        "__items": F.sort_array(F.array_distinct(F.flatten(F.coalesce(F.transform("__found", lambda c: c["items"]), no_items)))),
    })
    places = F.array_distinct(F.flatten(F.transform("__hits", lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1))))
    return counted.withColumn("__n_hit", F.size(places).cast("long")).drop("__id", "__th", "__found", "__own")


def _candidates(spark: SparkSession, docs: DataFrame, shingles: DataFrame, steps: list[int]) -> DataFrame:
    """``__id, __th, __found``: per document the starts at which the rarest shingle of a window lies within bounds."""
    words = docs.select("id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("low"))
    words = words.withColumn("n", F.size("low"))
    known = stored(shingles.select("h").distinct(), "known-shingles")
    small = known.count() <= BROADCAST_ROWS
    placed = [words.select("id", "th", "n", F.posexplode(_shingles(F.col("low"), step)).alias("pos", "h")) for step in steps]
    places = placed[0] if placed else words.select("id", "th", "n", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h")).where("false")
    for more in placed[1:]:
        places = places.union(more)
    matches = stored(places.join(F.broadcast(known) if small else known, "h"), "matches")
    rarity = matches.groupBy("h").agg(F.count("*").alias("seen"))
    ranked = shingles.join(rarity, "h", "left").groupBy("words").agg(
        F.min_by(F.struct("h", "at", "size", "items", "seen"), F.struct(F.coalesce("seen", F.lit(0)), "h", "at")).alias("p"))
    prefix = stored(ranked.where("p.seen is not null").select("p.h", "p.at", "p.size", "p.items", "words"), "prefixes")
    starts = matches.join(F.broadcast(prefix) if small else prefix, "h").withColumn("start", F.col("pos") - F.col("at"))
    within = starts.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n")))
    return within.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(
        F.collect_set(F.struct("start", "size", "words", "items")).alias("__found"))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    return mark(boxed(docs, id=id_col, text=text_col), items, "id", "text").where("__n_hit = 0").select("row.*")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digest of the item ids and the verdict."""
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
