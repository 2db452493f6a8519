"""Exact order statistics of string keys, found by counting key prefixes.

Splits, samples and folds all ask "is this row among the first n of its class in key order?". Ranking
every row would shuffle and sort the whole table. Instead the key at rank n is looked up: count rows
per (class, key prefix), walk to the prefix that holds rank n, look closer only inside that prefix.
Each pass reads two columns and shuffles prefix counters; the walk is a window over them. The driver
receives one counter per class and one place per wanted rank. Afterwards membership is a comparison
with the cuts of the row's class: literals without a class, else a small table joined on the class.

Keys need not be unique. Where a wanted rank falls between rows that share their key, the walk goes on in a digest of the
whole row, and where even that is shared (equal rows) the cut names how many of the equal rows lie before it. So a cut is
``key``, ``key + digest`` or ``key + digest + "|" + number``; each reads as text that sorts like the rows. Only rows at such
a cut have their digest computed, and only equal rows at a cut are stored and numbered, task by task: a key or a row
that makes up a third of the table is spread like the table itself.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.missing import col
from scorelake.session import scratch_path

PREFIX_STEP = 3            # hexadecimal digits per pass: 4096 prefixes
RANKED_ROWS = 200_000      # a prefix with at most this many rows is ranked directly
LONGEST_KEY = DIGEST = 32  # digits of an id's hash, and of a row's
NUMBER = "|"               # parts the digests from the number of an equal row; sorts above all digits
BEFORE_ALL, AFTER_ALL = "", "g"   # below and above every hexadecimal key


def hash_key(id_col: Column, seed: int) -> Column:
    """Pseudo-random but reproducible order, independent of partitioning and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), id_col.cast("string")))


def id_key(id_col: Column) -> Column:
    """Hexadecimal text that sorts like the integer id."""
    flipped = id_col.cast("bigint").bitwiseXOR(F.lit(-(2**63)).cast("bigint"))
    return F.lower(F.lpad(F.hex(flipped), 16, "0"))


def row_digest(df: DataFrame) -> Column:
    """Hexadecimal digest of all columns of a row; equal rows share it."""
    return F.md5(F.to_json(F.struct(*[col(c) for c in df.columns]), {"ignoreNullFields": "false"}))


def _number_text(number: Column) -> Column:
    return F.concat(F.lit(NUMBER), F.lpad(number.cast("string"), 18, "0"))


def _local(df: DataFrame, group: str, found: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Driver rows as a table of known size, so that the planner decides by it whether to broadcast; ``g`` gets the
    type of the column ``group``."""
    made = df.sparkSession.createDataFrame(pa.Table.from_pylist([dict(r) for r in found]))
    return made.withColumn("g", F.col("g").cast(df.schema[group].dataType))


def _inside(rows: DataFrame, places: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Rows of the places (class ``g``, prefix ``p``), with the prefix as ``p``; places of one length are disjoint."""
    parts = []
    for digits in sorted({len(x["p"]) for x in places}):
        wanted = sorted({(x["g"], x["p"]) for x in places if len(x["p"]) == digits}, key=str)
        table = _local(rows, "g", [{"g": g, "p": p} for g, p in wanted])
        parts.append(rows.withColumn("p", F.substring("k", 1, digits)).join(table, ["g", "p"]))
    return reduce(DataFrame.unionByName, parts)


def _walk(prefixes: DataFrame, places: Sequence[Mapping[str, Any]]) -> list[dict[str, Any]]:
    """Each place (g, r, p, rank) moved to the longer prefix that holds it, with the rank inside that and its rows ``n``.

    ``prefixes`` holds (g, p, q, n): rows per longer prefix ``q`` of ``p``.
    """
    upto = F.sum("n").over(Window.partitionBy("g", "p").orderBy("q"))
    asked = _local(prefixes, "g", [{k: x[k] for k in ("g", "r", "p", "rank")} for x in places])
    before = F.col("upto") - F.col("n")
    found = (prefixes.withColumn("upto", upto).join(asked, ["g", "p"])
             .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > before))
             .select("g", "r", F.col("q").alias("p"), (F.col("rank") - before).alias("rank"), "n"))
    return [r.asDict() for r in found.collect()]


def _prefix_counts(rows: DataFrame, digits: int) -> DataFrame:
    return rows.groupBy("g", "p", F.substring("k", 1, digits).alias("q")).agg(F.count("*").alias("n"))


def _resolved(rows: DataFrame, places: Sequence[Mapping[str, Any]], digits: int, ranked_rows: int,
              ) -> tuple[dict[tuple[Any, int], str], list[dict[str, Any]]]:
    """Follow places to whole keys: (key per (group, rank), places inside keys that several rows share)."""
    def heavy(x: Mapping[str, Any]) -> bool:
        return x["n"] > ranked_rows and len(x["p"]) == digits

    while any(map(heavy, places)):
        open_, near = [x for x in places if heavy(x)], [x for x in places if not heavy(x)]
        digits += PREFIX_STEP
        places = near + _walk(_prefix_counts(_inside(rows, open_), digits), open_)

    found: dict[tuple[Any, int], str] = {}
    shared = [dict(x) for x in places if x["n"] > ranked_rows]      # whole keys that so many rows have
    near = [x for x in places if x["n"] <= ranked_rows]
    if near:
        prefix = Window.partitionBy("g", "p")
        ranked = _inside(rows, near).select(
            "*", F.row_number().over(prefix.orderBy("k")).alias("rank"), F.rank().over(prefix.orderBy("k")).alias("first"),
            F.count("*").over(Window.partitionBy("g", "p", "k")).alias("same"))
        table = _local(rows, "g", [{k: x[k] for k in ("g", "p", "rank", "r")} for x in near])
        for row in ranked.join(table, ["g", "p", "rank"]).select("g", "r", "k", "rank", "first", "same").collect():
            shared.append({"g": row["g"], "r": row["r"], "p": row["k"], "rank": row["rank"] - row["first"] + 1, "n": row["same"]})
    found.update({(x["g"], x["r"]): x["p"] for x in shared if x["rank"] == x["n"]})
    return found, [x for x in shared if x["rank"] < x["n"]]


def keys_at_ranks(rows: DataFrame, wanted: Callable[[dict[Any, int]], Mapping[Any, Sequence[int]]],
                  skip_digits: int = 0, ranked_rows: int = RANKED_ROWS,
                  ) -> tuple[dict[Any, int], dict[Any, list[str]]]:
    """Row count per group, and the cut after each wanted rank.

    ``rows`` has columns ``g`` (group), ``k`` (hexadecimal key, all of one length) and ``d`` (digest of the row, looked at
    only where keys are shared); ``wanted`` turns the
    counts, those of rows without a group included, into ranks for the groups of interest. Rank 0 gives a key below all, a rank of at
    least the group's size one above all. Any number of groups will do.
    """
    digits = skip_digits + PREFIX_STEP
    prefixes = _prefix_counts(rows.withColumn("p", F.lit("")), digits).persist()
    try:
        counts = {r["g"]: r["n"] for r in prefixes.groupBy("g").agg(F.sum("n").alias("n")).collect()}
        ranks = {g: list(v) for g, v in wanted(counts).items()}
        asked = [{"g": g, "r": r, "p": "", "rank": r} for g, v in ranks.items() for r in sorted(set(v)) if 0 < r < counts[g]]
        places = _walk(prefixes, asked) if asked else []
    finally:
        prefixes.unpersist()

    found, shared = _resolved(rows, places, digits, ranked_rows)
    if shared:
        deeper = _inside(rows, shared).select("g", F.concat("k", "d").alias("k"))
        more, equal = _resolved(deeper, shared, max(len(x["p"]) for x in shared), ranked_rows)
        found |= more | {(x["g"], x["r"]): f"{x['p']}{NUMBER}{x['rank']:018d}" for x in equal}

    def key_for(g: Any, r: int) -> str:
        return BEFORE_ALL if r <= 0 else AFTER_ALL if r >= counts[g] else found[g, r]

    return counts, {g: [key_for(g, r) for r in rs] for g, rs in ranks.items()}


def common_digits(rows: DataFrame) -> int:
    """Number of leading digits that all keys share (worth skipping for dense integer ids)."""
    lo, hi = rows.agg(F.min("k"), F.max("k")).first()
    return len(os.path.commonprefix([lo, hi])) if lo is not None else 0


def _passed(key: Column, whole: Column | None, cuts: Sequence[Column]) -> Column:
    """How many cuts a row lies above. ``whole``, the key with all that follows it, decides only where a cut shares the key."""
    def above(c: Column) -> Column:
        return key > c if whole is None else (key > c) | ((F.length(c) > F.length(key)) & F.startswith(c, key) & (whole > c))

    return reduce(lambda a, b: a + b, [above(c).cast("int") for c in cuts], F.lit(0))


def _numbered(equal: DataFrame) -> DataFrame:
    """Replace ``__part, __at`` (task and place within it) by ``__number``: the rows of one ``__whole`` counted from 1."""
    by = ["__class", "__whole"]
    before = (equal.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
              .withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")).drop("__n"))
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__at"))
    return (equal.withColumn("__inside", inside).join(before, [*by, "__part"])
            .withColumn("__number", F.col("__before") + F.col("__inside")).drop("__part", "__at", "__before", "__inside"))


def _with_numbers(df: DataFrame, key: Column, digest: Column, cuts: Mapping[Any, Sequence[str]], group: str | None) -> DataFrame:
    """Add ``__number``: the number of equal rows at a cut as text, empty elsewhere."""
    places: dict[tuple[Any, str], list[str]] = {}
    for g, cs in cuts.items():
        for p in {c.partition(NUMBER)[0] for c in cs if NUMBER in c}:
            places.setdefault((g, p[:-DIGEST]), []).append(p)
    if not places:
        return df.withColumn("__number", F.lit(""))
    classed = df.withColumn("__class", col(group) if group else F.lit(next(iter(cuts))))
    table = _local(classed, "__class", [{"g": g, "__k": k, "__ps": ps} for (g, k), ps in places.items()]).withColumnRenamed("g", "__g")
    whole = F.concat(key, digest)       # computed for rows of the keys in question alone
    marked = (classed.join(table, (F.col("__class") == F.col("__g")) & (key == F.col("__k")), "left")
              .withColumn("__whole", F.when(F.col("__ps").isNotNull(), F.when(F.array_contains("__ps", whole), whole)))
              .drop("__g", "__k", "__ps"))
    path = scratch_path(df.sparkSession, "equal-rows")
    (marked.where(F.col("__whole").isNotNull()).withColumn("__part", F.spark_partition_id())
     .withColumn("__at", F.monotonically_increasing_id()).write.parquet(path))
    equal = _numbered(df.sparkSession.read.parquet(path)).withColumn("__number", _number_text(F.col("__number")))
    others = marked.where(F.col("__whole").isNull()).withColumn("__number", F.lit(""))
    return others.drop("__class", "__whole").unionByName(equal.drop("__class", "__whole"))


def with_block(df: DataFrame, name: str, key: Column, cuts: Mapping[Any, Sequence[str]], group: str | None = None) -> DataFrame:
    """Add ``name``: how many cuts of the row's class (column ``group``) its key lies above; null for a class without cuts.

    Without ``group`` the cuts are literals. With it they are one row per class, joined: as a broadcast while the
    planner finds that table small, so the data stays where it is. Rows that are equal and lie at a cut are stored once to
    be numbered; which of them comes first is not defined, how many come first is.
    """
    if not cuts:
        return df.withColumn(name, F.lit(None).cast("int"))
    whole = None
    if any(len(c) > LONGEST_KEY for cs in cuts.values() for c in cs):
        digest = row_digest(df)
        df = _with_numbers(df, key, digest, cuts, group)
        whole = F.concat(key, digest, F.col("__number"))
    if group is None:
        return df.withColumn(name, _passed(key, whole, [F.lit(c) for c in next(iter(cuts.values()))])).drop("__number")
    names = [f"__cut_{i}" for i in range(len(next(iter(cuts.values()))))]
    table = _local(df, group, [{"g": g, **dict(zip(names, ks))} for g, ks in cuts.items()]).withColumnRenamed("g", "__class")
    joined = df.join(table, col(group) == F.col("__class"), "left")
    known = F.when(F.col("__class").isNotNull(), _passed(key, whole, [F.col(n) for n in names]))
    return joined.withColumn(name, known).drop("__class", "__number", *names)
