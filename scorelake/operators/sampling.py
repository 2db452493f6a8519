"""Exact, reproducible splits, samples and folds.

Rows of a class are put in the order of ``md5(seed | row id)`` (or of the id itself) and cut at exact
ranks, so sizes are exact and membership depends on nothing but seed and ids. Ids may repeat: rows that share one are
ordered by their whole content, and of rows that are equal throughout the right number goes to each side. The input is read twice
(two columns) to find the cuts, then once by the caller; it should therefore be a stored table. The number
of classes is not limited; the driver holds one counter and the cut keys per class.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import config
from scorelake.functions.missing import col, value_or_null
from scorelake.operators.ordering import (
    RANKED_ROWS, common_digits, hash_key, id_key, keys_at_ranks, row_digest, with_block,
)


def _keyed(df: DataFrame, key: Column, target: str | None) -> DataFrame:
    group = value_or_null(df, target) if target else F.lit(0)
    return df.select(group.alias("g"), key.alias("k"), row_digest(df).alias("d"))


def _known(counts: Mapping[Any, int]) -> dict[Any, int]:
    return {c: n for c, n in counts.items() if c is not None}


def split_quotas(counts: Mapping[Any, int], test_size: float) -> dict[Any, int]:
    """Training rows per class: ``ceil(n * test_size)`` test rows, classes by largest remainder."""
    n = sum(counts.values())
    train = n - math.ceil(n * test_size)
    exact = {c: counts[c] * train / n for c in counts} if n else {}
    quota = {c: math.floor(x) for c, x in exact.items()}
    left = train - sum(quota.values())
    for c in sorted(exact, key=lambda c: (-(exact[c] - quota[c]), c))[:left]:
        quota[c] += 1
    return quota


def sample_quotas(counts: Mapping[Any, int], rows: int, sample_size: int) -> dict[Any, int]:
    """Sample rows per class: truncated share, at least one, surplus taken from the largest quota.

    ``rows`` counts rows without a class too, so the sum can fall short of ``sample_size``.
    """
    size = min(sample_size, rows)
    by_size = sorted(counts, key=lambda c: (-counts[c], c))
    quota = {c: max(1, int(counts[c] / rows * size)) for c in by_size}
    surplus = sum(quota.values()) - size
    if surplus > 0:
        largest = max(by_size, key=lambda c: quota[c])
        quota[largest] = max(0, quota[largest] - surplus)
    return quota


def fold_ends(counts: Mapping[Any, int], n_folds: int) -> dict[Any, list[int]]:
    """Rank of the last row of every fold but the final one, per class.

    With the classes laid end to end, position p belongs to fold ``p mod n_folds``; this fixes how many
    rows of a class each fold takes. The class is then cut into consecutive blocks of those sizes.
    """
    ends, start = {}, 0
    for c in sorted(counts):
        offsets = [(f - start) % n_folds for f in range(n_folds)]
        sizes = [max(0, math.ceil((counts[c] - o) / n_folds)) for o in offsets]
        total, cuts = 0, []
        for size in sizes[:-1]:
            total += size
            cuts.append(total)
        ends[c] = cuts
        start += counts[c]
    return ends


_BLOCK = "__block"


def _named_split(placed: DataFrame) -> DataFrame:
    return placed.withColumn("split", F.when(F.col(_BLOCK) == 0, F.lit("train")).otherwise(F.lit("test"))).drop(_BLOCK)


def random_split(df: DataFrame, id_col: str, test_size: float = config.TEST_SIZE,
                 seed: int = config.RANDOM_STATE, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Add ``split`` (train/test) with exact sizes, ignoring classes."""
    key = hash_key(col(id_col), seed)
    _, cuts = keys_at_ranks(_keyed(df, key, None), lambda c: {g: [q] for g, q in split_quotas(c, test_size).items()},
                            ranked_rows=ranked_rows)
    return _named_split(with_block(df, _BLOCK, key, cuts))


def stratified_split(df: DataFrame, id_col: str, target: str, test_size: float = config.TEST_SIZE,
                     seed: int = config.RANDOM_STATE, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Add ``split`` (train/test) with exact sizes per class.

    A class with a single row makes stratification impossible: the split is then a plain random one.
    Rows without a class must be removed first (:func:`scorelake.operators.profile.clean_rows`).
    """
    def ranks(counts: dict[Any, int]) -> dict[Any, list[int]]:
        if None in counts:
            raise ValueError(f"{target} has missing values; clean the table first")
        if counts and min(counts.values()) < 2:
            return {}
        return {c: [q] for c, q in split_quotas(counts, test_size).items()}

    key = hash_key(col(id_col), seed)
    counts, cuts = keys_at_ranks(_keyed(df, key, target), ranks, ranked_rows=ranked_rows)
    if counts and not cuts:
        return random_split(df, id_col, test_size, seed, ranked_rows)
    return _named_split(with_block(df, _BLOCK, key, cuts, target))


def random_sample(df: DataFrame, id_col: str, n: int, seed: int = config.RANDOM_STATE,
                  ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement; the same rows for every caller with this seed."""
    key = hash_key(col(id_col), seed)
    _, cuts = keys_at_ranks(_keyed(df, key, None), lambda c: {g: [min(n, rows)] for g, rows in c.items()},
                            ranked_rows=ranked_rows)
    return with_block(df, _BLOCK, key, cuts).where(F.col(_BLOCK) == 0).drop(_BLOCK)


def stratified_sample(df: DataFrame, id_col: str, target: str | None, n: int = config.SAMPLE_SIZE,
                      seed: int = config.RANDOM_STATE, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """About ``n`` rows with class shares kept (see :func:`sample_quotas`).

    Without a target, or when the column is absent, this is :func:`random_sample`.
    """
    if target is None or target not in df.columns:
        return random_sample(df, id_col, n, seed, ranked_rows)
    key = hash_key(col(id_col), seed)
    _, cuts = keys_at_ranks(
        _keyed(df, key, target),
        lambda c: {g: [q] for g, q in sample_quotas(_known(c), sum(c.values()), n).items()},
        ranked_rows=ranked_rows)
    return with_block(df, _BLOCK, key, cuts, target).where(F.col(_BLOCK) == 0).drop(_BLOCK)


def with_shuffle_key(df: DataFrame, id_col: str, seed: int = config.RANDOM_STATE) -> DataFrame:
    """Add ``shuffle_key``; ordering by it is a reproducible shuffle, done only where order matters."""
    return df.withColumn("shuffle_key", hash_key(col(id_col), seed))


def _folds(df: DataFrame, target: str, n_folds: int, key: Column, skip: bool, ranked_rows: int) -> DataFrame:
    if n_folds < 2:
        raise ValueError("at least two folds are needed")
    keyed = _keyed(df, key, target)

    def ranks(counts: dict[Any, int]) -> dict[Any, list[int]]:
        counts = _known(counts)
        if counts and max(counts.values()) < n_folds:
            raise ValueError(f"no class has {n_folds} rows")
        return fold_ends(counts, n_folds)

    _, cuts = keys_at_ranks(keyed, ranks, skip_digits=common_digits(keyed) if skip else 0, ranked_rows=ranked_rows)
    return with_block(df, "fold", key, cuts, target)


def stratified_folds(df: DataFrame, id_col: str, target: str, n_folds: int = 5,
                     seed: int = config.RANDOM_STATE, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Add ``fold`` (0..n-1): shuffled stratified folds."""
    return _folds(df, target, n_folds, hash_key(col(id_col), seed), False, ranked_rows)


def ordered_folds(df: DataFrame, id_col: str, target: str, n_folds: int = 5,
                  ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Add ``fold`` (0..n-1): stratified folds of consecutive rows in the order of an integer id."""
    return _folds(df, target, n_folds, id_key(col(id_col)), True, ranked_rows)


def split_summary(df: DataFrame, target: str, n_features: int) -> DataFrame:
    """Rows, number of features and class balance per split."""
    from scorelake.operators.profile import class_balance

    return class_balance(df, target, by=["split"]).withColumn("n_features", F.lit(n_features))
