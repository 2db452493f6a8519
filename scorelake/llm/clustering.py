"""Centroid clustering with a LAESA pivot table, in exact integers.

A vector of exactly ``DIMENSIONS`` finite components becomes integers ``floor(SCALE * x)``. A few of the first centroids
are fixed pivots; every vector's distance to each of them is computed once and stored beside the vector. In each round the
(broadcast) centroids get their own pivot distances. By the triangle inequality the difference of two pivot distances is
a lower bound of the distance between vector and centroid; the centroid with the smallest bound is measured first, and
only centroids whose bound doesn't exceed that distance are measured too, in exact integers.

A round sends one partial sum per task and centroid through a shuffle; the driver gets at most ``k`` sums of
``DIMENSIONS`` numbers. Vectors are never moved: every round reads the stored table, so a lost executor costs its own tasks.

Defined cases: null vectors, other lengths, null, NaN or infinite components are left out; an empty table (or none kept)
gives no rows; fewer vectors than ``k`` make a centroid of each; a null id hashes like an empty one; rows with equal ids are
ordered by their components when first centroids are drawn, so equal rows may make equal centroids (the smaller number then
gets all); other columns are ignored. Integers beyond ``LARGEST`` would overflow exact distances and are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.missing import col
from scorelake.llm.common import stored

DIMENSIONS, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
PIVOTS = 8
LARGEST = 1 << 27                # squared distances then stay below 2**62
BLOCK = 8_192                    # vectors that are compared together


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
             scale: int = SCALE) -> DataFrame:
    """``id, v`` of the usable vectors, components as integers."""
    values = col(vector_col).cast("array<double>")
    x = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    too_large = F.raise_error(F.lit(f"vector components beyond {LARGEST} / {scale}"))
    whole = F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c))
    return (vectors.select(col(id_col).alias("id"), values.alias("x"))
            .where((F.size("x") == dimensions) & F.forall("x", x))
            .select("id", F.when(F.exists("x", lambda c: F.abs(c) * scale > LARGEST), too_large).otherwise(whole).alias("v")))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b`` (few)."""
    out = np.empty((len(a), len(b)), np.int64)
    for k, row in enumerate(b):
        gap = a - row
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the points, each the farthest from those before it."""
    chosen, nearest = [0], _squares(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _squares(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``far``: the distance to each pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                far = np.sqrt(_squares(_matrix(part.column(1)), pivots).astype(np.float64))
                edges = np.arange(0, far.size + 1, far.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(edges, far.ravel())],
                                                 ["id", "v", "far"])

    id_type = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v").mapInArrow(run, f"id {id_type}, v array<bigint>, far array<double>")


def nearest(v: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid (ties: smaller number), and how many distances were measured."""
    centre_far = np.sqrt(_squares(centroids, pivots).astype(np.float64))
    bound = np.abs(far[:, :1] - centre_far[:, 0])
    for p in range(1, len(pivots)):
        np.maximum(bound, np.abs(far[:, p:p + 1] - centre_far[:, p]), out=bound)
    # Rounding of the roots must never raise a bound above the distance: whole squares allow this margin.
    np.multiply(bound, bound * (1 - 1e-9), out=bound)
    bound -= 1
    first = bound.argmin(axis=1)
    gap = v - centroids[first]
    best, found = np.einsum("ij,ij->i", gap, gap), first
    bound[np.arange(len(v)), first] = np.inf
    measured = len(v)
    for c in range(len(centroids)):
        rows = np.flatnonzero(bound[:, c] <= best)
        if len(rows):
            gap = v[rows] - centroids[c]
            d = np.einsum("ij,ij->i", gap, gap)
            closer = (d < best[rows]) | ((d == best[rows]) & (c < found[rows]))
            best[rows[closer]], found[rows[closer]] = d[closer], c
            measured += len(rows)
    return found, best, measured


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, _matrix(part.column(1)), _matrix(part.column(2))


def _moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of the means; empty ones stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(centroids), centroids.shape[1] + 1), object)      # whole numbers of any size
        for _, v, far in _blocks(batches):
            found = nearest(v, far, centroids, pivots)[0]
            for c in np.unique(found).tolist():
                own = v[found == c]
                totals[c, 0] += len(own)
                totals[c, 1:] += own.sum(axis=0)
        for c in np.flatnonzero(totals[:, 0]).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c] * totals.shape[1], pa.int32()),
                                              pa.array(np.arange(totals.shape[1]), pa.int32()),
                                              pa.array(map(str, totals[c]))], ["cluster", "place", "total"])

    parts = table.mapInArrow(run, "cluster int, place int, total string")
    sums = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out, found = centroids.copy(), {(r["cluster"], r["place"]): int(r["total"]) for r in sums.collect()}
    for (c, place), total in found.items():
        if place:
            out[c, place - 1] = total // found[c, 0]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("v", drawn.alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id",
            vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE,
            pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(``id, cluster, distance, measured`` of every usable vector, the final centroids). ``measured`` is the number of
    exact distances of the last round in the vector's block, divided by its vectors: what the pivots left over."""
    whole = stored(integers(vectors, id_col, vector_col, dimensions, scale), "vectors")
    centroids = first_centroids(whole, k, seed)
    id_type = whole.schema["id"].dataType.simpleString()
    shape = f"id {id_type}, cluster int, distance bigint, measured double"
    if not len(centroids):
        return whole.sparkSession.createDataFrame([], shape), centroids
    fixed = far_apart(centroids, pivots)
    table = stored(with_pivots(whole, fixed), "pivot-table")
    for _ in range(rounds):
        centroids = _moved(table, centroids, fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v, far in _blocks(batches):
            found, distance, measured = nearest(v, far, centroids, fixed)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(found, pa.int32()), pa.array(distance), pa.array(np.full(len(v), measured / len(v)))],
                ["id", "cluster", "distance", "measured"])

    return stored(table.mapInArrow(run, shape), "clusters"), centroids


def digests(centroids: np.ndarray) -> Column:
    """Map from a cluster's number to the SHA-256 of its centroid's components."""
    return F.create_map(*[x for c, row in enumerate(centroids.tolist())
                          for x in (F.lit(c), F.sha2(F.lit(",".join(map(str, row))).cast("binary"), 256))])


def report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """Per vector: cluster, squared distance, inertia of its cluster and of all, digest of its centroid."""
    found, centroids = cluster(vectors, id_col=id_col, vector_col=vector_col, **options)
    # At most k rows: the sums of the clusters.
    inertia = {r["cluster"]: int(r["s"]) for r in
               found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    if not inertia:
        return found.select(F.col("id").alias(id_col), "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"),
                            F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    own = F.create_map(*[F.lit(x) for pair in inertia.items() for x in pair])
    return found.select(F.col("id").alias(id_col), "cluster", "distance", own[F.col("cluster")].cast("long").alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                        digests(centroids)[F.col("cluster")].alias("centroid_sha256"))
