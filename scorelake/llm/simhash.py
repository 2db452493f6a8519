"""SimHash near-duplicates: fingerprints, vantage-point shards, exact pairs within them, connected classes.

Two fingerprints that differ in at most ``RADIUS`` = 4 of 64 bits differ in at most one bit in one of three segments
(22, 21 and 21 bits). So there are three forests, one per segment, and within a forest pairs at segment distance 0 or 1
must meet. A forest is a vantage-point tree over the segments' Hamming distance: a node sends codes at distance
``d <= r`` of its vantage point inside and ``d >= r`` outside. By the triangle bound, codes at distance 1 have vantage
distances that differ by 1 at most, so they share a child: only the boundary shell ``d = r`` visits both shards, all
other branches are pruned. Leaves are shards of the fingerprints; every shard compares whole fingerprints, so results
are exact whatever the trees look like. Vantage points and radii are fitted on a bounded sample (``SAMPLE``).

A shard returns its links as stars (each member and the smallest fingerprint of its local class), never all pairs: a
dense group costs as many rows as it has members. Members of a ball of radius 2 around a vantage point are all linked
(2 + 2 <= 4), so a dense group is taken up ball by ball. Classes across shards come from alternating star contraction,
each step written to the shared folder.

Defined cases: null or empty texts and texts without words have fingerprint zero and are linked like any other; equal
texts and repeated rows share a fingerprint and so a class; an empty table gives no rows; other columns are ignored. A
class is named by its smallest document id (nulls are no names unless all ids of the class are null).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import boxed, map_batches, stored, text_bytes

RADIUS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))      # first bit and width
SAMPLE = 8_192                                # fingerprints on which the trees are fitted
LEAF = 4_000                                  # fingerprints that a shard should hold
SEED = 42

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = re.compile(rb"[^ \t-\r]+")


def fingerprint(raw: bytes, width: int = 4) -> int:
    """Bit k is set if over half of the shingles' XXH64 values have it."""
    line = b" ".join(_WORD.findall(raw.translate(_LOWER)))
    if not line:
        return 0
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist()
    ends.append(len(line))
    if len(ends) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    digest = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[:len(ends) - width])]
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1:], strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k:k + 4096].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (64 bits as a signed long) of every whole text."""
    chosen = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(raw.as_py()) for raw in batch.column(1)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    return map_batches(chosen, f"id {chosen.schema['id'].dataType.simpleString()}, fp long", work)


def _segment(fps: np.ndarray, k: int) -> np.ndarray:
    first, width = SEGMENTS[k]
    return (fps.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << width) - 1)


def _distance(codes, other) -> np.ndarray:
    return np.bitwise_count(codes ^ other)


def fit_tree(codes: np.ndarray, width: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage point and radius of each inner node, in heap order (children of n: 2n + 1 inside, 2n + 2 outside).

    Where a node has few codes of the sample, its point is random and its radius half the width."""
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 1 << width, (1 << depth) - 1, dtype=np.uint64)
    radii = np.full(len(points), width // 2, np.uint8)
    held = {0: codes}
    for node in range(len(points)):
        own = held.pop(node, codes[:0])
        if len(own) >= 32:
            points[node] = own[rng.integers(len(own))]
            radii[node] = np.median(_distance(own, points[node]))
        d = _distance(own, points[node])
        if 2 * node + 2 < len(points):
            held[2 * node + 1], held[2 * node + 2] = own[d <= radii[node]], own[d >= radii[node]]
    return points, radii


def route(codes: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index of a code and leaf, once for every leaf that it belongs to or visits."""
    points, radii = tree
    index, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    for _ in range(int(len(points) + 1).bit_length() - 1):
        d = _distance(codes[index], points[node])
        inside, outside = d <= radii[node], d >= radii[node]
        index = np.concatenate([index[inside], index[outside]])
        node = np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
    return index, node - len(points)


class _Classes:
    """Union-find over positions; the root is the smallest position."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while True:
            above = self.parent[root]
            if (above == root).all():
                self.parent[at] = root
                return root
            root = above

    def join(self, members: np.ndarray) -> None:
        roots = np.unique(self.roots(members))
        self.parent[roots] = roots[0]


def local_classes(fps: np.ndarray, block: int = 256) -> np.ndarray:
    """Position of the smallest member of each one's class, for distinct sorted fingerprints (unsigned order)."""
    codes, n = fps.view(np.uint64), len(fps)
    classes = _Classes(n)
    left, misses, rng = np.arange(n), 0, np.random.default_rng(SEED)
    while len(left) > block and misses < 16:               # dense groups: one ball at a time
        d = _distance(codes[left], codes[left[rng.integers(len(left))]])
        ball = left[d <= 2]
        if len(ball) < 16:
            misses += 1
            continue
        misses = 0
        classes.join(left[d <= RADIUS])
        shell = left[(d > RADIUS) & (d <= RADIUS + 2)]      # only these can still be linked to a member of the ball
        for start in range(0, len(ball), block):
            near = np.zeros(len(shell), bool)
            for at in range(0, len(shell), 65_536):
                part = codes[shell[at:at + 65_536]]
                near[at:at + 65_536] = (_distance(codes[ball[start:start + block], None], part) <= RADIUS).any(axis=0)
            if near.any():
                classes.join(np.concatenate([ball[:1], shell[near]]))
            shell = shell[~near]
        left = left[d > 2]                                  # distances 3 and 4 are joined but may have other links
    for start in range(0, len(left), block):
        rows = left[start:start + block]
        for at in range(start, len(left), 65_536):
            columns = left[at:at + 65_536]
            i, j = np.nonzero(_distance(codes[rows, None], codes[columns]) <= RADIUS)
            apart = rows[i] != columns[j]
            i, j = rows[i[apart]], columns[j[apart]]
            while len(i):                                   # hook the larger root under the smaller, until all agree
                a, b = classes.roots(i), classes.roots(j)
                open_ = a != b
                if not open_.any():
                    break
                i, j, a, b = i[open_], j[open_], a[open_], b[open_]
                np.minimum.at(classes.parent, np.maximum(a, b), np.minimum(a, b))
    return classes.roots(np.arange(n))


def links(distinct: DataFrame, count: int, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """``a, b``: stars that join all pairs of distinct fingerprints (column ``fp``) within ``RADIUS`` bits."""
    depth = min(21, max(0, int(np.ceil(np.log(max(1.0, count / leaf)) / np.log(1 / 0.584)))))   # a child holds 0.584
    drawn = [r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()] if depth else []
    drawn = np.array(drawn, np.int64)
    trees = [fit_tree(_segment(drawn, k), width, depth, SEED + k) for k, (_, width) in enumerate(SEGMENTS)]

    def deal(batch: pa.RecordBatch):
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for k, tree in enumerate(trees):
            index, leaves = route(_segment(fps, k), tree)
            yield pa.RecordBatch.from_arrays([pa.array((leaves * len(trees) + k).astype(np.int64)), pa.array(fps[index])],
                                             ["shard", "fp"])

    def compare(batches):
        """Shards arrive in order; one shard of distinct fingerprints at a time is held (8 bytes each)."""
        held: list[np.ndarray] = []
        current = None

        def finish():
            fps = np.sort(np.concatenate(held).view(np.uint64))
            root = local_classes(fps)
            member = np.flatnonzero(root != np.arange(len(fps)))
            signed = fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[member]), pa.array(signed[root[member]])], ["a", "b"])

        for batch in batches:
            shards, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for own, part in zip(np.split(shards, cuts), np.split(fps, cuts), strict=True):
                if not len(own):
                    continue
                if own[0] != current and held:
                    yield finish()
                    held = []
                current = own[0]
                held.append(part.copy())
        if held:
            yield finish()

    dealt = map_batches(distinct.select("fp"), "shard long, fp long", deal, rows=8192)
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(compare, "a long, b long")


def classes(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of ``edges`` (a, b): alternating stars until nothing changes; roots are minima."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = stored(small, "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF,
                    sample: int = SAMPLE) -> DataFrame:
    """``id, fp, component_id``: the class of each document under links of at most ``RADIUS`` bits."""
    every = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(every.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct-fingerprints")
    found = classes(links(distinct, distinct.count(), leaf, sample))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return every.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: the smallest document id, of rows with equal ids the smallest text, of rows with equal ids and
    texts the smallest digest of their other columns.

    Ids may be null or repeated, so a row is known by its id and the digest of its text, and a class by the least of these."""
    own = boxed(docs, id=id_col, text=text_col)
    digest = F.unhex(F.sha2(text_bytes("text"), 256))
    key = F.struct(F.col("id").isNull().alias("missing"), F.col("id"), digest.alias("digest"))
    found = near_duplicates(own.select(key.alias("key"), "text"), "key", "text")
    kept = found.where(F.col("key.id").eqNullSafe(F.col("component_id.id"))).select(
        F.col("key.id").alias("kept_id"), F.col("key.digest").alias("kept_digest"), F.col("component_id").alias("class")).distinct()
    chosen = own.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (digest == F.col("kept_digest")))
    others = [F.col("row")[c] for c in docs.columns if c not in (id_col, text_col)]
    rest = F.md5(F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(others)]))) if others else F.lit("")
    return chosen.groupBy("class").agg(F.min_by("row", F.struct("text", rest)).alias("row")).select("row.*")
