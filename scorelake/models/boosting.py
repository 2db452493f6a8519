"""Boosted trees with second-order gains, grown level by level over binned rows.

Features are cut into at most ``maxBins`` bins: at every value where a feature has that few, else at quantiles. Rows are kept
as blocks of packed columns, one per Arrow batch. Before each tree one pass takes the margins one tree further and keeps gradient
and Hessian of the logistic loss with the rows. In each level one pass adds them up per (node, feature, bin), for one of two
children only: the other one's sums are what is left of the parent's. Tasks add up their blocks, and for many tasks a tree of
tasks adds up those sums (hundreds of short jobs per model: an RDD of blocks starts them several times faster than a DataFrame plan). The driver receives one table of
``nodes x features x bins`` per level and picks the cuts. Sums are whole multiples of ``1 / UNIT``, so a tree doesn't
depend on the order of adding.

A cut's gain is ``GL^2 / (HL + r) + GR^2 / (HR + r) - G^2 / (H + r)`` with ridge term ``r``; a leaf's value is ``-G / (H + r)``
times the step. Columns are drawn per tree, rows per tree by a digest of their id. Margins are stored with the rows every
``KEEP`` trees, so a lost task goes back a few trees only. What the driver holds depends on trees and depth, not on rows.

Models over parts of one table (the folds of a cross-validation) grow side by side: every part has blocks of its own, and one job adds
up a level of all models. So their jobs are those of one model, and each model is the one that a fit on its part alone gives.
"""

from __future__ import annotations

import gc
import random
from collections.abc import Generator, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import config
from scorelake.functions.missing import col
from scorelake.models.forest import NODES, BaggedForestModel
from scorelake.models.stages import class_counts
from scorelake.session import scratch_path

UNIT = 1 << 20
KEEP = 10
SHARED_ROWS = 20_000_000           # rows that models of a search hold together: about 800 MB
FEW_PARTS = 64                     # sums of so many tasks are added up by the driver, of more by tasks first
LEAST_GAIN = 1e-6


def bin_cuts(rows: DataFrame, size: int, bins: int) -> list[np.ndarray]:
    """Rising cuts per feature (column ``x``); a value falls into the bin of the first cut that isn't below it."""
    estimates = rows.agg(*[F.approx_count_distinct(F.col("x")[f]).alias(f"d{f}") for f in range(size)]).first()
    shares = [k / bins for k in range(1, bins)]
    few = [f for f in range(size) if (estimates[f"d{f}"] or 0) <= 1.5 * bins]
    found: dict[int, list[float]] = {}
    for f in few:
        values = [r["v"] for r in rows.select(F.col("x")[f].alias("v")).distinct().limit(bins + 1).collect()]
        if len(values) <= bins:
            found[f] = sorted(values)[:-1]
    many = [f for f in range(size) if f not in found]
    if many:
        quantiles = rows.agg(*[F.percentile_approx(F.col("x")[f], shares, 20 * bins).alias(f"q{f}") for f in many]).first()
        found.update({f: sorted(set(quantiles[f"q{f}"] or [])) for f in many})
    return [np.array(found[f], float) for f in range(size)]


class Tree:
    """Inner nodes (feature, bin) and leaf values by heap number: the children of k are 2k and 2k + 1."""

    def __init__(self):
        self.inner: dict[int, tuple[int, int]] = {}
        self.value: dict[int, float] = {1: 0.0}
        self.gain: dict[int, float] = {}

    def nodes(self, binned: np.ndarray) -> np.ndarray:
        """Number of the leaf that each row falls into."""
        at = np.ones(len(binned), np.int64)
        highest = max(self.value, default=1)
        # A leaf leads to itself: its cut lies above all bins.
        feature, cut, left = np.zeros(highest + 1, np.int64), np.full(highest + 1, np.iinfo(np.int16).max), np.arange(highest + 1)
        for k, (f, b) in self.inner.items():
            feature[k], cut[k], left[k] = f, b, 2 * k
        cut, flat, heads = cut.astype(np.int16), binned.reshape(-1), np.arange(len(binned)) * binned.shape[1]
        for _ in range(max((k.bit_length() for k in self.inner), default=0)):
            at = left[at] + (flat[heads + feature[at]] > cut[at])
        return at

    def margins(self, binned: np.ndarray) -> np.ndarray:
        values = np.zeros(max(self.value) + 1)
        values[list(self.value)] = list(self.value.values())
        return values[self.nodes(binned)]


class Block:
    """Rows of one batch that belong to one part: bins, labels, margins and a digest of the ids."""

    def __init__(self, row):
        self.part = row["part"]
        self.y, self.margin, self.digest = (np.frombuffer(row[k], t) for k, t in (("y", np.int8), ("margin", np.float64), ("digest", np.int64)))
        self.bins = np.frombuffer(row["bins"], np.int16).reshape(len(self.y), -1)
        self.g = self.h = np.zeros(0, np.int32)

    def aim(self, round_: Sequence[Tree] | dict[int, Tree] | None, positive: float, taken: tuple[int, int]) -> Block:
        """The block before the next tree: margins with the last one of its part, gradient and Hessian in whole units (0 for rows
        that aren't drawn)."""
        if round_ is not None:
            self.margin = self.margin + round_[self.part].margins(self.bins)
        number, limit = taken
        drawn = (self.digest ^ (number * 0x2545F4914F6CDD1D & (1 << 63) - 1)) * 0x9E3779B1 >> 11 & (1 << 30) - 1
        p = 1 / (1 + np.exp(-self.margin))
        weight = np.where(drawn < limit, np.where(self.y == 1, positive, 1.0), 0.0)
        # Every level reads them from the worker's disk or memory again: four bytes where the largest weight allows it.
        whole = np.int32 if max(positive, 1.0) * UNIT < 1 << 31 else np.int64
        self.g, self.h = (np.rint(v * weight * UNIT).astype(whole) for v in (p - self.y, np.maximum(p * (1 - p), 1e-16)))
        return self


BLOCK = "y binary, margin binary, digest binary, bins binary, part int"


def packed(values: DataFrame, cuts: Sequence[Sequence[np.ndarray]]) -> DataFrame:
    """Blocks of ``y, digest, x`` rows, per part with the cuts of that part; ``parts`` tells for each of several whether a row belongs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, digest = batch.column("y").to_numpy().astype(np.int8), batch.column("digest").to_numpy()
            within = np.ones((batch.num_rows, 1), bool) if len(cuts) == 1 else (
                batch.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            for part, own in enumerate(cuts):
                rows = np.flatnonzero(within[:, part])
                if not len(rows):
                    continue
                binned = np.stack([np.searchsorted(cut, x[rows, f]) for f, cut in enumerate(own)], axis=1).astype(np.int16)
                columns = [pa.array([c.tobytes()], pa.binary()) for c in (y[rows], np.zeros(len(rows)), digest[rows], binned)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([part], pa.int32())], ["y", "margin", "digest", "bins", "part"])

    return values.select("y", "digest", "x", *(["parts"] if len(cuts) > 1 else [])).mapInArrow(run, BLOCK)


def _with_margins(blocks: DataFrame, rounds: Sequence[dict[int, Tree]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = []
            for row in batch.to_pylist():
                block = Block(row)
                trees = [r[block.part] for r in rounds if block.part in r]
                margins.append((block.margin + sum(tree.margins(block.bins) for tree in trees)).tobytes())
            yield batch.set_column(1, "margin", pa.array(margins, pa.binary()))

    return blocks.mapInArrow(run, BLOCK)


def _aimed(rows: RDD, last: dict[int, Tree] | None, given: dict[int, tuple[float, tuple[int, int]]]) -> RDD:
    """Blocks of the parts that go on, before their next tree; ``given`` holds the weight of class 1 and what is drawn."""
    return rows.filter(lambda block: block.part in given).map(lambda block: block.aim(last, *given[block.part]), preservesPartitioning=True)


def part_sums(blocks: RDD, asks: dict[int, tuple[Tree, Sequence[int]]], columns: Sequence[Sequence[int]], bins: Sequence[int]) -> dict[int, np.ndarray]:
    """Per part (key of ``asks``: its tree and the leaves asked for) sums of gradients and Hessians of the rows in these leaves, shape
    (2, nodes, columns, bins); one job for all parts."""
    def run(rows) -> Iterator[list[np.ndarray]]:
        if not gc.get_freeze_count():
            gc.freeze()                 # Spark collects garbage after every task, over all loaded modules: longer than a short task
        places = {}
        for part, (tree, asked) in asks.items():
            places[part] = np.full(max(tree.value) + 1, -1)
            places[part][list(asked)] = np.arange(len(asked))
        sums = {part: np.zeros((2, len(columns[part]), len(asked) * bins[part]), np.int64) for part, (_, asked) in asks.items()}
        for block in rows:
            if block.part not in asks:
                continue
            place = places[block.part][asks[block.part][0].nodes(block.bins)]
            open_ = np.flatnonzero(place >= 0)
            head, binned, both = place[open_] * bins[block.part], block.bins[open_], (block.g[open_].astype(float), block.h[open_].astype(float))
            for k, f in enumerate(columns[block.part]):
                at = head + binned[:, f]
                for total, values in zip(sums[block.part], both, strict=True):
                    # Floats hold sums of these whole numbers exactly: a block is far below 2**33 rows.
                    total[k] += np.bincount(at, values, total.shape[1]).astype(np.int64)
        yield list(sums.values())

    def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        return [x + y for x, y in zip(a, b, strict=True)]

    parts = blocks.mapPartitions(run)
    total = parts.reduce(add) if blocks.getNumPartitions() <= FEW_PARTS else parts.treeReduce(add)
    return {part: found.reshape(2, len(columns[part]), len(asked), bins[part]).swapaxes(1, 2)
            for (part, (_, asked)), found in zip(asks.items(), total, strict=True)}


def level_sums(blocks: RDD, growing: Tree, columns: Sequence[int], bins: int, asked: Sequence[int]) -> np.ndarray:
    """:func:`part_sums` of the only part."""
    return part_sums(blocks, {0: (growing, asked)}, [columns], [bins])[0]


def best_cuts(sums: np.ndarray, columns: Sequence[int], ridge: float, least: float) -> dict[int, tuple]:
    """Per node the cut of largest gain (ties: smaller feature, then bin): feature, bin, gain, and (g, h) of both sides."""
    g, h = sums / UNIT
    gl, hl = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    all_g, all_h = gl[:, :, -1:], hl[:, :, -1:]
    gr, hr = all_g - gl, all_h - hl
    gain = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - all_g * all_g / (all_h + ridge)
    # A cut lies at a bin that has rows of the node.
    gain[(hl < least) | (hr < least) | (sums[1] == 0) | (gain <= LEAST_GAIN)] = -np.inf
    out = {}
    for node, row in enumerate(gain.reshape(len(gain), -1)):
        best = int(row.argmax())
        if np.isfinite(row[best]):
            k, b = divmod(best, gain.shape[2])
            out[node] = columns[k], b, float(row[best]), *((float(x[node, k, b]) for x in (gl, hl, gr, hr)))
    return out


class BoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted classifier over rows with a ``row_id``; ``positiveWeight`` weighs class 1."""

    maxIter = Param(Params._dummy(), "maxIter", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of cuts", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "factor of every tree", TypeConverters.toFloat)
    positiveWeight = Param(Params._dummy(), "positiveWeight", "weight of class 1", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows per tree", TypeConverters.toFloat)
    columnRate = Param(Params._dummy(), "columnRate", "share of the columns per tree", TypeConverters.toFloat)
    ridge = Param(Params._dummy(), "ridge", "penalty of squared leaf values", TypeConverters.toFloat)
    minHessian = Param(Params._dummy(), "minHessian", "smallest Hessian sum of a side", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "most bins of a feature", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", maxIter=100, maxDepth=6, stepSize=0.1, positiveWeight=1.0,
                 subsamplingRate=1.0, columnRate=1.0, ridge=1.0, minHessian=1.0, maxBins=256, seed=config.RANDOM_STATE):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="y", maxIter=100, maxDepth=6, stepSize=0.1, positiveWeight=1.0,
                         subsamplingRate=1.0, columnRate=1.0, ridge=1.0, minHessian=1.0, maxBins=256, seed=config.RANDOM_STATE)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        return self.fit_parts(dataset, [None])[0]

    def fit_parts(self, dataset: DataFrame, parts: Sequence[Column | None]) -> list[BoostedTreesModel]:
        """A model per part, fitted on the rows where that condition holds (None: on all), all models side by side."""
        return _fitted(dataset, parts, [(self, part) for part in range(len(parts))])

    @staticmethod
    def fit_many(dataset: DataFrame, parts: Sequence[Column], jobs: Sequence[tuple[BoostedTrees, int]]) -> list[BoostedTreesModel]:
        """A model per (estimator, place of its part): models of a search, that share columns. As many grow side by side as hold at
        most ``SHARED_ROWS`` rows together, or one."""
        most = max(1, SHARED_ROWS // max(1, dataset.count()))
        return [model for k in range(0, len(jobs), most) for model in _fitted(dataset, parts, jobs[k:k + most])]

    @staticmethod
    def _kept(blocks: DataFrame) -> DataFrame:
        path = scratch_path(blocks.sparkSession, "boosting")
        blocks.write.parquet(path)
        return blocks.sparkSession.read.schema(BLOCK).parquet(path)

    def _growing(self, columns: Sequence[int], bins: int) -> Generator[tuple[Tree, list[int]], np.ndarray, Tree]:
        """Grows a tree: per level it yields the tree and the leaves whose sums it wants, and is sent these."""
        get = lambda name: self.getOrDefault(getattr(self, name))
        tree, ridge, above = Tree(), get("ridge"), {}
        for _ in range(get("maxDepth")):
            # Of two children that with the smaller Hessian is added up, the other is the rest of its parent, exactly.
            pairs = sorted(above)
            asked = [2 * k + above[k][1] for k in pairs] or [1]
            found_sums = yield tree, asked
            nodes = [2 * k + side for k in pairs for side in (0, 1)] or [1]
            sums, places = np.zeros((2, len(nodes), len(columns), bins), np.int64), {k: place for place, k in enumerate(nodes)}
            for place, k in enumerate(asked):
                sums[:, places[k]] = found_sums[:, place]
                if pairs:
                    sums[:, places[k ^ 1]] = above[k // 2][0] - found_sums[:, place]
            found = best_cuts(sums, columns, ridge, get("minHessian"))
            above = {}
            for place, (f, b, gain, gl, hl, gr, hr) in found.items():
                k = nodes[place]
                above[k] = sums[:, place], int(hr < hl)
                tree.inner[k], tree.gain[k] = (f, b), gain
                del tree.value[k]
                for child, g, h in ((2 * k, gl, hl), (2 * k + 1, gr, hr)):
                    tree.value[child] = -g / (h + ridge) * get("stepSize")
            if not found:
                break
        return tree

    def _model(self, spark, trees: Sequence[Tree], cuts: Sequence[np.ndarray]) -> BoostedTreesModel:
        nodes, gains = [], {}
        for number, tree in enumerate(trees):
            for k in sorted({*tree.inner, *tree.value}):
                f, b = tree.inner.get(k, (-1, 0))
                nodes.append((number, k, f, float(cuts[f][b]) if f >= 0 else 0.0, 2 * k if f >= 0 else -1, 2 * k + 1 if f >= 0 else -1,
                              tree.value.get(k, 0.0), tree.gain.get(k, 0.0)))
                if f >= 0:
                    gains.setdefault(f, []).append(tree.gain[k])
        path = scratch_path(spark, "boosted-trees")
        spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(path)
        means = [float(np.mean(gains.get(f, [0.0]))) for f in range(len(cuts))]
        total = sum(means) or 1.0
        return BoostedTreesModel(featuresCol=self.getOrDefault(self.featuresCol), labelCol=self.getOrDefault(self.labelCol),
                                 numTrees=len(trees), nodes=path, importances=[m / total for m in means], nodeCount=len(nodes))


class BoostedTreesModel(BaggedForestModel):
    """The trees' leaf values add up to the log odds of class 1. Importance: mean gain of a feature's cuts."""

    def _probability(self, votes: Column) -> Column:
        return 1 / (1 + F.exp(-votes))


def _fitted(dataset: DataFrame, parts: Sequence[Column | None], jobs: Sequence[tuple[BoostedTrees, int]]) -> list[BoostedTreesModel]:
    """A model per (estimator, place of its part), all side by side: each is the one that a fit on its part alone gives."""
    spark, first = dataset.sparkSession, jobs[0][0]
    own = [dataset if part is None else dataset.where(part) for part in parts]
    for rows in own:
        if not sum(class_counts(rows, first.getOrDefault(first.labelCol)).values()):
            raise ValueError("no rows to fit on")
    get = lambda job, name: jobs[job][0].getOrDefault(getattr(jobs[job][0], name))
    inputs = [F.xxhash64(F.lit(get(0, "seed")), "row_id").alias("digest"), col(get(0, "labelCol")).cast("int").alias("y"),
              vector_to_array(col(get(0, "featuresCol"))).alias("x")]
    size = len(own[0].select(*inputs).select("x").first()["x"])
    with ThreadPool(len(own)) as pool:
        found = pool.map(inheritable_thread_target(spark)(lambda rows: bin_cuts(rows.select(*inputs), size, get(0, "maxBins"))), own)
    cuts = [found[part] for _, part in jobs]
    if len(jobs) > 1:
        within = [F.lit(True) if part is None else F.coalesce(part, F.lit(False)) for part in parts]
        inputs.append(F.array(*[within[part] for _, part in jobs]).alias("parts"))
    blocks = first._kept(packed((own[jobs[0][1]] if len(jobs) == 1 else dataset).select(*inputs), cuts))
    # Equal seeds draw equal columns and rows.
    draws, rounds, done = [random.Random(get(job, "seed")) for job in range(len(jobs))], [], 0
    rows, before, most = blocks.rdd.map(Block), None, max(get(job, "maxIter") for job in range(len(jobs)))
    bins = [max(len(c) for c in own_cuts) + 1 for own_cuts in cuts]
    try:
        for number in range(most):
            columns, given = [()] * len(jobs), {}
            for job, rng in enumerate(draws):
                if number < get(job, "maxIter"):
                    columns[job] = sorted(rng.sample(range(size), max(1, round(get(job, "columnRate") * size))))
                    given[job] = get(job, "positiveWeight"), (rng.getrandbits(60), round(get(job, "subsamplingRate") * (1 << 30)))
            last = rounds[-1] if len(rounds) > done else None
            aimed = _aimed(rows, last, given).persist(StorageLevel.MEMORY_AND_DISK)
            rounds.append(_round(aimed, {job: jobs[job][0]._growing(columns[job], bins[job]) for job in given}, columns, bins))
            if before is not None:
                before.unpersist()
            rows = before = aimed
            if len(rounds) - done >= KEEP and number + 1 < most:
                blocks, done = first._kept(_with_margins(blocks, rounds[done:])), len(rounds)
                rows = blocks.rdd.map(Block)
    finally:
        if before is not None:
            before.unpersist()
    return [jobs[job][0]._model(spark, [trees[job] for trees in rounds if job in trees], own_cuts) for job, own_cuts in enumerate(cuts)]


def _round(rows: RDD, growing: dict[int, Generator], columns: Sequence[Sequence[int]], bins: Sequence[int]) -> dict[int, Tree]:
    """The next tree of every model that goes on; a job for each level."""
    made: dict[int, Tree] = {}
    sums: dict[int, np.ndarray | None] = dict.fromkeys(growing)
    while sums:
        asks = {}
        for job, found in sums.items():
            try:
                asks[job] = growing[job].send(found)
            except StopIteration as end:
                made[job] = end.value
        if not asks:
            break
        sums = {0: level_sums(rows, asks[0][0], columns[0], bins[0], asks[0][1])} if len(bins) == 1 else part_sums(rows, asks, columns, bins)
    return made
