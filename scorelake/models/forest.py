"""Random forests grown inside tasks: no limit of depth, nothing that grows with the rows on the driver.

Every tree gets a bag: rows drawn with replacement, the draw of a row being a Poisson number that its id and the tree decide.
A bag has as many draws as the table has rows. Trees are split until their leaves are pure (or too small), so they may be as deep
as the data ask for. A bag of at most ``TASK_VALUES`` feature values becomes a tree in one task; of a larger one the upper nodes are
found by all tasks together, and the rows below each become their part of the tree in one task (:mod:`scorelake.models.bags`).
``maxBagRows`` bounds a bag where a caller asks for it: beyond it every tree draws from all rows with a smaller rate. The model is a
table with a row per node, kept as Parquet.

Rows are scored against blocks of whole trees of at most ``BLOCK_NODES`` nodes: one block is sent to the tasks that
hold the rows; of a larger forest the tasks read one block after the other from the node table and add up the votes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as arrow_fs
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake import config
from scorelake.functions.missing import col
from scorelake.models import bags
from scorelake.models.stages import balanced, class_counts
from scorelake.session import scratch_path

NODES = "tree int, node int, feature int, cut double, left int, right int, share double, gain double"
MAX_BAG_ROWS = 0                   # without limit
PLAIN_ROWS = 100_000               # bags of so many rows are dealt row by row, of more in packed pieces
SHARED_VALUES = 200_000_000       # feature values dealt at once to forests that grow together
TASK_VALUES = 12_000_000           # feature values from which a task grows a tree or a part of one: about 700 MB
BLOCK_NODES = 2_000_000            # 80 MB of nodes
VALUES_HELD = 4_000_000            # feature values that a task holds while it reads a larger forest
_USED = ["tree", "node", "feature", "cut", "left", "right", "share"]


def _uniform(row_id: Column, tree: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), tree, row_id), F.lit(1 << 40)) / F.lit(float(1 << 40))


def draws(row_id: Column, tree: Column, seed: int, rate: float) -> Column:
    """How often a row is in a tree's bag: a Poisson number with mean ``rate``."""
    uniform, out = _uniform(row_id, tree, seed), F.lit(0)
    for limit in bags.limits(rate):
        out = out + (uniform >= F.lit(limit)).cast("int")
    return out


def best_cuts(v: np.ndarray, at: np.ndarray, w0: np.ndarray, w1: np.ndarray, least: int,
              n_nodes: int, tried: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per node the best split by one feature: (sum over both sides of squared class weights over weight, cut); -inf without.
    Rows come in the order of their node ``at`` and, within it, of their value ``v``. ``tried``: nodes that are asked for."""
    a, b = np.cumsum(w0), np.cumsum(w1)
    starts = np.searchsorted(at, np.arange(n_nodes))
    ends = np.searchsorted(at, np.arange(n_nodes), side="right")
    base0, base1 = np.concatenate([[0], a])[starts], np.concatenate([[0], b])[starts]
    all0, all1 = np.concatenate([[0], a])[ends] - base0, np.concatenate([[0], b])[ends] - base1
    rows = np.arange(len(v))
    ok = np.zeros(len(v), bool)
    ok[:-1] = (at[:-1] == at[1:]) & (v[:-1] < v[1:])
    if tried is not None:
        ok &= tried[at]
    if least > 1:
        ok &= (rows - starts[at] + 1 >= least) & (ends[at] - rows - 1 >= least)
    where = np.flatnonzero(ok)
    score, cut = np.full(n_nodes, -np.inf), np.zeros(n_nodes)
    if len(where):
        own = at[where]
        l0, l1 = a[where] - base0[own], b[where] - base1[own]
        r0, r1 = all0[own] - l0, all1[own] - l1
        found = (l0 * l0 + l1 * l1) / np.maximum(l0 + l1, 1e-300) + (r0 * r0 + r1 * r1) / np.maximum(r0 + r1, 1e-300)
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        most = np.maximum.reduceat(found, heads)
        score[own[heads]] = most
        hit = np.flatnonzero(found == np.repeat(most, np.diff([*heads, len(own)])))
        owners, first = np.unique(own[hit], return_index=True)
        k = where[hit[first]]
        middle = (v[k] + v[k + 1]) / 2
        cut[owners] = np.where((middle > v[k]) & (middle < v[k + 1]), middle, v[k])
    return score, cut


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, subset: int, least: int, depth: int, seed: int) -> dict[str, np.ndarray]:
    """One tree, level by level, all nodes of a level at once. Rows with ``x <= cut`` go left. Per node ``subset`` features
    in random order are tried, more until one of them splits. ``depth`` 0 means no limit. Every feature is sorted once: a
    level keeps the rows in the order of (node, value) by parting each node's rows into left and right."""
    rng = np.random.default_rng(seed)
    n_features = x.shape[1]
    both = np.empty(len(y), complex)                         # weights of class 0 and 1, taken from memory together
    both.real, both.imag = weight * (y == 0), weight * (y == 1)
    # Sums of whole multiples are exact, so they don't depend on rows of other nodes: these are left out.
    exact = bool((weight * bags.UNIT == np.rint(weight * bags.UNIT)).all()) and weight.sum() < 1 << 32
    columns: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "share", "gain")}
    rows, node, made, level, ids = np.arange(len(y)), np.zeros(len(y), np.int64), 1, 0, np.zeros(1, np.int64)
    values = np.ascontiguousarray(x.T)
    orders, at = [np.argsort(v, kind="stable") for v in values], node
    to_right = np.zeros(len(y), bool)
    while len(ids):
        n = len(ids)
        t0, t1 = np.bincount(node, both.real[rows], n), np.bincount(node, both.imag[rows], n)
        total = np.maximum(t0 + t1, 1e-300)
        score = np.full((n_features, n), -np.inf)
        cut = np.zeros((n_features, n))
        # Features in a random order per node: the best of the first ``subset``, or the first that splits at all.
        order = rng.random((n, n_features)).argsort(axis=1)
        impure = (t0 > 0) & (t1 > 0) & ((depth == 0) | (level < depth))
        if impure.any():
            some = impure[at]
            at = at[some]
            first = order.argsort(axis=1) < subset

            def sought(f: int, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                own, of = orders[f], at
                if exact:
                    asked = tried[at]
                    own, of = own[asked], at[asked]
                taken = both[own]
                return best_cuts(values[f][own], of, taken.real, taken.imag, least, n, tried)

            for f in range(n_features):
                orders[f] = orders[f][some]
                score[f], cut[f] = sought(f, first[:, f])
            stuck = impure & ~np.isfinite(score).any(axis=0)
            for f in range(n_features) if stuck.any() else []:
                found = sought(f, stuck & ~first[:, f])
                score[f, stuck], cut[f, stuck] = found[0][stuck], found[1][stuck]
        ranked = np.take_along_axis(score.T, order, axis=1)
        valid = np.isfinite(ranked)
        tried = np.where(np.arange(n_features) < subset, ranked, -np.inf)
        chosen = np.where(np.isfinite(tried).any(axis=1), tried.argmax(axis=1), valid.argmax(axis=1))
        feature = order[np.arange(n), chosen]
        split = valid.any(axis=1)
        best = score[feature, np.arange(n)]
        inner = np.flatnonzero(split)
        left = np.full(n, -1)
        left[inner] = made + 2 * np.arange(len(inner))
        columns["feature"].append(np.where(split, feature, -1))
        columns["cut"].append(np.where(split, cut[feature, np.arange(n)], 0.0))
        columns["left"].append(left)
        columns["right"].append(np.where(split, left + 1, -1))
        columns["share"].append(t1 / total)
        columns["gain"].append(np.where(split, np.maximum(np.where(split, best, 0) - (t0 * t0 + t1 * t1) / total, 0), 0))
        kept = split[node]
        rows, own = rows[kept], node[kept]
        place = np.cumsum(split) - 1
        right = x[rows, feature[own]] > cut[feature[own], own]
        node = 2 * place[own] + right
        if len(inner):
            to_right[rows], some = right, split[at]
            at = np.repeat(np.arange(2 * len(inner)), np.bincount(node, minlength=2 * len(inner)))
            lefts = at % 2 == 0
            for f, order in enumerate(orders):
                order = order[some]
                turned, orders[f] = to_right[order], np.empty_like(order)
                orders[f][lefts], orders[f][~lefts] = order[~turned], order[turned]
        ids = np.arange(made, made + 2 * len(inner))
        made += 2 * len(inner)
        level += 1
    return {k: np.concatenate(v) for k, v in columns.items()}


def _nodes(tree: int, numbers: np.ndarray, found: dict[str, np.ndarray]) -> pa.Table:
    kinds = {"feature": pa.int32(), "left": pa.int32(), "right": pa.int32()}
    return pa.table({"tree": pa.array(np.full(len(numbers), tree), pa.int32()), "node": pa.array(numbers, pa.int32()),
                     **{k: pa.array(v, kinds.get(k, pa.float64())) for k, v in found.items()}})


def node_table(rows: DataFrame, trees: int, subset: int, least: int, depth: int, seed: int, rate: float,
               weights: dict[float, float]) -> DataFrame:
    """Nodes of all trees; ``rows`` holds ``row_id, y, x``."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    # A condition is evaluated term by term, so it names the digest once: drawn at all.
    drawn = (rows.select("row_id", "y", "x", numbers).where(_uniform(F.col("row_id"), F.col("tree"), seed) >= F.lit(math.exp(-rate)))
             .select("tree", "row_id", "y", "x", draws(F.col("row_id"), F.col("tree"), seed, rate).alias("times")))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id")                      # the same tree whatever order rows arrive in
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        y = table["y"].to_numpy()
        weight = table["times"].to_numpy() * np.where(y == 1, weights.get(1.0, 1.0), weights.get(0.0, 1.0))
        tree = table["tree"][0].as_py()
        found = grow(x, y, weight, subset, least, depth, seed * 1_000_003 + tree)
        return _nodes(tree, np.arange(len(found["feature"])), found)

    # One partition a tree as far as hashing allows; groups never outgrow a bag.
    return drawn.repartition(trees, "tree").groupBy("tree").applyInArrow(one, NODES)


def large_node_table(rows: DataFrame, n: int, size: int, trees: int, subset: int, least: int, depth: int, seed: int, rate: float,
                     weights: dict[float, float], task_values: int = TASK_VALUES) -> DataFrame:
    """:func:`node_table` for bags of many rows, the rows drawn are the same; ``n`` rows of ``size`` features."""
    each, most = bags.whole_weights(weights), max(1, task_values // size)
    rows = rows.select(bags.as_ids(rows), "y", "x")
    tops = None
    if n * (1 - math.exp(-rate)) > most:
        runs = bags.sorted_runs(rows, size, n).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            tops = bags.grow_tops(runs, trees, size, subset, least, depth, seed, rate, weights, most)
        finally:
            runs.unpersist()
    pieces, groups = bags.dealt(rows, n, size, [bags.Unit(tree, seed, rate) for tree in range(trees)], tops, task_values)
    starts, made = {}, {}
    for tree, node in groups if tops else []:
        # A part of m rows has fewer than 2m nodes.
        starts[tree, node] = made.setdefault(tree, len(tops[tree].feature))
        made[tree] += 2 * tops[tree].ready[node]

    def grow_part(tree: int, node: int, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> pa.Table:
        above = tops[tree].level[node] if tops else 0
        found = grow(x.T, y, times * each[y], subset, least, depth and depth - above, (seed * 1_000_003 + tree) * 1_000_003 + node if node else
                     seed * 1_000_003 + tree)
        shift = starts[tree, node] - 1 if node else 0
        numbers = np.arange(len(found["feature"])) + shift
        numbers[0] = node
        for side in ("left", "right"):
            found[side] = np.where(found[side] >= 0, found[side] + shift, -1)
        return _nodes(tree, numbers, found)

    out = bags.grown(pieces, grow_part, NODES)
    if tops is None:
        return out
    upper = [_nodes(tree, kept, {k: np.array(getattr(top, k))[kept] for k in ("feature", "cut", "left", "right", "share", "gain")})
             for tree, top in enumerate(tops) for kept in [np.array([k for k in range(len(top.feature)) if k not in top.ready])] if len(kept)]
    return out.unionAll(rows.sparkSession.createDataFrame(pa.concat_tables(upper).to_pandas(), NODES))


def stored_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The node table in a folder, by tree or not."""
    return spark.read.schema(NODES).parquet(path).select(*[c.split()[0] for c in NODES.split(", ")])


def node_files(files: list[str]) -> ds.Dataset:
    """The files of a node table, opened in a task."""
    opened = [arrow_fs.FileSystem.from_uri(f) for f in files]
    by_tree = ds.partitioning(pa.schema([("tree", pa.int32())]), flavor="hive")
    return ds.dataset([path for _, path in opened], filesystem=opened[0][0], format="parquet", partitioning=by_tree)


def trees_of(table: ds.Dataset, first: int, end: int) -> pa.Table:
    """Nodes of the trees from number ``first`` to before ``end``."""
    return table.to_table(columns=_USED, filter=(ds.field("tree") >= first) & (ds.field("tree") < end))


class Block:
    """Whole trees as arrays: votes for class 1 of many rows at once, level by level."""

    def __init__(self, tree: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray,
                 right: np.ndarray, share: np.ndarray):
        order = np.lexsort((node, tree))
        numbers, self.roots, counts = np.unique(tree[order], return_index=True, return_counts=True)
        owner = np.repeat(np.arange(len(counts), dtype=np.int64) << 32, counts)
        leaf = feature[order] < 0
        here, keys = np.arange(len(order)), owner + node[order]
        self.feature = np.where(leaf, 0, feature[order])
        self.cut = np.where(leaf, np.inf, cut[order])
        self.left, self.right = (np.where(leaf, here, np.searchsorted(keys, owner + child[order])) for child in (left, right))
        self.share, self.inner = share[order], ~leaf

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' class-1 shares per row."""
        out = np.zeros(len(x))
        for root in self.roots:
            at, rows = np.full(len(x), root), np.arange(len(x))
            while len(rows):
                here = at[rows]
                go = x[rows, self.feature[here]] <= self.cut[here]
                at[rows] = np.where(go, self.left[here], self.right[here])
                rows = rows[self.inner[at[rows]]]
            out += self.share[at]
        return out


def _arrays(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    return [table.column(k).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(k).to_numpy()
            for k in _USED]


class _ForestParams(HasFeaturesCol, HasLabelCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "deepest level, 0 without limit", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "fewest rows of a leaf", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "sqrt, log2 or all", TypeConverters.toString)
    maxBagRows = Param(Params._dummy(), "maxBagRows", "rows a tree draws at most (mean), 0 without limit", TypeConverters.toInt)
    nodes = Param(Params._dummy(), "nodes", "folder of the node table", TypeConverters.toString)
    importances = Param(Params._dummy(), "importances", "share of the gain per feature", TypeConverters.toListFloat)
    nodeCount = Param(Params._dummy(), "nodeCount", "nodes of all trees", TypeConverters.toInt)


_DEFAULTS = dict(featuresCol="features", labelCol="y", numTrees=100, maxDepth=0, minInstancesPerNode=1,
                 featureSubsetStrategy="sqrt", maxBagRows=MAX_BAG_ROWS, seed=config.RANDOM_STATE)


class BaggedForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Balanced random forest over rows with a unique ``row_id``."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", numTrees=100, maxDepth=0, minInstancesPerNode=1,
                 featureSubsetStrategy="sqrt", maxBagRows=MAX_BAG_ROWS, seed=config.RANDOM_STATE):
        super().__init__()
        self._setDefault(**_DEFAULTS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        get = lambda name: self.getOrDefault(getattr(self, name))
        counts = class_counts(dataset, get("labelCol"))
        n = sum(counts.values())
        if not n:
            raise ValueError("no rows to fit on")
        rows = self._rows(dataset)
        size = len(rows.select("x").first()["x"])
        path = scratch_path(dataset.sparkSession, "forest")
        rate = self._rate(n)
        given = (get("numTrees"), self._subset(size), get("minInstancesPerNode"), get("maxDepth"), get("seed"), rate, balanced(counts))
        grown = node_table(rows, *given) if n * rate <= PLAIN_ROWS else large_node_table(rows, n, size, *given)
        grown.write.partitionBy("tree").parquet(path)
        nodes = stored_nodes(dataset.sparkSession, path)
        return self._model(path, size, _importances(nodes.withColumn("model", F.lit(0))).get(0, {}), nodes.count())

    def _rows(self, dataset: DataFrame, *more: Column) -> DataFrame:
        return dataset.select("row_id", col(self.getOrDefault(self.labelCol)).cast("int").alias("y"),
                              vector_to_array(col(self.getOrDefault(self.featuresCol))).alias("x"), *more)

    def _subset(self, size: int) -> int:
        subsets = {"sqrt": max(1, int(math.sqrt(size))), "log2": max(1, int(math.log2(size))), "all": size}
        return subsets[self.getOrDefault(self.featureSubsetStrategy)]

    def _rate(self, n: int) -> float:
        most = self.getOrDefault(self.maxBagRows)
        return min(1.0, most / n) if most else 1.0

    def _model(self, path: str, size: int, found: dict[int, float], count: int) -> BaggedForestModel:
        total = sum(found.values()) or 1.0
        return BaggedForestModel(
            featuresCol=self.getOrDefault(self.featuresCol), labelCol=self.getOrDefault(self.labelCol),
            numTrees=self.getOrDefault(self.numTrees), nodes=path, importances=[found.get(f, 0.0) / total for f in range(size)], nodeCount=count)

    @staticmethod
    def fit_many(dataset: DataFrame, parts: Sequence[Column], jobs: Sequence[tuple[BaggedForest, int]]) -> list[BaggedForestModel]:
        """A model per (forest, place of its part): forests of a search, that share columns. As many grow together as deal at most
        ``SHARED_VALUES`` feature values; one that deals more is fitted alone."""
        label = jobs[0][0].getOrDefault(jobs[0][0].labelCol)
        counts = [class_counts(dataset.where(part), label) for part in parts]
        if not all(sum(c.values()) for c in counts):
            raise ValueError("no rows to fit on")
        within = F.array(*[F.coalesce(part, F.lit(False)) for part in parts]).alias("within")
        rows = jobs[0][0]._rows(dataset, within)
        size, n = len(rows.select("x").first()["x"]), max(sum(c.values()) for c in counts)
        rows = rows.select(bags.as_ids(rows), "y", "x", "within")
        chunks, filled = [], math.inf
        for job in jobs:
            values = n * size * job[0].getOrDefault(job[0].numTrees)
            if filled + values > SHARED_VALUES:
                chunks, filled = [*chunks, []], 0
            chunks[-1].append(job)
            filled += values
        return [model for chunk in chunks for model in (
            [chunk[0][0].fit(dataset.where(parts[chunk[0][1]]))] if len(chunk) == 1 else _grown_together(rows, counts, size, chunk))]


def _grown_together(rows: DataFrame, counts: Sequence[dict[float, int]], size: int, jobs: Sequence[tuple[BaggedForest, int]]) -> list[BaggedForestModel]:
    """Models of small bags, in one deal of the rows."""
    spark, units, given = rows.sparkSession, [], []
    for number, (forest, part) in enumerate(jobs):
        get = lambda name: forest.getOrDefault(getattr(forest, name))  # noqa: B023, E731
        each = bags.whole_weights(balanced(counts[part]))
        units += [bags.Unit(tree, get("seed"), forest._rate(sum(counts[part].values())), part) for tree in range(get("numTrees"))]
        given += [(number, each, forest._subset(size), get("minInstancesPerNode"), get("maxDepth"))] * get("numTrees")
    pieces, _ = bags.dealt(rows, max(sum(c.values()) for c in counts), size, units, None, TASK_VALUES)

    def grow_unit(unit: int, _: int, x: np.ndarray, y: np.ndarray, times: np.ndarray) -> pa.Table:
        number, each, *limits = given[unit]
        found = grow(x.T, y, times * each[y], *limits, units[unit].seed * 1_000_003 + units[unit].tree)
        nodes = _nodes(units[unit].tree, np.arange(len(found["feature"])), found)
        return nodes.append_column("model", pa.array(np.full(len(nodes), number), pa.int32()))

    path = scratch_path(spark, "forests")
    bags.grown(pieces, grow_unit, f"{NODES}, model int").write.partitionBy("model").parquet(path)
    nodes = spark.read.schema(f"{NODES}, model int").parquet(path)
    shares, sizes = _importances(nodes), {r["model"]: r["n"] for r in nodes.groupBy("model").agg(F.count("*").alias("n")).collect()}
    return [forest._model(f"{path}/model={number}", size, shares.get(number, {}), sizes[number]) for number, (forest, _) in enumerate(jobs)]


def _importances(nodes: DataFrame) -> dict[int, dict[int, float]]:
    """Per model a sum for each feature: per tree the gains add up to one, trees count alike."""
    shares = nodes.where("feature >= 0").groupBy("model", "tree", "feature").agg(F.sum("gain").alias("g"))
    whole = shares.groupBy("model", "tree").agg(F.sum("g").alias("all")).where("all > 0")
    out: dict[int, dict[int, float]] = {}
    for r in shares.join(whole, ["model", "tree"]).groupBy("model", "feature").agg(F.sum(F.col("g") / F.col("all")).alias("v")).collect():
        out.setdefault(r["model"], {})[r["feature"]] = r["v"]
    return out


class BaggedForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """Adds ``probability`` (mean of the leaves' class shares) and ``prediction``."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", numTrees=100, nodes=None, importances=None, nodeCount=0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="y")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self.getOrDefault(self.importances))

    @property
    def getNumTrees(self) -> int:
        return self.getOrDefault(self.numTrees)

    def _probability(self, votes: Column) -> Column:
        return votes / self.getOrDefault(self.numTrees)

    def node_rows(self, spark) -> DataFrame:
        """The node table: ``tree, node, feature, cut, left, right, share, gain``; a leaf has feature -1."""
        return stored_nodes(spark, self.getOrDefault(self.nodes))

    def _transform(self, dataset, block_nodes: int = BLOCK_NODES):
        nodes, x = self.node_rows(dataset.sparkSession), vector_to_array(col(self.getOrDefault(self.featuresCol)))
        near = self.getOrDefault(self.nodeCount) <= block_nodes
        scored = dataset.withColumn("probability", self._near(nodes, x) if near else self._dealt(nodes, x, block_nodes))
        scored = scored.withColumn("probability", self._probability(F.col("probability")))
        both = array_to_vector(F.array(F.lit(1.0) - F.col("probability"), F.col("probability")))
        return (scored.withColumn("prediction", (F.col("probability") > 0.5).cast("double"))
                .withColumn("probability", both))

    def _near(self, nodes: DataFrame, x: Column) -> Column:
        """One block, sent to every task: its size was counted when the forest was grown."""
        sent = nodes.sparkSession.sparkContext.broadcast(_arrays(nodes.toArrow()))
        built: list[Block] = []

        @F.pandas_udf("double")
        def vote(x: pd.Series) -> pd.Series:
            if not built:
                built.append(Block(*sent.value))
            return pd.Series(built[0].votes(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

        return vote(x)

    def _dealt(self, nodes: DataFrame, x: Column, block_nodes: int) -> Column:
        """Rows stay where they are: a task holds as many as ``VALUES_HELD`` allows and adds up the votes of one block of trees
        after the other, read from the node table. So rows and trees are shuffled nowhere, however large the forest."""
        files, trees = nodes.inputFiles(), self.getOrDefault(self.numTrees)
        blocks = min(trees, math.ceil(self.getOrDefault(self.nodeCount) / block_nodes))
        edges = [trees * k // blocks for k in range(blocks + 1)]

        @F.pandas_udf("double")
        def vote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table = node_files(files)

            def voted(held: list[np.ndarray]) -> Iterator[pd.Series]:
                values = np.concatenate(held)
                votes = np.zeros(len(values))
                for first, end in zip(edges, edges[1:]):
                    votes += Block(*_arrays(trees_of(table, first, end))).votes(values)
                yield from (pd.Series(part) for part in np.split(votes, np.cumsum([len(v) for v in held])[:-1]))

            held: list[np.ndarray] = []
            for batch in batches:
                if not len(batch):
                    yield pd.Series([], dtype=float)
                    continue
                held.append(np.stack(batch.to_numpy()))
                if sum(v.size for v in held) >= VALUES_HELD:
                    yield from voted(held)
                    held = []
            if held:
                yield from voted(held)

        return vote(x)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    """Parameters as usual, the node table beside them."""

    def __init__(self, instance: BaggedForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.node_rows(self.sparkSession).write.mode("overwrite").partitionBy("tree").parquet(f"{path}/nodes")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BaggedForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._set(nodes=f"{path}/nodes")
        return model
