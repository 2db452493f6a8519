"""Bags of a large table: drawn by the tasks that hold the rows and dealt in packed pieces to the tasks that grow trees.

A task grows a tree, or the part of it below one node, from a bounded number of rows. A bag beyond that is parted by the upper nodes
of its tree first. Their cuts are sought among all values of all drawn rows: rows are stored sorted by each feature, in runs of bounded
size; one pass adds up what every run holds of every open node, a second one tries each cut inside and behind the run, knowing what
the runs before it hold. The driver receives sums per run and open node, and the best cut of each. Weights are whole multiples of
``1 / UNIT``, so sums are exact and a tree doesn't depend on the order of its rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWS = 12                         # a row is drawn at most so many times: beyond 1e-10
UNIT = 1 << 20
RUN_VALUES = 1_000_000             # feature values of a sorted run
PIECES_AT_ONCE = 10
PIECE = "part int, unit int, node int, kinds string, x binary, c binary"
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def limits(rate: float) -> list[float]:
    """A uniform number at or above the k-th limit means at least k + 1 draws: a Poisson number with mean ``rate``."""
    total, term, out = 0.0, math.exp(-rate), []
    for k in range(DRAWS):
        total += term
        out.append(total)
        term *= rate / (k + 1)
    return out


def _turned(v: np.ndarray, bits: int) -> np.ndarray:
    return v << np.uint64(bits) | v >> np.uint64(64 - bits)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def _digest(values: np.ndarray, seed: np.ndarray, size: int) -> np.ndarray:
    """``xxhash64`` of integers of ``size`` bytes."""
    h = seed + _P5 + np.uint64(size)
    if size == 8:
        return _mixed(_turned(h ^ _turned(values * _P2, 31) * _P1, 27) * _P1 + _P4)
    return _mixed(_turned(h ^ (values & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3)


def drawn(ids: np.ndarray, tree: int, seed: int, edges: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows in a tree's bag and how often each is drawn; the draws of :func:`forest.draws` for ids that are longs."""
    whole = lambda v: np.array([v]).astype(np.uint64)
    head = _digest(whole(tree), _digest(whole(seed), whole(42), 4 if -1 << 31 <= seed < 1 << 31 else 8), 4)
    uniform = (_digest(ids.view(np.uint64), head, 8) & np.uint64((1 << 40) - 1)).astype(float) / float(1 << 40)
    rows = np.flatnonzero(uniform >= edges[0])
    uniform, times = uniform[rows], np.ones(len(rows), np.int8)
    for edge in edges[1:]:
        more = uniform >= edge
        if not more.any():
            break
        times += more
    return rows, times


def whole_weights(weights: dict[float, float]) -> np.ndarray:
    """Weights of the classes 0 and 1 in whole multiples of ``1 / UNIT``."""
    return np.array([max(1, round(weights.get(float(c), 1.0) * UNIT)) / UNIT for c in (0, 1)])


def as_ids(rows: DataFrame) -> Column:
    """The row id as a long that is never null."""
    own = F.col("row_id") if dict(rows.dtypes)["row_id"] == "bigint" else F.xxhash64("row_id")
    return F.coalesce(own, F.lit(0).cast("long")).alias("id")


class Top:
    """Upper nodes of a tree by number, the root is 0; ``ready`` are the leaves that are grown further in a task of their own."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.share, self.gain, self.level = [-1], [0.0], [-1], [-1], [0.0], [0.0], [0]
        self.ready: dict[int, int] = {}

    def split(self, node: int, feature: int, cut: float, gain: float) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node], self.gain[node] = feature, cut, first, first + 1, gain
        for column, value in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.share, 0.0), (self.gain, 0.0),
                              (self.level, self.level[node] + 1)):
            column += [value, value]
        return first, first + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Number of the leaf that each row falls into."""
        at, here = np.zeros(len(x), np.int64), np.arange(len(self.feature))
        leaf = np.array(self.feature) < 0
        feature, cut = np.where(leaf, 0, self.feature), np.where(leaf, np.inf, self.cut)
        left, right = np.where(leaf, here, self.left), np.where(leaf, here, self.right)
        rows = np.arange(len(x))
        for _ in range(max(self.level)):
            at = np.where(x[rows, feature[at]] > cut[at], right[at], left[at])
        return at


class Run:
    """Rows of a part of the table in the order of one feature."""

    def __init__(self, row):
        self.feature, self.part = row["feature"], row["part"]
        self.y, self.ids = np.frombuffer(row["y"], np.int8), np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["x"], np.float64).reshape(len(self.y), -1)

    def asked(self, tree: int, top: Top, nodes: Sequence[int], seed: int, edges: Sequence[float]) -> tuple[np.ndarray, ...]:
        """Drawn rows of the nodes in the order of (node, value): place of the node, value, draws per class."""
        rows, times = drawn(self.ids, tree, seed, edges)
        slots = np.full(len(top.feature), -1)
        slots[list(nodes)] = np.arange(len(nodes))
        at = slots[top.leaves(self.x[rows])]
        own = np.flatnonzero(at >= 0)
        own = own[np.argsort(at[own], kind="stable")]
        rows, times = rows[own], times[own].astype(float)
        return at[own], self.x[rows, self.feature], times * (self.y[rows] == 0), times * (self.y[rows] == 1)


def sorted_runs(rows: DataFrame, size: int, n: int) -> RDD:
    """All rows once per feature, in its order; ``rows`` holds ``id, y, x``. Equal values may lie in several runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            x, y, ids = (np.concatenate([get(b) for b in held]) for get in (
                lambda b: b.column("x").flatten().to_numpy(zero_copy_only=False), lambda b: b.column("y").to_numpy().astype(np.int8),
                lambda b: b.column("id").to_numpy()))
            columns = [held[0].column(k).slice(0, 1) for k in ("feature", "part")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([v.tobytes()], pa.binary()) for v in (x, y, ids))],
                                             ["feature", "part", "x", "y", "ids"])

    parts, out = max(1, math.ceil(n * size / RUN_VALUES)), None
    for f in range(size):
        by = [F.col("x")[f], F.col("id")]
        ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        found = ordered.select(F.lit(f).alias("feature"), F.spark_partition_id().alias("part"), "id", "y", "x").mapInArrow(
            run, "feature int, part int, x binary, y binary, ids binary")
        out = found if out is None else out.unionAll(found)
    return out.rdd.map(Run)


def _best_cuts(at: np.ndarray, v: np.ndarray, w0: np.ndarray, w1: np.ndarray, around: np.ndarray, least: int, each: np.ndarray) -> list[tuple]:
    """Per node its best cut inside or behind a run: (place, score, cut, rows and draws per class to the left). ``around`` holds per node
    rows and draws per class before the run, in all, and the first value behind it (nan: none)."""
    before, b0, b1, whole, t0, t1, behind = around.T
    places = np.arange(len(around))
    starts, ends = np.searchsorted(at, places), np.searchsorted(at, places, side="right")
    a, b = np.concatenate([[0], np.cumsum(w0)]), np.concatenate([[0], np.cumsum(w1)])
    following, some = np.append(v[1:], np.nan), ends > starts
    following[ends[some] - 1] = behind[some]
    left = np.arange(len(v)) - starts[at] + 1 + before[at]
    where = np.flatnonzero((v < following) & (left >= least) & (whole[at] - left >= least))
    if not len(where):
        return []
    own = at[where]
    l0, l1 = (c[where + 1] - c[starts[own]] + o[own] for c, o in ((a, b0), (b, b1)))
    wl0, wl1, wr0, wr1 = l0 * each[0], l1 * each[1], (t0[own] - l0) * each[0], (t1[own] - l1) * each[1]
    score = (wl0 * wl0 + wl1 * wl1) / (wl0 + wl1) + (wr0 * wr0 + wr1 * wr1) / (wr0 + wr1)
    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out = []
    for first, end in zip(heads, [*heads[1:], len(own)]):
        k = first + int(score[first:end].argmax())
        low, high = v[where[k]], following[where[k]]
        middle = (low + high) / 2
        out.append((int(own[k]), float(score[k]), float(middle if low < middle < high else low), int(left[where[k]]), float(l0[k]), float(l1[k])))
    return out


def grow_tops(runs: RDD, trees: int, size: int, subset: int, least: int, depth: int, seed: int, rate: float, weights: dict[float, float],
              most: int) -> list[Top]:
    """The upper nodes of all trees, until no leaf that may be split has more than ``most`` rows. Features are tried as in
    :func:`forest.grow`: the best of ``subset`` drawn ones, or the first of the others that splits at all."""
    edges, each, spark = limits(rate), whole_weights(weights), runs.context
    tops = [Top() for _ in range(trees)]
    order = lambda tree, node: np.random.default_rng([seed, tree, node]).permutation(size).tolist()
    open_ = {(tree, 0): (order(tree, 0), True) for tree in range(trees)}
    while open_:
        asks: dict[int, dict[int, list[int]]] = {}
        for (tree, node), (tried, first) in open_.items():
            for f in tried[:subset] if first else tried[subset:]:
                asks.setdefault(f, {}).setdefault(tree, []).append(node)
        sent = spark.broadcast(({tree: tops[tree] for tree, _ in open_}, asks))

        def totals(run: Run):
            own_tops, own_asks = sent.value
            for tree, nodes in own_asks.get(run.feature, {}).items():
                at, v, w0, w1 = run.asked(tree, own_tops[tree], nodes, seed, edges)
                starts, ends = (np.searchsorted(at, np.arange(len(nodes)), side=s) for s in ("left", "right"))
                for k in np.flatnonzero(ends > starts).tolist():
                    rows = slice(starts[k], ends[k])
                    yield tree, nodes[k], run.feature, run.part, int(ends[k] - starts[k]), float(w0[rows].sum()), float(w1[rows].sum()), float(v[starts[k]])

        held: dict[tuple, list] = {}
        for tree, node, f, *of_run in runs.flatMap(totals).collect():
            held.setdefault((tree, node, f), []).append(of_run)
        around: dict[tuple[int, int], dict[tuple[int, int], tuple]] = {}
        whole: dict[tuple[int, int], tuple] = {}
        for (tree, node, f), found in held.items():
            found.sort()
            counts = np.array([of_run[1:4] for of_run in found])
            total, before = counts.sum(axis=0), np.cumsum(counts, axis=0) - counts
            whole[tree, node] = tuple(total)
            if total[1] and total[2]:
                for k, of_run in enumerate(found):
                    around.setdefault((f, of_run[0]), {})[tree, node] = (*before[k], *total, found[k + 1][4] if k + 1 < len(found) else math.nan)
        told = spark.broadcast(around)

        def cuts(run: Run):
            mine: dict[int, dict[int, tuple]] = {}
            for (tree, node), values in told.value.get((run.feature, run.part), {}).items():
                mine.setdefault(tree, {})[node] = values
            for tree, of_nodes in mine.items():
                rows = run.asked(tree, sent.value[0][tree], list(of_nodes), seed, edges)
                for place, *found in _best_cuts(*rows, np.array(list(of_nodes.values())), least, each):
                    yield tree, list(of_nodes)[place], run.feature, run.part, found

        best: dict[tuple[int, int], dict[int, tuple]] = {}
        for tree, node, f, part, found in runs.flatMap(cuts).collect() if around else []:
            other = best.setdefault((tree, node), {}).get(f)
            if other is None or (-found[0], part) < other[0]:
                best[tree, node][f] = (-found[0], part), found
        sent.unpersist()
        told.unpersist()
        following = {}
        for (tree, node), (tried, first) in open_.items():
            top, found = tops[tree], best.get((tree, node), {})
            rows, t0, t1 = whole.get((tree, node), (0, 0.0, 0.0))
            w0, w1 = t0 * each[0], t1 * each[1]
            top.share[node] = w1 / (w0 + w1) if rows else 0.0
            if not found:
                if first and t0 and t1 and subset < size:
                    following[tree, node] = tried, False
                continue
            f = min(found, key=lambda f: (found[f][0][0], tried.index(f))) if first else min(found, key=tried.index)
            score, cut, l_rows, l0, l1 = found[f][1]
            children = top.split(node, f, cut, max(score - (w0 * w0 + w1 * w1) / (w0 + w1), 0.0))
            for child, (n, c0, c1) in zip(children, ((l_rows, l0, l1), (int(rows) - l_rows, t0 - l0, t1 - l1))):
                top.share[child] = c1 * each[1] / (c0 * each[0] + c1 * each[1])
                if c0 and c1 and (not depth or top.level[child] < depth):
                    if n > most:
                        following[tree, child] = order(tree, child), True
                    else:
                        top.ready[child] = n
        open_ = following
    return tops


class Unit(NamedTuple):
    """A tree to grow, from the rows of a part of the table (its place in ``within``; None: all rows)."""
    tree: int
    seed: int
    rate: float
    part: int | None = None


def dealt(rows: DataFrame, n: int, size: int, units: Sequence[Unit], tops: Sequence[Top] | None, most: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Packed pieces of the units' bags of ``id, y, x`` rows (with ``within`` where units have parts), and the (unit, node) that they are for;
    node 0 is a whole tree. Pieces come in that order within partitions of at most ``most`` feature values, or of one piece of a tree."""
    groups = [(unit, node) for unit in range(len(units)) for node in ([0] if tops is None else tops[unit].ready)]
    held = [n * (1 - math.exp(-units[unit].rate)) * size if tops is None else tops[unit].ready[node] * size for unit, node in groups]
    aim, places, filled = min(most, sum(held) / (8 * rows.sparkSession.sparkContext.defaultParallelism)), [], math.inf
    for values in held:
        filled, place = (values, (places[-1] if places else -1) + 1) if filled + values > aim else (filled + values, places[-1])
        places.append(place)
    parts = {of: number for number, of in enumerate(groups)}
    edges = {unit.rate: limits(unit.rate) for unit in units}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = None if tops is None else [np.array([parts.get((unit, k), -1) for k in range(len(top.feature))]) for unit, top in enumerate(tops)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, ids = batch.column("y").to_numpy().astype(np.int8), batch.column("id").to_numpy()
            columns = [np.ascontiguousarray(v) for v in x.T]
            # Values that single precision holds are sent in it.
            columns = [short if np.array_equal(short, v) else v for v, short in ((v, v.astype(np.float32)) for v in columns)]
            kinds = ",".join(v.dtype.str for v in columns)
            within = None
            if any(unit.part is not None for unit in units):
                within = batch.column("within").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            made: list[tuple] = []
            for number, unit in enumerate(units):
                own, times = drawn(ids, unit.tree, unit.seed, edges[unit.rate])
                if unit.part is not None:
                    inside = within[own, unit.part]
                    own, times = own[inside], times[inside]
                of = None if tops is None else numbers[number][tops[number].leaves(x[own])]
                for k in [number] if of is None else np.unique(of[of >= 0]).tolist():
                    some, drawn_times = (own, times) if of is None else (own[of == k], times[of == k])
                    if len(some):
                        made.append((places[k], *groups[k], kinds, b"".join(v[some].tobytes() for v in columns), (drawn_times << 1 | y[some]).tobytes()))
                if len(made) >= PIECES_AT_ONCE:
                    yield _batch(made)
                    made = []
            if made:
                yield _batch(made)

    pieces = rows.mapInArrow(run, PIECE).repartitionById(places[-1] + 1 if places else 1, F.col("part"))
    return pieces.sortWithinPartitions("unit", "node"), groups


def _batch(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], [c.split()[0] for c in PIECE.split(", ")])


def _unpacked(pieces: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (a row per feature), classes and draws."""
    values, codes = [], [np.frombuffer(c.as_buffer(), np.int8) for _, _, c in pieces]
    for (kinds, x, _), code in zip(pieces, codes):
        at, found = 0, []
        for kind in map(np.dtype, kinds.as_py().split(",")):
            found.append(np.frombuffer(x.as_buffer(), kind, len(code), at))
            at += len(code) * kind.itemsize
        values.append(found)
    code, out = np.concatenate(codes), np.empty((len(values[0]), sum(map(len, codes))))
    for f in range(len(out)):
        np.concatenate([found[f] for found in values], out=out[f], casting="same_kind")
    return out, code & 1, code >> 1


def grown(pieces: DataFrame, grow: Callable[..., pa.Table], schema: str) -> DataFrame:
    """``grow`` of the rows of every unit and node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in ("unit", "node")), *(batch.column(k) for k in ("kinds", "x", "c")))

        for of, found in itertools.groupby(every(), lambda piece: piece[:2]):
            yield from grow(*of, *_unpacked([piece[2:] for piece in found])).to_batches()

    return pieces.mapInArrow(run, schema)
