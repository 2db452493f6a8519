"""Linear support vector machines on random Fourier features, many fitted side by side.

A machine minimises what MLlib's ``LinearSVC`` does (weighted hinge loss, ridge term, features centred and scaled by their deviation) by the same
kind of steps (quasi-Newton, backtracking search) and to the same tolerance. Machines of one table, here those without a calibration
fold in each part of the table, take their steps together: one job sums losses and gradients of all of them. Tasks map the features
anew each time instead of holding mapped rows, which are ``components / features`` times as large. The driver receives a row of sums per
machine.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame

FEW_PARTS = 64                     # sums of so many tasks are added up by the driver, of more by tasks first
CHUNK = 2048                       # rows mapped at once
CACHED = 256                       # of these, rows whose angles stay in a core's cache from step to step
MEMORY = 10                        # steps that a curvature estimate remembers
SEEN = 20                          # values that a fit compares its own with
Steps = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]
BLOCK = "x binary, y binary, fold binary, within binary"


@dataclass
class Machine:
    """Without one calibration ``fold`` (None: with all) of a ``part``; a weight per class, the ridge term, mean and 1 / deviation per feature."""
    part: int
    fold: int | None
    weights: np.ndarray
    ridge: float
    mean: np.ndarray
    scale: np.ndarray
    total: float

    def plain(self, point: np.ndarray) -> np.ndarray:
        """Weights and intercept for the features as they are."""
        weights = point[:-1] * self.scale
        return np.append(weights, point[-1] - weights @ self.mean)


class _SearchFailed(Exception):
    pass


def _search(at, value: float, slope: float, step: float, shrink: float) -> Generator:
    """A step that lowers the value enough and flattens the slope (Wolfe's strong conditions): value and gradient behind it."""
    for _ in range(21):
        x, direction = at(step)
        found, grad = yield x
        steep = float(grad @ direction)
        if found > value + step * slope * 1e-4:
            factor = shrink
        elif steep < 0.9 * slope:
            factor = 2.1
        elif steep > -0.9 * slope:
            factor = shrink
        else:
            return x, found, grad
        step *= factor
        if not 1e-10 <= step <= 1e10:
            break
    raise _SearchFailed


def minimised(size: int, most: int, tolerance: float) -> Steps:
    """Yields points, is sent value and gradient there, returns the last point. Quasi-Newton steps that take a coordinate to zero where
    it would change its sign; ends where the last ``SEEN`` values lie within ``tolerance`` of the first value."""
    x = np.zeros(size)
    value, grad = yield x
    start, seen, history, done, failed = value, [math.inf], [], 0, False
    while True:
        close = len(seen) >= 2 and abs(value - max(seen)) <= tolerance * start
        if done >= most or close or np.linalg.norm(grad) <= max(tolerance * value, 1e-8):
            return x
        q, used = grad.copy(), []
        for s, g in reversed(history):
            a = (s @ q) / (s @ g)
            q -= a * g
            used.append(a)
        if history:
            s, g = history[-1]
            q *= (s @ g) / (g @ g)
        for (s, g), a in zip(history, reversed(used), strict=True):
            q += s * (a - (g @ q) / (s @ g))
        direction = np.where(-q * grad < 0, -q, 0.0)
        orthant = np.where(x != 0, np.sign(x), np.sign(-grad))

        def at(step: float, x=x, direction=direction, orthant=orthant) -> tuple[np.ndarray, np.ndarray]:
            moved = x + direction * step
            return np.where(np.sign(moved) == orthant, moved, 0.0), direction

        try:
            first = done == 0
            moved, found, turned = yield from _search(at, value, float(grad @ direction), 0.5 / np.linalg.norm(grad) if first else 1.0,
                                                      0.1 if first else 0.5)
        except _SearchFailed:
            if failed:
                return x
            failed, history = True, []
            continue
        history = [*history, (moved - x, turned - grad)][-MEMORY:]
        x, value, grad, done, failed = moved, found, turned, done + 1, False
        seen = [*seen, value][-SEEN:]


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of ``x, y, fold, within`` rows; ``within`` tells for every part whether the row belongs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = (batch.column("x").flatten().to_numpy(zero_copy_only=False), batch.column("y").to_numpy().astype(np.int8),
                           batch.column("fold").to_numpy().astype(np.int16), batch.column("within").flatten().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["x", "y", "fold", "within"])

    return rows.select("x", "y", "fold", "within").mapInArrow(run, BLOCK)


class Block:
    def __init__(self, row):
        self.y, self.fold = np.frombuffer(row["y"], np.int8), np.frombuffer(row["fold"], np.int16)
        self.x, self.within = (np.frombuffer(row[k], t).reshape(len(self.y), -1) for k, t in (("x", np.float64), ("within", np.bool_)))

    def mapped(self, part: int, omega: np.ndarray, phase: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Mapped features, classes and folds of the part's rows, some at a time, in one array that the next ones overwrite."""
        rows, turns = np.flatnonzero(self.within[:, part]), (omega / (2 * math.pi), phase / (2 * math.pi))
        held = np.empty((min(CHUNK, len(rows)), len(phase)), np.float32)
        for some in (rows[k:k + CHUNK] for k in range(0, len(rows), CHUNK)):
            x, z = self.x[some], held[:len(some)]
            for k in range(0, len(some), CACHED):
                _cosines(x[k:k + CACHED], *turns, z[k:k + CACHED])
            yield z, self.y[some], self.fold[some]


def _cosines(x: np.ndarray, omega: np.ndarray, phase: np.ndarray, out: np.ndarray) -> None:
    """Mapped rows, by directions and phases in turns. Angles are taken in double precision, their cosines in single precision
    (errors near 1e-7, far below the tolerance of a fit)."""
    turns = x @ omega
    turns += phase
    np.subtract(turns, np.rint(turns), out=out, casting="same_kind")
    out *= np.float32(2 * math.pi)
    np.cos(out, out=out)
    out *= np.float32(math.sqrt(2.0 / len(phase)))


def _summed(blocks: RDD, run) -> np.ndarray:
    """The tasks' arrays added up."""
    def of_task(rows) -> Iterator[np.ndarray]:
        if not gc.get_freeze_count():
            gc.freeze()                 # Spark collects garbage after every task, over all loaded modules: longer than a short task
        yield run(rows)

    parts = blocks.mapPartitions(of_task)
    return parts.reduce(np.add) if blocks.getNumPartitions() <= FEW_PARTS else parts.treeReduce(np.add)


def moments(blocks: RDD, maps: Sequence[tuple[np.ndarray, np.ndarray]], folds: int) -> np.ndarray:
    """Rows, sums and sums of squares of the mapped features, shape (parts, folds, classes, 1 + 2 * components)."""
    width = len(maps[0][1])

    def run(rows) -> np.ndarray:
        out = np.zeros((len(maps), folds, 2, 1 + 2 * width))
        for block in rows:
            for part, of in enumerate(maps):
                for z, y, fold in block.mapped(part, *of):
                    z, group = z.astype(float), np.zeros((2 * folds, len(y)))
                    group[fold * 2 + y, np.arange(len(y))] = 1.0
                    found = np.concatenate([group.sum(axis=1, keepdims=True), group @ z, group @ (z * z)], axis=1)
                    out[part] += found.reshape(folds, 2, -1)
        return out

    return _summed(blocks, run)


def losses(blocks: RDD, maps: Sequence[tuple[np.ndarray, np.ndarray]], machines: Sequence[Machine], points: np.ndarray) -> np.ndarray:
    """Per machine its summed gradient by mapped features, by intercept, and its loss at its point (a row: weights, intercept)."""
    asked = {part: [k for k, m in enumerate(machines) if m.part == part] for part in sorted({m.part for m in machines})}

    def run(rows) -> np.ndarray:
        out = np.zeros((len(machines), len(maps[0][1]) + 2))
        for block in rows:
            for part, own in asked.items():
                left = np.array([-1 if machines[k].fold is None else machines[k].fold for k in own])
                weights = np.stack([machines[k].weights for k in own], axis=1)
                flat = points[own, :-1].T.astype(np.float32)
                for z, y, fold in block.mapped(part, *maps[part]):
                    sign = (2.0 * y - 1.0)[:, None]
                    short = 1.0 - sign * (z @ flat + points[own, -1])
                    weight = np.where((short > 0) & (fold[:, None] != left), weights[y], 0.0)
                    out[own, -1] += (weight * short).sum(axis=0)
                    weight *= -sign
                    out[own, -2] += weight.sum(axis=0)
                    out[own, :-2] += weight.T.astype(np.float32) @ z
        return out

    return _summed(blocks, run)


def fitted(blocks: RDD, maps: Sequence[tuple[np.ndarray, np.ndarray]], machines: Sequence[Machine], most: int,
           tolerance: float) -> list[tuple[np.ndarray, float]]:
    """Weights and intercept of every machine; a job per step of all that go on."""
    width = len(maps[0][1])
    fits = [minimised(width + 1, most, tolerance) for _ in machines]
    points, ends = {k: next(fit) for k, fit in enumerate(fits)}, {}
    while points:
        on = sorted(points)
        own = [machines[k] for k in on]
        scaled = np.stack([m.plain(points[k]) for k, m in zip(on, own, strict=True)])
        for k, m, found in zip(on, own, losses(blocks, maps, own, scaled), strict=True):
            plain = points[k][:-1] * m.scale
            value = found[-1] / m.total + 0.5 * m.ridge * float(plain @ plain)
            turned = (found[:-2] - m.mean * found[-2]) / m.total
            grad = np.append((turned + m.ridge * plain) * m.scale, found[-2] / m.total)
            try:
                points[k] = fits[k].send((value, grad))
            except StopIteration as end:
                ends[k] = end.value
                del points[k]
    return [(of[:-1], float(of[-1])) for of in (m.plain(ends[k]) for k, m in enumerate(machines))]
