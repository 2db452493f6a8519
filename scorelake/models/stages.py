"""Pipeline stages MLlib lacks: class weights, random Fourier features, balanced linear models.

Everything that is learned (weights, regularisation strength, bandwidth, calibration) is learned in
``fit`` on the rows given, so cross-validation refits it per fold.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext, StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.pipeline import PipelineModelReader
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasSeed, HasWeightCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import config
from scorelake.functions.missing import col
from scorelake.models import hinge

WEIGHT = "class_weight"
MAPPED = 512                       # rows mapped at once where only their margins are kept
HELD_BYTES = 2 << 30               # mapped rows that the fits of a kernel machine hold together


def class_counts(df: DataFrame, label: str) -> dict[float, int]:
    """Rows of the classes 0 and 1, those that occur; refuses missing and other labels."""
    y = col(label).cast("double")
    found = df.agg(F.count("*").alias("n"), F.count(F.when(y.isNull() | F.isnan(y), 1)).alias("missing"),
                   *[F.count(F.when(y == c, 1)).alias(f"n{c}") for c in (0, 1)]).first()
    if found["missing"]:
        raise ValueError(f"{label} has missing values; clean the table first")
    if found["n0"] + found["n1"] < found["n"]:
        raise ValueError(f"{label} has classes other than 0 and 1")
    return {float(c): found[f"n{c}"] for c in (0, 1) if found[f"n{c}"]}


def balanced(counts: dict[float, int]) -> dict[float, float]:
    """rows / (classes * rows of the class)"""
    n = sum(counts.values())
    return {c: n / (len(counts) * k) for c, k in counts.items()}


def weight_column(label: str, weights: dict[float, float]):
    out = F
    for c, w in weights.items():
        out = out.when(col(label) == c, F.lit(float(w)))
    return out.otherwise(F.lit(1.0))


class _WeigherParams(HasLabelCol, HasWeightCol):
    classes = Param(Params._dummy(), "classes", "class values", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "weight of each class", TypeConverters.toListFloat)


class ClassWeigher(Estimator, _WeigherParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a weight column: balanced by default, or fixed weights for given classes."""

    @keyword_only
    def __init__(self, *, labelCol="y", weightCol=WEIGHT, classes=None, weights=None):
        super().__init__()
        self._setDefault(labelCol="y", weightCol=WEIGHT)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset):
        label = self.getOrDefault(self.labelCol)
        if self.isSet(self.weights):
            found = dict(zip(self.getOrDefault(self.classes), self.getOrDefault(self.weights)))
        else:
            found = balanced(class_counts(dataset, label))
        return ClassWeigherModel(labelCol=label, weightCol=self.getOrDefault(self.weightCol),
                                 classes=list(found), weights=list(found.values()))


class ClassWeigherModel(Model, _WeigherParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fixed class weights; leaves rows without a label column alone."""

    @keyword_only
    def __init__(self, *, labelCol="y", weightCol=WEIGHT, classes=None, weights=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset):
        label = self.getOrDefault(self.labelCol)
        if label not in dataset.columns:
            return dataset
        weights = dict(zip(self.getOrDefault(self.classes), self.getOrDefault(self.weights)))
        return dataset.withColumn(self.getOrDefault(self.weightCol), weight_column(label, weights))


class BalancedLogisticRegression(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Logistic regression with balanced classes and inverse regularisation strength ``C``.

    The penalty is ``1 / (C * sum of weights)`` of the rows being fitted, features are not scaled.
    """

    C = Param(Params._dummy(), "C", "inverse regularisation strength", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "l1 or l2", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "most iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", C=1.0, penalty="l2", maxIter=1000):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="y", C=1.0, penalty="l2", maxIter=1000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        label = self.getOrDefault(self.labelCol)
        counts = class_counts(dataset, label)
        weights = balanced(counts)
        total = sum(counts[c] * weights[c] for c in counts)
        lr = LogisticRegression(
            featuresCol=self.getOrDefault(self.featuresCol), labelCol=label, weightCol=WEIGHT,
            regParam=1.0 / (self.getOrDefault(self.C) * total), standardization=False,
            elasticNetParam=1.0 if self.getOrDefault(self.penalty) == "l1" else 0.0,
            maxIter=self.getOrDefault(self.maxIter), family="binomial")
        return lr.fit(dataset.withColumn(WEIGHT, weight_column(label, weights)))


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features (Rahimi & Recht 2007): inner products approximate the RBF kernel.

    Frequencies are drawn from the seed, so nothing but parameters is stored or sent.
    """

    gamma = Param(Params._dummy(), "gamma", "kernel bandwidth", TypeConverters.toFloat)
    inputSize = Param(Params._dummy(), "inputSize", "length of the input vector", TypeConverters.toInt)
    components = Param(Params._dummy(), "components", "number of features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=1.0, inputSize=1, components=100, seed=42):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def frequencies(self) -> tuple[np.ndarray, np.ndarray]:
        """Directions with their lengths, and phases."""
        size, n = self.getOrDefault(self.inputSize), self.getOrDefault(self.components)
        rng = np.random.default_rng(self.getOrDefault(self.seed))
        omega = rng.normal(size=(size, n)) * math.sqrt(2 * self.getOrDefault(self.gamma))
        return omega, rng.uniform(0, 2 * math.pi, n)

    def _transform(self, dataset):
        n = self.getOrDefault(self.components)
        omega, phase = self.frequencies()

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            z = np.cos(np.stack(x.to_numpy()) @ omega + phase) * math.sqrt(2.0 / n)
            return pd.Series(list(z))

        source = vector_to_array(col(self.getOrDefault(self.inputCol)))
        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(project(source)))

    def margins(self, machines: Sequence[LinearSVCModel], which: Column) -> Column:
        """The margin that the machine of number ``which`` gives a row. Mapped features stay in the task: as a column they are
        ``components / features`` times the rows, and most of the time goes into moving them."""
        omega, phase = self.frequencies()
        weights = np.stack([m.coefficients.toArray() for m in machines], axis=1) * math.sqrt(2.0 / len(phase))
        intercepts = np.array([m.intercept for m in machines])

        @F.arrow_udf("double")
        def margin(x: pa.Array, which: pa.Array) -> pa.Array:
            values, own = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), which.to_numpy(zero_copy_only=False)
            found = [np.zeros((0, len(intercepts)))]
            for k in range(0, len(values), MAPPED):
                found.append(np.cos(values[k:k + MAPPED] @ omega + phase) @ weights + intercepts)
            return pa.array(np.concatenate(found)[np.arange(len(own)), own], pa.float64())

        return margin(vector_to_array(col(self.getOrDefault(self.inputCol))), which)


class MarginVector(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The margin for class 1 as a vector of length one, input of the calibration."""

    @keyword_only
    def __init__(self, *, inputCol="rawPrediction", outputCol="margin"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        margin = vector_to_array(col(self.getOrDefault(self.inputCol)))[1]
        return dataset.withColumn(self.getOrDefault(self.outputCol), array_to_vector(F.array(margin)))


class KernelMachineModel(PipelineModel):
    """Fourier features, linear machine, margin and calibration; rows get their margins in one step.

    The mapped features are a column as well, which Spark makes only where it is read.
    """

    def _transform(self, dataset):
        fourier, machine, *calibration = self.stages
        m = fourier.margins([machine], F.lit(0))
        out = fourier.transform(dataset).withColumn(machine.getRawPredictionCol(), array_to_vector(F.array(-m, m)))
        m = vector_to_array(col(machine.getRawPredictionCol()))[1]
        out = out.withColumn(machine.getPredictionCol(), ((m > float(machine.getThreshold())) & ~F.isnan(m)).cast("double"))
        for stage in calibration:
            out = stage.transform(out)
        return out

    @classmethod
    def read(cls):
        return _KernelMachineReader(cls)


class _KernelMachineReader(PipelineModelReader):
    def load(self, path: str) -> KernelMachineModel:
        loaded = super().load(path)
        return KernelMachineModel(loaded.stages)._resetUid(loaded.uid)


class KernelSVM(Estimator, HasFeaturesCol, HasLabelCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Support vector machine with balanced classes and calibrated probabilities, in linear time.

    ``rbf`` maps the features to random Fourier features, ``poly`` to the monomials up to degree 3,
    ``linear`` keeps them; a linear machine is then fitted. Machines on Fourier features are fitted side by side
    and map the rows anew in every step (:mod:`scorelake.models.hinge`); every other fit holds a copy of its mapped
    rows, so fewer are submitted at once where rows are many. Probabilities come from a logistic curve on
    margins of rows the machine had not seen. ``gamma``: ``scale`` (1 / (features * variance of all
    feature values)), ``auto`` (1 / features) or a number.
    """

    C = Param(Params._dummy(), "C", "inverse regularisation strength", TypeConverters.toFloat)
    kernel = Param(Params._dummy(), "kernel", "rbf, linear or poly", TypeConverters.toString)
    gamma = Param(Params._dummy(), "gamma", "scale, auto or a number", TypeConverters.toString)
    components = Param(Params._dummy(), "components", "number of Fourier features", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "most iterations", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "convergence tolerance", TypeConverters.toFloat)
    calibrationFolds = Param(Params._dummy(), "calibrationFolds", "folds for unseen margins", TypeConverters.toInt)
    parallelism = Param(Params._dummy(), "parallelism", "fits submitted at once", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="y", C=1.0, kernel="rbf", gamma="scale", components=200,
                 maxIter=100, tol=1e-3, calibrationFolds=5, parallelism=6, seed=config.RANDOM_STATE):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="y", C=1.0, kernel="rbf", gamma="scale", components=200,
                         maxIter=100, tol=1e-3, calibrationFolds=5, parallelism=6, seed=config.RANDOM_STATE)
        self._set(**{k: str(v) if k == "gamma" else v for k, v in self._input_kwargs.items()})

    def _bandwidth(self, dataset) -> tuple[float, int]:
        stats = Summarizer.metrics("mean", "variance", "count").summary(col(self.getOrDefault(self.featuresCol)))
        s = dataset.select(stats.alias("s")).first()["s"]
        mean, variance, n = s["mean"].toArray(), s["variance"].toArray(), s["count"]
        size = len(mean)
        spread = float(np.mean(variance * (n - 1) / n + (mean - mean.mean()) ** 2)) if n else 0.0
        gamma = self.getOrDefault(self.gamma)
        if gamma == "scale":
            return (1.0 / (size * spread) if spread > 0 else 1.0), size
        return (1.0 / size if gamma == "auto" else float(gamma)), size

    def _mapping(self, dataset) -> list:
        kernel, features = self.getOrDefault(self.kernel), self.getOrDefault(self.featuresCol)
        if kernel == "linear":
            return []
        gamma, size = self._bandwidth(dataset)
        if kernel == "rbf":
            return [FourierFeatures(inputCol=features, outputCol="kernel_features", gamma=gamma, inputSize=size,
                                    components=self.getOrDefault(self.components), seed=self.getOrDefault(self.seed))]
        if kernel == "poly":
            return [ElementwiseProduct(scalingVec=Vectors.dense([math.sqrt(gamma)] * size), inputCol=features,
                                       outputCol="scaled_features"),
                    PolynomialExpansion(degree=3, inputCol="scaled_features", outputCol="kernel_features")]
        raise ValueError(f"unknown kernel {kernel}")

    def _width(self, size: int) -> int:
        """Length of the mapped features."""
        kernel = self.getOrDefault(self.kernel)
        return {"rbf": self.getOrDefault(self.components), "poly": math.comb(size + 3, 3) - 1}.get(kernel, size)

    def _at_once(self, rows) -> int:
        """Fits submitted at once: each keeps a copy of its mapped rows, together at most ``HELD_BYTES`` (or there is one)."""
        first = rows.select(vector_to_array(col(self.getOrDefault(self.featuresCol))).alias("x")).first()
        copy = rows.count() * 8 * self._width(len(first["x"])) if first else 0
        return max(1, min(self.getOrDefault(self.parallelism), HELD_BYTES // max(1, copy)))

    def _machine(self, dataset, features: str):
        label = self.getOrDefault(self.labelCol)
        counts = class_counts(dataset, label)
        weights = balanced(counts)
        total = sum(counts[c] * weights[c] for c in counts)
        svc = LinearSVC(featuresCol=features, labelCol=label, weightCol=WEIGHT, standardization=False,
                        regParam=1.0 / (self.getOrDefault(self.C) * total), maxIter=self.getOrDefault(self.maxIter),
                        tol=self.getOrDefault(self.tol))
        return svc.fit(dataset.withColumn(WEIGHT, weight_column(label, weights)))

    def _fit(self, dataset):
        return self.fit_parts(dataset, [None])[0]

    def fit_parts(self, dataset: DataFrame, parts: Sequence[Column | None]) -> list[PipelineModel]:
        """A model per part, fitted on the rows where that condition holds (None: on all)."""
        own = [dataset if part is None else dataset.where(part) for part in parts]
        if self.getOrDefault(self.kernel) != "rbf":
            return [self._fit_held(rows) for rows in own]
        label, source, folds = self.getOrDefault(self.labelCol), self.getOrDefault(self.featuresCol), self.getOrDefault(self.calibrationFolds)
        at_once = lambda work, jobs: ThreadPool(len(jobs)).map(inheritable_thread_target(dataset.sparkSession)(work), jobs, 1)
        mappings = at_once(lambda rows: (class_counts(rows, label), self._mapping(rows))[1], own)
        maps = [stage.frequencies() for stage, in mappings]
        within = F.array(*[F.lit(True) if part is None else F.coalesce(part, F.lit(False)) for part in parts])
        blocks = hinge.packed(dataset.select(
            vector_to_array(col(source)).alias("x"), col(label).cast("int").alias("y"), self._calibration_fold().alias("fold"),
            within.alias("within"))).rdd.map(hinge.Block).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            sums = hinge.moments(blocks, maps, folds)
            machines = [self._hinge(k, f, sums[k]) for k in range(len(parts)) for f in [*range(folds), None]]
            found = hinge.fitted(blocks, maps, machines, self.getOrDefault(self.maxIter), self.getOrDefault(self.tol))
        finally:
            blocks.unpersist()
        models = [_linear_machine(label, *of) for of in found]

        def finished(k):
            *partial, machine = models[k * (folds + 1):(k + 1) * (folds + 1)]
            # One pass: a row's margin by the machine that had not seen its fold.
            margin = mappings[k][0].margins(partial, self._calibration_fold())
            platt = self._curve(own[k].select(array_to_vector(F.array(margin)).alias("margin"), col(label)))
            return KernelMachineModel([*mappings[k], machine, MarginVector(inputCol="rawPrediction", outputCol="margin"), platt])

        return at_once(finished, [*range(len(parts))])

    def _calibration_fold(self) -> Column:
        """Equal feature rows share a fold, so a copy of a row never helps to predict it."""
        return F.pmod(F.xxhash64(vector_to_array(col(self.getOrDefault(self.featuresCol)))), F.lit(self.getOrDefault(self.calibrationFolds)))

    def _hinge(self, part: int, fold: int | None, sums: np.ndarray) -> hinge.Machine:
        """The machine without a fold, by the sums of every fold and class."""
        kept = sums[[f for f in range(len(sums)) if f != fold]].sum(axis=0)
        weights = balanced({float(c): kept[c, 0] for c in (0, 1) if kept[c, 0]})
        each = np.array([weights.get(float(c), 1.0) for c in (0, 1)])
        n, width = kept[:, 0], (kept.shape[1] - 1) // 2
        total = float(n @ each)
        mean, square = each @ kept[:, 1:1 + width] / total, each @ kept[:, 1 + width:]
        variance = np.maximum(square - total * mean ** 2, 0.0) / (total - float(n @ each ** 2) / total)
        scale = np.where(variance > 0, 1.0 / np.sqrt(np.where(variance > 0, variance, 1.0)), 0.0)
        return hinge.Machine(part, fold, each, 1.0 / (self.getOrDefault(self.C) * total), mean, scale, total)

    def _curve(self, margins: DataFrame):
        """A logistic curve on margins of rows that the machine had not seen."""
        platt = LogisticRegression(featuresCol="margin", labelCol=self.getOrDefault(self.labelCol), predictionCol="", rawPredictionCol="",
                                   probabilityCol="probability", standardization=False, maxIter=100)
        return platt.fit(margins)

    def _calibrated(self, mapping: list, machine, partial: list, rows_of) -> PipelineModel:
        """The model with a logistic curve on the margins that the ``partial`` machines give the fold they had not seen."""
        label, margin = self.getOrDefault(self.labelCol), MarginVector(inputCol="rawPrediction", outputCol="margin")
        parts = [margin.transform(m.transform(rows_of(f))).select("margin", col(label)) for f, m in enumerate(partial)]
        return PipelineModel([*mapping, machine, margin, self._curve(reduce(DataFrame.unionByName, parts))])

    def _fit_held(self, dataset) -> PipelineModel:
        """Every machine is a fit of its own that holds its mapped rows."""
        label, source = self.getOrDefault(self.labelCol), self.getOrDefault(self.featuresCol)
        mapping = self._mapping(dataset)
        features = "kernel_features" if mapping else source
        mapped = dataset.select(col(source), col(label), self._calibration_fold().alias("calibration_fold"))
        for stage in mapping:
            mapped = stage.transform(mapped)
        mapped = mapped.select(col(features), col(label), "calibration_fold").persist()
        try:
            def machine_without(f):
                rows = mapped if f is None else mapped.where(F.col("calibration_fold") != f)
                return self._machine(rows, features)

            with ThreadPool(self._at_once(dataset)) as pool:
                *partial, machine = pool.map(inheritable_thread_target(dataset.sparkSession)(machine_without),
                                             [*range(self.getOrDefault(self.calibrationFolds)), None], 1)
            return self._calibrated(mapping, machine, partial, lambda f: mapped.where(F.col("calibration_fold") == f))
        finally:
            mapped.unpersist()


def _linear_machine(label: str, weights: np.ndarray, intercept: float) -> LinearSVCModel:
    """A fitted machine as MLlib's model."""
    made = LinearSVCModel(JavaWrapper._new_java_obj(
        "org.apache.spark.ml.classification.LinearSVCModel", f"LinearSVC_{uuid.uuid4().hex[:12]}",
        _py2java(SparkContext._active_spark_context, Vectors.dense(weights)), float(intercept)))
    made._resetUid(made._java_obj.uid())
    return made._set(labelCol=label, featuresCol="kernel_features")
