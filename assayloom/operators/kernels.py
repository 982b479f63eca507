"""Kernels for linear machines: a row's kernel values with landmarks become its features.

The landmarks are training rows drawn by a hash of their id, at most a stated number,
so what tasks are told doesn't grow with the data. Scaled by the inverse root of the
landmarks' own kernel matrix, the products of two mapped rows are their kernel value
(exactly where both are landmarks, nearly so elsewhere), and a linear machine on mapped
rows is a machine with that kernel.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from assayloom.functions.draws import uniform

KERNELS = ("rbf", "poly", "sigmoid")
#: Landmarks of a map, and the most numbers they may hold together, for each task is told all of them.
LANDMARKS, TOLD = 256, 8_000_000
#: Eigenvalues below this share of the largest are noise (of copies among the landmarks, or negative ones of a sigmoid).
NOISE = 1e-10


class Kernel(NamedTuple):
    kind: str = "rbf"
    gamma: float = 1.0
    coef0: float = 0.0
    degree: int = 3

    def values(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Kernel values of the rows of ``x`` with those of ``y``."""
        if self.kind == "rbf":
            # differences row by row of y: exact far from zero, and nothing of three dimensions is held
            return np.stack([np.exp(-self.gamma * ((x - row) ** 2).sum(axis=1)) for row in y], axis=1)
        inner = self.gamma * (x @ y.T) + self.coef0
        return inner**self.degree if self.kind == "poly" else np.tanh(inner)


def kernel(rows: DataFrame, kind: str = "rbf", gamma: float | str = "scale", coef0: float = 0.0, degree: int = 3) -> Kernel:
    """The kernel with its width: ``scale`` is 1 / (features x variance of all values of (id, vec) rows), ``auto`` 1 / features."""
    if kind not in KERNELS:
        raise ValueError(f"unknown kernel {kind!r}; known are {('linear', *KERNELS)}")
    if gamma not in ("scale", "auto"):
        return Kernel(kind, float(gamma), float(coef0), int(degree))
    x = F.explode("vec").alias("x")
    row = rows.select(F.size("vec").alias("width"), x).agg(F.max("width").alias("width"), F.var_pop("x").alias("spread")).first()
    if row["width"] is None:
        raise ValueError("a kernel needs rows")
    spread = row["spread"] if gamma == "scale" else 1.0
    return Kernel(kind, 1.0 / (row["width"] * spread) if spread else 1.0, float(coef0), int(degree))


def landmarks(rows: DataFrame, most: int = LANDMARKS, *, key: str = "id", seed: int = 42) -> np.ndarray:
    """At most ``most`` vectors of (id, vec) rows, drawn by a hash of the id, so the same ones each time."""
    drawn = rows.select(key, uniform(seed, F.col(key)).alias("draw")).orderBy("draw", key).limit(most).select(key)
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    if most * width > TOLD:
        raise ValueError(f"{most} landmarks of {width} features hold more than {TOLD} numbers: ask for fewer landmarks")
    found = rows.join(drawn, key, "left_semi").orderBy(key).select("vec").collect()  # at most ``most`` rows
    return np.array([r["vec"] for r in found], dtype=float)


def kernel_values(rows: DataFrame, points: DataFrame, shape: Kernel, *, key: str = "id") -> DataFrame:
    """(id, landmark, value): the kernel of (id, vec) rows with a bounded table of (landmark, vec) points."""
    held = points.orderBy("landmark").limit(LANDMARKS + 1).collect()
    if len(held) > LANDMARKS:
        raise ValueError(f"more than {LANDMARKS} points")
    names, y = [r["landmark"] for r in held], np.array([r["vec"] for r in held], dtype=float)

    @pandas_udf(ArrayType(DoubleType()))
    def against(vec: pd.Series) -> pd.Series:
        return pd.Series(list(shape.values(np.stack(vec.to_numpy()).astype(float), y)))

    listed = F.arrays_zip(F.array(*map(F.lit, names)).alias("landmark"), against("vec").alias("value"))
    return rows.select(F.col(key), F.explode(listed).alias("p")).select(key, "p.landmark", "p.value")


class KernelMap(NamedTuple):
    shape: Kernel
    points: np.ndarray
    weights: np.ndarray  # landmarks x dimensions

    def __call__(self, rows: DataFrame, vec: str = "vec", name: str = "mapped") -> DataFrame:
        """Rows with one more column, their mapped vector; the map travels with the plan."""
        shape, points, weights = self

        @pandas_udf(ArrayType(DoubleType()))
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(list(shape.values(np.stack(batch.to_numpy()).astype(float), points) @ weights))

        return rows.withColumn(name, mapped(F.col(vec)))


def fit_map(rows: DataFrame, shape: Kernel, most: int = LANDMARKS, *, key: str = "id", seed: int = 42) -> KernelMap:
    points = landmarks(rows, most, key=key, seed=seed)
    own, turn = np.linalg.eigh(shape.values(points, points))
    sound = own > NOISE * max(own.max(initial=0.0), 0.0)
    if not sound.any():
        raise ValueError("the kernel has no positive direction on these rows: try another coef0 or gamma")
    return KernelMap(shape, points, turn[:, sound] / np.sqrt(own[sound]))


class KernelMachine(Estimator):
    """A support vector machine with a kernel on (id, features, label) rows; settings can be searched by name."""

    def __init__(self, kind="rbf", gamma="scale", coef0=0.0, degree=3, c=1.0, most=LANDMARKS, tolerance=1e-4, max_iter=100, classes=2, seed=42):
        super().__init__()
        self.fixed = (tolerance, max_iter, classes, seed)
        given = {"kernel": kind, "gamma": gamma, "coef0": coef0, "degree": degree, "C": c, "landmarks": most}
        for name in given:
            setattr(self, name, Param(self, name, name))
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> Model:
        kind, gamma, coef0, degree, c, most = (self.getOrDefault(n) for n in ("kernel", "gamma", "coef0", "degree", "C", "landmarks"))
        tolerance, max_iter, classes, seed = self.fixed
        rows = dataset.withColumn("vec", vector_to_array("features"))
        to = fit_map(rows, kernel(rows, kind, gamma, coef0, degree), most, seed=seed)
        # the penalty is per row, and mapped rows have the scale that the kernel gives them
        machine = LinearSVC(regParam=1.0 / (c * max(dataset.count(), 1)), maxIter=max_iter, tol=tolerance, standardization=False, labelCol="label", featuresCol="mapped")
        if classes > 2:
            machine = OneVsRest(classifier=machine, labelCol="label", featuresCol="mapped")
        return KernelModel(to, machine.fit(_with_mapped(dataset, to).select("mapped", "label")))


def _with_mapped(dataset: DataFrame, to: KernelMap) -> DataFrame:
    mapped = to(dataset.withColumn("vec", vector_to_array("features")))
    return mapped.withColumn("mapped", array_to_vector("mapped")).drop("vec")


class KernelModel(Model):
    def __init__(self, to: KernelMap, machine: Model):
        super().__init__()
        self.map, self.machine = to, machine

    def copy(self, extra=None):
        return copy.copy(self)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.machine.transform(_with_mapped(dataset, self.map)).drop("mapped")
