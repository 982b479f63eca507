"""Gaussian mixtures with a stated kind of covariance, by expectation maximisation.

A round is one pass over the rows: each task weighs its rows by the current parameters
and adds up what they say of each component; sums are added by Spark, and the new
parameters, a few small matrices, are told to the tasks of the next round. Deviations
are taken from a component's last mean, so that values far from zero lose no digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("full", "tied", "diag", "spherical")
#: The most sums of a round, which all reach the driver: a component has one, one for each feature, and its covariance.
SUMS = 1_000_000


class Mixture(NamedTuple):
    kind: str
    weights: np.ndarray  # k
    means: np.ndarray  # k x d
    covariances: np.ndarray  # full: k x d x d, tied: d x d, diag: k x d, spherical: k

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """log(weight x density) of each row under each component."""
        d = x.shape[1]
        out = np.empty((len(x), len(self.weights)))
        for k, mean in enumerate(self.means):
            away = x - mean
            if self.kind in ("diag", "spherical"):
                spread = np.broadcast_to(self.covariances[k], d)
                squared, volume = (away**2 / spread).sum(axis=1), np.log(spread).sum()
            else:
                root = np.linalg.cholesky(self.covariances if self.kind == "tied" else self.covariances[k])
                squared = (np.linalg.solve(root, away.T) ** 2).sum(axis=0)
                volume = 2 * np.log(np.diag(root)).sum()
            out[:, k] = -0.5 * (d * np.log(2 * np.pi) + volume + squared)
        with np.errstate(divide="ignore"):
            return out + np.log(self.weights)

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each component, log likelihood) of rows, without overflow."""
        logs = self.log_densities(x)
        top = logs.max(axis=1, keepdims=True)
        total = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
        return np.exp(logs - total), total[:, 0]


def _sums(rows: DataFrame, means: np.ndarray, kind: str, shares) -> tuple[np.ndarray, float]:
    """(k x (1 + d + covariance) sums, log likelihood): ``shares`` weighs a batch."""
    k, d = means.shape
    square = kind in ("full", "tied")
    width = 1 + d + (d * d if square else d)
    if k * width > SUMS:
        raise ValueError(f"{k} components of {d} features have more than {SUMS} sums: take fewer features, or diag covariances")

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, likelihood = np.zeros((k, width)), 0.0
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["vec"].to_numpy()).astype(float)
            weight, logs = shares(x, batch)
            likelihood += float(logs.sum())
            for c in range(k):
                away, w = x - means[c], weight[:, c]
                second = (away * w[:, None]).T @ away if square else w @ away**2
                sums[c] += np.r_[w.sum(), w @ away, second.ravel()]
        yield pd.DataFrame({"component": range(k), "sums": list(sums), "likelihood": [likelihood] + [0.0] * (k - 1)})

    parts = rows.mapInPandas(added, "component int, sums array<double>, likelihood double")
    each = parts.select("component", "likelihood", F.posexplode("sums").alias("i", "x"))
    out, likelihood = np.zeros((k, width)), 0.0
    for r in each.groupBy("component", "i").agg(F.sum("x").alias("x"), F.sum("likelihood").alias("l")).collect():  # at most SUMS rows
        out[r["component"], r["i"]] = r["x"]
        likelihood += r["l"] if r["i"] == 0 else 0.0
    return out, likelihood


def _maximised(sums: np.ndarray, means: np.ndarray, kind: str, reg_covar: float) -> Mixture:
    k, d = means.shape
    n = sums[:, 0] + 10 * np.finfo(float).eps  # a component without rows divides by no zero
    shift = sums[:, 1 : 1 + d] / n[:, None]
    second = sums[:, 1 + d :]
    if kind in ("full", "tied"):
        own = second.reshape(k, d, d) - n[:, None, None] * shift[:, :, None] * shift[:, None, :]
        spread = (own / n[:, None, None] if kind == "full" else own.sum(axis=0) / n.sum()) + reg_covar * np.eye(d)
    else:
        spread = np.maximum(second / n[:, None] - shift**2, 0.0) + reg_covar
        spread = spread.mean(axis=1) if kind == "spherical" else spread
    return Mixture(kind, n / n.sum(), means + shift, spread)


def from_labels(rows: DataFrame, k: int, kind: str, reg_covar: float = 1e-6) -> Mixture:
    """The likeliest mixture of (vec, label) rows whose labels 0 to k - 1 are known."""
    if kind not in KINDS:
        raise ValueError(f"unknown covariance type {kind!r}; known are {KINDS}")
    centre = rows.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").collect()
    means = np.tile([r["x"] for r in centre], (k, 1))
    known = lambda x, batch: ((batch["label"].to_numpy()[:, None] == np.arange(k)).astype(float), np.zeros(len(x)))
    return _maximised(_sums(rows.select("vec", "label"), means, kind, known)[0], means, kind, reg_covar)


def one_round(rows: DataFrame, mixture: Mixture, reg_covar: float = 1e-6) -> tuple[Mixture, float]:
    """(next mixture, log likelihood of the rows under the given one)."""
    sums, likelihood = _sums(rows.select("vec"), mixture.means, mixture.kind, lambda x, _: mixture.shares(x))
    return _maximised(sums, mixture.means, mixture.kind, reg_covar), likelihood


def fit(
    rows: DataFrame, k: int, kind: str, *, max_iter: int = 100, tolerance: float = 1e-3, reg_covar: float = 1e-6
) -> tuple[Mixture, list[float]]:
    """(mixture, mean log likelihood of each round) of (vec, label) rows, started from their labels.

    Ends where the mean log likelihood gains less than ``tolerance``, or after ``max_iter`` rounds.
    """
    found, n, seen = from_labels(rows, k, kind, reg_covar), rows.count(), []
    for _ in range(max_iter):
        better, likelihood = one_round(rows, found, reg_covar)
        seen.append(likelihood / max(n, 1))
        if len(seen) > 1 and abs(seen[-1] - seen[-2]) < tolerance:
            break
        found = better
    return found, seen


def probabilities(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """(id, component, probability) of (id, vec) rows."""
    k = len(mixture.weights)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                share, _ = mixture.shares(np.stack(batch["vec"].to_numpy()).astype(float))
                yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), k), "component": np.tile(np.arange(k), len(batch)), "probability": share.ravel()})

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "vec").mapInPandas(weighed, f"id {id_type}, component int, probability double")
