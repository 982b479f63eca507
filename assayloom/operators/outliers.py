"""Finding outlier samples."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.draws import shuffled_positions, uniform
from assayloom.operators.embed import principal_components, principal_components_wide
from assayloom.operators.reshape import numbered
from assayloom.operators.vectors import require_complete, to_vectors
from assayloom.plans.blocks import nearest_neighbours
from assayloom.plans.prefix import group_quantiles
from assayloom.plans.storage import cut
from assayloom.schema import FEATURE, SAMPLE, col

EULER_GAMMA = 0.5772156649015329


class Outliers(NamedTuple):
    kept: DataFrame  # rows of samples that are no outliers
    scores: DataFrame  # (id, anomaly_score, outlier)
    peptides: DataFrame | None = None


def _without(df: DataFrame, peptides: DataFrame | None, scores: DataFrame, sample: str) -> Outliers:
    bad = scores.filter("outlier").select(F.col("id").alias(sample))
    return Outliers(
        df.join(bad, sample, "left_anti"), scores, None if peptides is None else peptides.join(bad, sample, "left_anti")
    )


# --------------------------------------------------------- isolation forest


def expected_depth(n: Column) -> Column:
    """Mean depth of an unsuccessful search in a binary search tree of n values."""
    n = n.cast("double")
    far = 2.0 * (F.log(F.greatest(n - 1.0, F.lit(1.0))) + EULER_GAMMA) - 2.0 * (n - 1.0) / F.greatest(n, F.lit(1.0))
    return F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(far)


# features drawn for a node; the first that varies among its rows is cut
DRAWN = 6


def isolation_scores(vectors: DataFrame, n_trees: int = 100, seed: int = 0) -> DataFrame:
    """(id, anomaly_score, outlier) of (id, vec) rows.

    Every tree is grown on half of the rows, all trees together. A row holds the
    numbers of its nodes, one per tree, and its vector stays with it: a round takes
    a few values per row and tree, at features drawn for the node, finds the range
    of each node, cuts the first that varies at random, and sends back which side
    the row is on. Where none of the drawn ones varies, a random projection of all
    features is cut; a node in which that doesn't vary either holds copies and ends.
    The score is 0.5 minus the isolation score; below zero is an outlier.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    members = cut(numbered(rows, "id", "__i"))
    n = members.count()
    size = n // 2
    if size < 1:
        raise ValueError("isolation needs at least two samples")
    depth_limit = math.ceil(math.log2(max(size, 2)))
    keys = [r["k"] for r in spark.range(n_trees).orderBy("id").select(F.xxhash64(F.lit(seed), F.col("id").cast("int")).alias("k")).collect()]
    mixed = F.aggregate(
        F.transform("vec", lambda x, f: x * uniform(seed, F.lit("mix"), f)), F.lit(0.0), lambda s, x: s + x
    )
    state = cut(rows.join(members, "id").select(
        "id", "vec", mixed.alias("mix"), _growing(keys, n, size)("__i").alias("grows"),
        F.array_repeat(F.lit(1).cast("long"), n_trees).alias("nodes"), F.lit(0.0).alias("depths"),
    ))
    while not state.filter(F.exists("nodes", lambda x: x > 0)).isEmpty():
        drawn = [
            F.get("vec", F.pmod(F.xxhash64(F.lit(seed), F.lit("feature"), "tree", "node", F.lit(k)), F.size("vec")).cast("int"))
            for k in range(DRAWN)
        ]
        steps = state.select("id", "vec", "mix", "grows", F.posexplode("nodes").alias("tree", "node")).filter("node > 0").select(
            "id", "tree", "node", F.get("grows", F.col("tree")).alias("grows"), *[x.alias(f"x{k}") for k, x in enumerate([*drawn, F.col("mix")])]
        )
        ranges = steps.filter("grows").groupBy("tree", "node").agg(
            F.count("*").alias("n"), *[F.min(f"x{k}").alias(f"lo{k}") for k in range(DRAWN + 1)], *[F.max(f"x{k}").alias(f"hi{k}") for k in range(DRAWN + 1)],
        )
        depth = F.floor(F.log2(F.col("node").cast("double") + 0.5))  # nodes are numbered 1, then 2i and 2i + 1
        place = uniform(seed, F.lit("cut"), F.col("tree"), F.col("node"))
        chosen = F.coalesce(*[
            F.when(F.col(f"hi{k}") > F.col(f"lo{k}"), F.struct(F.lit(k).alias("k"), (F.col(f"lo{k}") + place * (F.col(f"hi{k}") - F.col(f"lo{k}"))).alias("at")))
            for k in range(DRAWN + 1)
        ])
        ends = (F.col("n") <= 1) | (depth >= depth_limit) | chosen.isNull()
        splits = ranges.select(
            "tree", "node", ends.alias("ends"), F.when(ends, depth + expected_depth(F.col("n"))).alias("depth"), F.when(~ends, chosen).alias("cut")
        )
        x = F.get(F.array(*[f"x{k}" for k in range(DRAWN + 1)]), F.col("cut.k"))
        below = F.when(F.col("ends"), 0).otherwise(F.col("node") * 2 + (x > F.col("cut.at")).cast("long"))
        moved = steps.join(splits, ["tree", "node"]).groupBy("id").agg(
            F.map_from_entries(F.collect_list(F.struct("tree", below.cast("long").alias("node")))).alias("to"), F.sum("depth").alias("more")
        )
        state = cut(state.join(moved, "id", "left").select(
            "id", "vec", "mix", "grows",
            F.transform("nodes", lambda x, i: F.when(x > 0, F.coalesce(F.try_element_at("to", i), F.lit(0).cast("long"))).otherwise(0)).alias("nodes"),
            (F.col("depths") + F.coalesce("more", F.lit(0.0))).alias("depths"),
        ))
    share = F.coalesce(F.try_divide(F.col("depths") / n_trees, expected_depth(F.lit(size))), F.lit(1.0))
    return state.select("id", (0.5 - F.pow(F.lit(2.0), -share)).alias("anomaly_score")).withColumn("outlier", F.col("anomaly_score") < 0)


def _growing(keys: list[int], n: int, size: int):
    """For a row's number, in which trees it is one of the ``size`` of ``n`` rows that the tree is grown on."""

    @F.pandas_udf("array<boolean>")
    def chosen(position: pd.Series) -> pd.Series:
        at = position.to_numpy()
        each = [shuffled_positions(at, np.full(len(at), k), np.full(len(at), n)) < size for k in keys]
        return pd.Series(list(np.stack(each, axis=1)) if len(at) else [], dtype=object)

    return chosen


def by_isolation_forest(
    df: DataFrame, peptides: DataFrame | None = None, n_estimators: int = 100, *, seed: int = 0,
    value: str | None = None, sample: str = SAMPLE, feature: str = FEATURE,
) -> Outliers:
    """Drop samples that random cuts isolate early."""
    require_complete(df, value=value, sample=sample, feature=feature)
    scores = isolation_scores(to_vectors(df, value=value, sample=sample, feature=feature), n_estimators, seed)
    return _without(df, peptides, scores, sample)


# ------------------------------------------------------- local outlier factor


def local_outlier_factor(vectors: DataFrame, n_neighbours: int = 20) -> DataFrame:
    """(id, anomaly_score, outlier): minus the ratio of the neighbours' density to the own.

    Three aggregations over the neighbour table; below -1.5 is an outlier.
    """
    near = cut(nearest_neighbours(vectors, n_neighbours))
    reach = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
    density = (
        near.join(reach.select(F.col("id").alias("neighbour"), "k_distance"), "neighbour")
        .groupBy("id")
        .agg((1.0 / (F.avg(F.greatest("distance", "k_distance")) + 1e-10)).alias("density"))
    )
    density = cut(density)
    around = near.join(density.select(F.col("id").alias("neighbour"), F.col("density").alias("theirs")), "neighbour")
    factor = around.groupBy("id").agg(F.avg("theirs").alias("theirs")).join(density, "id")
    scored = factor.select("id", (-F.col("theirs") / F.col("density")).alias("anomaly_score"))
    return scored.withColumn("outlier", F.col("anomaly_score") < -1.5)


def by_local_outlier_factor(
    df: DataFrame, peptides: DataFrame | None = None, number_of_neighbours: int = 20, *,
    value: str | None = None, sample: str = SAMPLE, feature: str = FEATURE,
) -> Outliers:
    """Drop samples that lie in a much thinner neighbourhood than their neighbours."""
    require_complete(df, value=value, sample=sample, feature=feature)
    return _without(df, peptides, local_outlier_factor(to_vectors(df, value=value, sample=sample, feature=feature), number_of_neighbours), sample)


# ------------------------------------------------------------------------ pca


class PcaOutliers(NamedTuple):
    kept: DataFrame
    scores: DataFrame  # (id, component_1, ..., outlier)
    explained: DataFrame
    peptides: DataFrame | None = None


def outside_ellipsoid(scores: DataFrame, components: list[str], threshold: float) -> DataFrame:
    """Add ``outlier``: outside the ellipsoid around the medians, threshold deviations wide."""
    spread = scores.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in components]).alias("s")).scalar()
    marked = scores.withColumn("__sd", spread)
    total = F.lit(0.0)
    for c in components:
        marked = marked.withColumn(f"__m_{c}", group_quantiles(scores, [], c, {"m": 0.5}).scalar())
        offset = F.col(c) - F.col(f"__m_{c}")
        width = F.lit(float(threshold)) * F.col(f"__sd.{c}")
        total = total + F.try_divide(offset * offset, width * width)
    return marked.withColumn("outlier", F.coalesce(total > 1, F.lit(False))).select(*scores.columns, "outlier")


def by_pca(
    df: DataFrame, peptides: DataFrame | None = None, threshold: float = 2.0, number_of_components: int = 3, *, wide: bool = False,
    value: str | None = None, sample: str = SAMPLE, feature: str = FEATURE,
) -> PcaOutliers:
    """Drop samples far from the median in the first two or three components.

    ``wide`` takes the form for very many features, which builds no features x features table.
    """
    if number_of_components not in (2, 3):
        raise ValueError(f"two or three components can be used, not {number_of_components}")
    require_complete(df, value=value, sample=sample, feature=feature)
    if wide:
        found = principal_components_wide(df, number_of_components, value=value, sample=sample, feature=feature)
    else:
        found = principal_components(to_vectors(df, value=value, sample=sample, feature=feature), number_of_components)
    names = [f"component_{i + 1}" for i in range(number_of_components)]
    scores = outside_ellipsoid(cut(found.scores), names, threshold)
    split = _without(df, peptides, scores, sample)
    return PcaOutliers(split.kept, scores, found.explained, split.peptides)
