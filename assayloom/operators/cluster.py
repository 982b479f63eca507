"""Clustering of samples and the indices that judge it."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from assayloom.operators import mixture
from assayloom.operators.reshape import numbered
from assayloom.operators.vectors import with_ml_vector
from assayloom.plans import balls
from assayloom.plans.blocks import FEW_BLOCKS, VECTORS_PER_BLOCK, distance, distance_matrix, every_block_pair, in_tiles, pack_vectors, stack
from assayloom.plans.storage import cut, written
from assayloom.schema import col


#: Rows of a block whose distances to those of another are taken at once.
ROWS_OF_BLOCK = 512
#: Tiles of blocks that silhouettes compare pair by pair, and how many blocks a tile may grow to before there are more.
TILES = 12
BLOCKS_OF_TILE = 64


class Clusters(NamedTuple):
    labels: DataFrame  # (id, label)
    centres: DataFrame | None  # (label, position, value)
    probabilities: DataFrame | None = None  # (id, component, probability)
    model: object | None = None


def _checked(vectors: DataFrame, k: int) -> DataFrame:
    given = cut(vectors.select("id", "vec"))
    row = given.agg(F.count("*").alias("n"), F.count_if(F.exists("vec", lambda x: x.isNull() | F.isnan(x))).alias("bad")).first()
    if row["bad"]:
        raise ValueError("vectors must not hold missing values")
    if k > row["n"]:
        raise ValueError(f"{row['n']} rows can't make {k} clusters")
    return with_ml_vector(given)


def _centres(rows: DataFrame, centres: Sequence) -> DataFrame:
    flat = [(i, j, float(x)) for i, c in enumerate(centres) for j, x in enumerate(c)]
    return rows.sparkSession.createDataFrame(flat, "label int, position int, value double")


def k_means(
    vectors: DataFrame, n_clusters: int = 8, *, n_init: int = 10, max_iter: int = 300, tolerance: float = 1e-4,
    init: str = "k-means||", seed: int = 6,
) -> Clusters:
    """Best of several k-means runs on (id, vec) rows, by summed squared distance."""
    rows = _checked(vectors, n_clusters)
    if n_clusters == 1:
        mean = rows.agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("m"))
        centres = mean.select(F.lit(0).alias("label"), F.posexplode("m").alias("position", "value"))
        return Clusters(rows.select("id", F.lit(0).alias("label")), centres)
    best = None
    for run in range(n_init):
        model = KMeans(k=n_clusters, initMode=init, maxIter=max_iter, tol=tolerance, seed=seed + run, predictionCol="label").fit(rows)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return Clusters(best.transform(rows).select("id", "label"), _centres(rows, best.clusterCenters()), None, best)


def expectation_maximisation(
    vectors: DataFrame, n_components: int = 1, *, max_iter: int = 100, tolerance: float = 1e-3, seed: int = 42,
    covariance_type: str = "full", reg_covar: float = 1e-6,
) -> Clusters:
    """Gaussian mixture: the likeliest component and the probability of each.

    Covariances may be ``full``, ``tied`` (one for all components), ``diag`` or
    ``spherical``; all but the full ones start from k-means (see ``mixture``) and add
    ``reg_covar`` to every variance.
    """
    if covariance_type not in mixture.KINDS:
        raise ValueError(f"unknown covariance type {covariance_type!r}; known are {mixture.KINDS}")
    rows = _checked(vectors, n_components)
    if n_components == 1:
        labels = rows.select("id", F.lit(0).alias("label"))
        return Clusters(labels, None, rows.select("id", F.lit(0).alias("component"), F.lit(1.0).alias("probability")))
    if covariance_type != "full":
        start = k_means(vectors, n_components, n_init=1, seed=seed).labels
        given = cut(vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).join(start, "id"))
        found, _ = mixture.fit(given, n_components, covariance_type, max_iter=max_iter, tolerance=tolerance, reg_covar=reg_covar)
        shares = cut(mixture.probabilities(given, found))
        # the smaller component of equal ones
        labels = shares.groupBy("id").agg(F.max_by("component", F.struct("probability", -F.col("component"))).alias("label"))
        return Clusters(labels, None, shares, found)
    model = GaussianMixture(k=n_components, maxIter=max_iter, tol=tolerance, seed=seed, predictionCol="label").fit(rows)
    found = model.transform(rows)
    probabilities = found.select("id", F.posexplode(vector_to_array("probability")).alias("component", "probability"))
    return Clusters(found.select("id", "label"), None, probabilities, model)


def hierarchical(vectors: DataFrame, n_clusters: int = 2, *, metric: str = "euclidean", linkage: str = "bisecting", seed: int = 42) -> Clusters:
    """A hierarchy, cut where it has ``n_clusters``.

    ``bisecting`` goes top-down: the largest cluster is split in two until there are
    enough. ``single`` goes bottom-up by nearest members (see ``spanning_tree``), for
    the euclidean metric: without its heaviest edges the tree falls into the clusters,
    which are numbered by their first member.
    """
    rows = _checked(vectors, n_clusters)
    if linkage == "single":
        if metric != "euclidean":
            raise ValueError("single linkage takes the euclidean metric")
        return Clusters(_cut_tree(vectors, spanning_tree(vectors), n_clusters), None)
    if linkage != "bisecting":
        raise ValueError(f"unknown linkage {linkage!r}: bisecting or single")
    model = BisectingKMeans(k=n_clusters, distanceMeasure=metric, seed=seed, predictionCol="label", maxIter=50).fit(rows)
    return Clusters(model.transform(rows).select("id", "label"), _centres(rows, model.clusterCenters()), None, model)


def _contracted(labels: DataFrame, best: DataFrame) -> DataFrame:
    """Labels (n, c) after each component joined the one its best edge (c, other) leads to.

    Best edges follow one strict order, so the only cycles are pairs that chose each
    other; of a pair the smaller becomes the root, and pointers are doubled to it.
    """
    back = best.select(F.col("c").alias("other"), F.col("other").alias("back"))
    root = (F.col("back") == F.col("c")) & (F.col("c") < F.col("other"))
    ends = written(best.join(back, "other", "left").select("c", F.when(root, F.col("c")).otherwise(F.col("other")).alias("end")), "ends")
    while True:
        further = ends.select(F.col("c").alias("end"), F.col("end").alias("next"))
        moved = written(ends.join(further, "end", "left").select("c", F.coalesce("next", "end").alias("next"), "end"), "ends")
        ends = moved.select("c", F.col("next").alias("end"))
        if moved.filter("next <> end").isEmpty():
            return written(labels.join(ends, "c", "left").select("n", F.coalesce("end", "c").alias("c")), "labels")


def _row_by_row(a, b, n, m, cn, cm) -> list[np.ndarray]:
    """Edges (c, d, lo, hi) that hold the shortest way out of each component, whatever the numbers."""
    out = []
    # what is best so far for each row of b
    best = np.full(len(m), np.inf), np.full(len(m), -1), np.full(len(m), -1)
    for i in range(len(n)):
        apart = np.flatnonzero(cm != cn[i])
        if not len(apart):
            continue
        d = ((b[apart] - a[i]) ** 2).sum(axis=1)
        lo, hi = np.minimum(m[apart], n[i]), np.maximum(m[apart], n[i])
        first = np.lexsort((hi, lo, d))[0]
        out.append((cn[i], d[first], lo[first], hi[first]))
        bd, bl, bh = (x[apart] for x in best)
        less = (d < bd) | (d == bd) & ((lo < bl) | (lo == bl) & (hi < bh))
        for held, new in zip(best, (d, lo, hi)):
            held[apart[less]] = new[less]
    out += [(c, *e) for c, *e in zip(cm, *best) if e[1] >= 0]
    return [np.array(x) for x in zip(*out)] if out else []


def _by_products(a, b, n, m, cn, cm) -> list[np.ndarray] | None:
    """As ``_row_by_row``: products with a bound on their error tell which pairs may be the shortest, and only those are measured.

    None where the numbers don't allow it.
    """
    if a.dtype != np.float64 or b.dtype != np.float64 or a.ndim != 2 or b.ndim != 2:
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        centre = (a.mean(axis=0) + b.mean(axis=0)) / 2
        x, y = a - centre, b - centre
        lengths = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
        squared = lengths - 2.0 * (x @ y.T)
    if not np.isfinite(squared).all() or not 1e-200 < lengths.max() < 1e200:
        return None
    lengths *= 2.0**-50 * (a.shape[1] + 8)  # from here on the error of the squares, with room to spare
    alike = cn[:, None] == cm[None, :]
    squared[alike] = np.inf
    most = squared + lengths
    # of either row of a pair, what its shortest way out is not beyond
    limits = np.maximum(most.min(axis=1)[:, None], most.min(axis=0)[None, :])
    limits[alike] = -np.inf
    i, j = np.nonzero(squared - lengths <= limits)
    d = np.empty(len(i))
    for start in range(0, len(i), 8192):
        part = slice(start, start + 8192)
        d[part] = ((b[j[part]] - a[i[part]]) ** 2).sum(axis=1)
    lo, hi = np.minimum(n[i], m[j]), np.maximum(n[i], m[j])
    return [np.concatenate(both) for both in ((cn[i], cm[j]), (d, d), (lo, lo), (hi, hi))]


def _nearest_outside(pairs: DataFrame) -> DataFrame:
    """(c, d, lo, hi): per pair of blocks the shortest way out of each component, from differences, not products."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                n, m, cn, cm = (np.asarray(x, dtype=np.int64) for x in (row.na, row.nb, row.ca, row.cb))
                if cn.min() == cn.max() == cm.min() == cm.max():
                    continue
                given = np.stack(row.va), np.stack(row.vb), n, m, cn, cm
                edges = _by_products(*given)
                edges = _row_by_row(*given) if edges is None else edges
                if len(edges) and len(edges[0]):
                    out.append(_least(edges))
            if out:
                yield pd.DataFrame(dict(zip(["c", "d", "lo", "hi"], _least([np.concatenate(x) for x in zip(*out)]))))

    return pairs.mapInPandas(found, "c long, d double, lo long, hi long")


def _least(edges: list[np.ndarray]) -> list[np.ndarray]:
    """Of edges (c, d, lo, hi) the first of each component."""
    c, d, lo, hi = edges
    order = np.lexsort((hi, lo, d, c))
    first = order[np.r_[True, c[order][1:] != c[order][:-1]]]
    return [x[first] for x in edges]


def spanning_tree(vectors: DataFrame) -> DataFrame:
    """(a, b, height): the minimum spanning tree of (id, vec) rows by euclidean distance, a row per merge of single linkage.

    Rounds of Boruvka: blocks of rows are compared pair by pair, every component finds
    its shortest way out, and components that are joined become one; they at least halve,
    so rounds are logarithmic, each over all pairs of blocks that aren't one component.
    Equal distances are taken by the order of the ids' numbers, so results repeat.
    """
    vectors = written(vectors.select("id", "vec"), "vectors")  # read three times
    numbers = written(numbered(vectors, "id", "n"), "numbers")
    packed = vectors.join(numbers, "id").groupBy(F.expr(f"n div {ROWS_OF_BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "vec"))).alias("rows"))
    blocks = written(packed.select("block", F.col("rows.n").alias("n"), F.col("rows.vec").alias("v")), "blocks")
    labels, tree = numbers.select("n", F.col("n").alias("c")), None
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes here become much work
    while True:
        parts = labels.groupBy(F.expr(f"n div {ROWS_OF_BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("rows"))
        held = written(blocks.join(parts.select("block", F.col("rows.c").alias("c")), "block"), "held")
        a, b = (held.select(F.col("block").alias(f"b{x}"), *[F.col(y).alias(f"{y}{x}") for y in "nvc"], F.array_min("c").alias(f"f{x}"), F.array_max("c").alias(f"l{x}")) for x in "ab")
        # a stated all-pairs comparison, block by block, but for blocks of one component
        one = (F.col("fa") == F.col("la")) & (F.col("fb") == F.col("lb")) & (F.col("fa") == F.col("fb"))
        pairs = a.repartition(tasks, "ba").join(b, (F.col("ba") <= F.col("bb")) & ~one).drop("fa", "la", "fb", "lb")
        best = _nearest_outside(pairs).groupBy("c").agg(F.min(F.struct("d", "lo", "hi")).alias("e")).select("c", "e.*")
        best = written(best, "best")
        if best.isEmpty():
            break
        new = best.select("lo", "hi", "d").distinct()
        tree = new if tree is None else tree.unionByName(new)
        labels = _contracted(labels, _led(best, labels))
    if tree is None:
        tree = numbers.limit(0).select(F.col("n").alias("lo"), F.col("n").alias("hi"), F.lit(0.0).alias("d"))
    first, second = (numbers.select(F.col("n").alias(x), F.col("id").alias(y)) for x, y in (("lo", "a"), ("hi", "b")))
    return tree.join(first, "lo").join(second, "hi").select("a", "b", F.sqrt("d").alias("height"))


def _led(best: DataFrame, labels: DataFrame) -> DataFrame:
    """(c, other): which component the best edge of each leads to."""
    ends = [labels.select(F.col("n").alias(x), F.col("c").alias(f"c{x}")) for x in ("lo", "hi")]
    return best.join(ends[0], "lo").join(ends[1], "hi").select("c", F.when(F.col("clo") == F.col("c"), F.col("chi")).otherwise(F.col("clo")).alias("other"))


def _cut_tree(vectors: DataFrame, tree: DataFrame, n_clusters: int) -> DataFrame:
    """(id, label): what hangs together without the heaviest edges of the tree."""
    numbers = written(numbered(vectors, "id", "n"), "numbers")
    lo, hi = (numbers.select(F.col("id").alias(x), F.col("n").alias(y)) for x, y in (("a", "lo"), ("b", "hi")))
    edges = written(tree.join(lo, "a").join(hi, "b").select("lo", "hi", F.col("height").alias("d")), "edges")
    # as many rows as clusters are asked for
    heavy = edges.orderBy(F.desc("d"), F.desc("lo"), F.desc("hi")).limit(n_clusters - 1).select("lo", "hi")
    kept = written(edges.join(heavy, ["lo", "hi"], "left_anti"), "kept")
    labels = numbers.select("n", F.col("n").alias("c"))
    while True:
        ends = [labels.select(F.col("n").alias(x), F.col("c").alias(f"c{x}")) for x in ("lo", "hi")]
        open_ = kept.join(ends[0], "lo").join(ends[1], "hi").filter("clo <> chi").select("d", "lo", "hi", F.explode(F.array("clo", "chi")).alias("c"))
        best = written(open_.groupBy("c").agg(F.min(F.struct("d", "lo", "hi")).alias("e")).select("c", "e.*"), "best")
        if best.isEmpty():
            break
        labels = _contracted(labels, _led(best, labels))
    placed = numbers.join(labels, "n")
    order = placed.groupBy("c").agg(F.min("id").alias("first"))
    ranked = order.withColumn("label", F.row_number().over(Window.orderBy("first")) - 1)  # a row per cluster
    return placed.join(ranked, "c").select("id", "label")


# -------------------------------------------------------- against known labels


def contingency(pairs: DataFrame, truth: str = "truth", predicted: str = "label") -> DataFrame:
    """(truth, label, n): how often each pair of labels occurs."""
    return pairs.groupBy(col(truth).alias("truth"), col(predicted).alias("label")).agg(F.count("*").alias("n"))


@pandas_udf(DoubleType())
def _chance_information(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    """Expected contribution of one row and one column total to the mutual information."""
    return pd.Series([_expected(*cell) for cell in zip(a.astype(int), b.astype(int), n.astype(int))], dtype=float)


def _expected(x: int, y: int, total: int) -> float:
    """Mean of k/n log(n k / (x y)) when k of x marked rows fall among y drawn of n.

    Only counts near the mean matter: twelve deviations away the weight is below
    1e-30. Weights follow from the ratio of neighbours and sum to one.
    """
    mean = x * y / total
    spread = math.sqrt(max(x * y * (total - x) * (total - y), 0) / (total * total * max(total - 1, 1)))
    far = 12 * spread + 30
    low, high = max(0, x + y - total, math.floor(mean - far)), min(x, y, math.ceil(mean + far))
    k = np.arange(low, high + 1, dtype=float)
    ratio = (x - k[:-1]) * (y - k[:-1]) / ((k[:-1] + 1) * (total - x - y + k[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(np.log(ratio))])
    weight = np.exp(logs - logs.max())
    some = k > 0
    return float(np.sum(k[some] / total * np.log(total * k[some] / (x * y)) * weight[some]) / weight.sum())


def external_indices(pairs: DataFrame, truth: str = "truth", predicted: str = "label") -> DataFrame:
    """(metric, score) of a clustering against known labels.

    All follow from the table of label pairs and its margins, whose size is that
    of the label sets.
    """
    cells = contingency(pairs, truth, predicted)
    rows = cells.groupBy("truth").agg(F.sum("n").alias("a"))
    columns = cells.groupBy("label").agg(F.sum("n").alias("b"))
    total = pairs.agg(F.count("*").alias("n")).scalar()
    two = lambda n: n.cast("double") * (n - 1) / 2.0
    entropy = lambda n: -(n / F.col("t")) * F.log(n / F.col("t"))
    joint = cells.join(rows, "truth").join(columns, "label").withColumn("t", total)
    info = (F.col("n") / F.col("t")) * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))
    inside = joint.agg(F.struct(F.sum(two(F.col("n"))).alias("both"), F.sum(info).alias("mi"), F.max("t").alias("t")).alias("s"))
    left = rows.withColumn("t", total).agg(F.struct(F.sum(two(F.col("a"))).alias("pairs"), F.sum(entropy(F.col("a"))).alias("h")).alias("s"))
    right = columns.withColumn("t", total).agg(F.struct(F.sum(two(F.col("b"))).alias("pairs"), F.sum(entropy(F.col("b"))).alias("h")).alias("s"))
    margins = columns.agg(F.collect_list("b").alias("bs")).scalar()
    chance = (
        rows.withColumn("bs", margins).select("a", F.explode("bs").alias("b")).withColumn("t", total)
        .agg(F.sum(_chance_information("a", "b", "t")).alias("e"))
    )
    one = pairs.sparkSession.range(1).select(
        inside.scalar().alias("i"), left.scalar().alias("l"), right.scalar().alias("r"), chance.scalar().alias("emi")
    ).select(
        F.col("i.both").alias("tp"), (F.col("r.pairs") - F.col("i.both")).alias("fp"), (F.col("l.pairs") - F.col("i.both")).alias("fn"),
        two(F.col("i.t")).alias("every"), F.greatest(F.col("i.mi"), F.lit(0.0)).alias("mi"), F.col("l.h").alias("ht"), F.col("r.h").alias("hp"), "emi",
    )
    tp, fp, fn, every, mi, ht, hp, emi = (F.col(c) for c in ("tp", "fp", "fn", "every", "mi", "ht", "hp", "emi"))
    tn = every - tp - fp - fn
    chance_pairs = F.try_divide((tp + fp) * (tp + fn), every)
    mean_h = (ht + hp) / 2.0
    homogeneity = F.when(ht == 0, 1.0).otherwise(F.try_divide(mi, ht))
    completeness = F.when(hp == 0, 1.0).otherwise(F.try_divide(mi, hp))
    scores: Mapping[str, object] = {
        "rand_score": F.try_divide(tp + tn, every),
        "adjusted_rand_score": F.when((fp == 0) & (fn == 0), 1.0).otherwise(
            F.try_divide(tp - chance_pairs, (2 * tp + fp + fn) / 2.0 - chance_pairs)
        ),
        "mutual_info_score": mi,
        "normalized_mutual_info_score": F.when((ht == 0) & (hp == 0), 1.0).otherwise(F.coalesce(F.try_divide(mi, mean_h), F.lit(0.0))),
        "adjusted_mutual_info_score": F.when((ht == 0) & (hp == 0), 1.0).otherwise(F.try_divide(mi - emi, mean_h - emi)),
        "homogeneity_score": homogeneity,
        "completeness_score": completeness,
        "v_measure_score": F.coalesce(F.try_divide(2 * homogeneity * completeness, homogeneity + completeness), F.lit(0.0)),
        "fowlkes_mallows_score": F.coalesce(F.try_divide(tp, F.sqrt((tp + fp) * (tp + fn))), F.lit(0.0)),
    }
    listed = F.array(*[F.struct(F.lit(n).alias("metric"), s.cast("double").alias("score")) for n, s in scores.items()])
    return one.select(F.inline(listed))


def binary_indices(pairs: DataFrame, truth: str = "truth", predicted: str = "label", positive=1) -> DataFrame:
    """(metric, score): Jaccard and F1 of two-class labels, for the positive class."""
    hit = lambda t, p: F.count_if((col(truth) == positive).eqNullSafe(F.lit(t)) & (col(predicted) == positive).eqNullSafe(F.lit(p))).cast("double")
    one = pairs.agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"))
    wrong = F.col("fp") + F.col("fn")
    listed = F.array(
        F.struct(F.lit("jaccard_score").alias("metric"), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + wrong), F.lit(0.0)).alias("score")),
        F.struct(F.lit("f1_score").alias("metric"), F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + wrong), F.lit(0.0)).alias("score")),
    )
    return one.select(F.inline(listed))


# -------------------------------------------------------------- from distances


def _label_sums():
    """Sums of distances from each row of two tiles to the rows of each label in the other, added up within the task."""

    def sums_of(rows: pd.DataFrame) -> pd.DataFrame:
        unfold = lambda rows: [(np.asarray(r.ids), np.asarray(r.label), stack(r.vecs)) for r in rows.itertuples(index=False)]
        second = rows["second"].to_numpy(dtype=bool)
        one, alike = unfold(rows[~second]), rows["a"].iloc[0] == rows["b"].iloc[0]
        other = one if alike else unfold(rows[second])
        held: dict[tuple, dict] = {}

        def add(side, i, dist, theirs):
            sums = held.setdefault((side, i), {})
            for label in np.unique(theirs):
                if label == label:  # what has no label is in no cluster
                    sums[label] = sums.get(label, 0.0) + dist[:, theirs == label].sum(axis=1)

        for i, (ids, labels, vecs) in enumerate(one):
            for j, (t_ids, t_labels, t_vecs) in enumerate(other):
                if alike and j < i:
                    continue
                dist = distance_matrix(vecs, t_vecs, "euclidean")
                dist[ids[:, None] == t_ids[None, :]] = 0.0
                add(0, i, dist, t_labels)
                if not alike:
                    add(1, j, dist.T, labels)
                elif j > i:
                    add(0, j, dist.T, labels)
        out = [
            pd.DataFrame({"id": ids, "label": labels, "other_label": label, "total": total})
            for (side, i), sums in held.items() for ids, labels, _ in ((one, other)[side][i],) for label, total in sums.items()
        ]
        return pd.concat(out) if out else pd.DataFrame(columns=["id", "label", "other_label", "total"], dtype=object)

    return sums_of


def silhouette(labelled: DataFrame) -> DataFrame:
    """One row: mean silhouette (plain euclidean) of (id, vec, label) rows, exact.

    Tiles of blocks are compared in tasks, each pair once; only one number per row, label and
    pair of tiles leaves them. A block is shipped to each of ``TILES`` tiles once: tiles grow with
    the rows, up to ``BLOCKS_OF_TILE`` blocks, and only then in number.
    """
    sizes = labelled.groupBy("label").agg(F.count("*").alias("size"))
    id_type, label_type = (labelled.schema[c].dataType.simpleString() for c in ("id", "label"))
    schema = f"id {id_type}, label {label_type}, other_label {label_type}, total double"
    packed = written(pack_vectors(labelled.select("id", F.col("vec").cast("array<double>").alias("vec"), "label"), "label"), "packed")
    last = packed.agg(F.max("block").alias("m")).first()["m"]
    tiles = max(TILES, -(-((last or 0) + 1) // BLOCKS_OF_TILE))
    tile = F.col("block") % tiles
    here = packed.withColumn("second", F.lit(False)).withColumn("a", tile).withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(tiles - 1).cast("long"))))
    there = packed.withColumn("second", F.lit(True)).withColumn("b", tile).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b"))))
    met = here.unionByName(there.filter("a < b"))
    sums = (
        met.groupBy("a", "b").applyInPandas(_label_sums(), schema)
        .groupBy("id", "label", "other_label").agg(F.sum("total").alias("total"))
        .join(sizes.withColumnRenamed("label", "other_label"), "other_label")
    )
    own = F.col("label") == F.col("other_label")
    per_row = sums.groupBy("id").agg(
        F.max(F.when(own, F.col("size"))).alias("size"),
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.try_divide(F.col("total"), F.col("size")))).alias("b"),
    )
    value = F.when(F.col("size") > 1, F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    return per_row.agg(F.avg(value).alias("silhouette_score"))


def _extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest distance between and largest within labels, per pair of blocks."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            dist = distance_matrix(stack(row.q_vecs), stack(row.t_vecs), "euclidean")
            dist[np.asarray(row.q_ids)[:, None] == np.asarray(row.t_ids)[None, :]] = 0.0
            same = np.asarray(row.q_label)[:, None] == np.asarray(row.t_label)[None, :]
            between, within = dist[~same], dist[same]
            out.append((between.min() if between.size else None, within.max() if within.size else None))
        yield pd.DataFrame(out, columns=["between", "within"], dtype=float)


def dunn(labelled: DataFrame) -> DataFrame:
    """One row: smallest distance between clusters over the largest within one, exact.

    Branch and bound over a tree of balls per label: pairs of balls that can neither hold
    the nearest rows of different labels nor the farthest of one are left out unseen.
    """
    number = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))

    schema = "between double, within double"

    def measured(found: DataFrame) -> DataFrame:
        return found.agg(F.min(number("between")).alias("between"), F.max(number("within")).alias("within"))

    rows = labelled.select("id", F.col("vec").cast("array<double>").alias("vec"), "label")
    if rows.count() <= FEW_BLOCKS * VECTORS_PER_BLOCK:
        both = every_block_pair(pack_vectors(rows, "label")).filter("block <= other")
        found = measured(both.select("q_ids", "q_vecs", "q_label", "t_ids", "t_vecs", "t_label").mapInPandas(_extremes, schema))
        return found.select(F.try_divide("between", "within").alias("dunn_score"))
    packed, between, within = dunn_blocks(rows)
    of = lambda pairs: measured(in_tiles(packed, pairs, ["ids", "vecs", "label"], _extremes, schema))
    # the likeliest pairs first, as many as there are blocks: what they give rules out most others
    first = packed.count()
    near = of(between.orderBy("low").limit(first)).first()["between"]
    far = of(within.orderBy(F.desc("high")).limit(first)).first()["within"]
    rest = between.filter(F.col("low") <= (math.inf if near is None else near)).unionByName(
        within.filter(F.col("high") >= (-math.inf if far is None else far)), allowMissingColumns=True
    )
    return of(rest).select(
        F.try_divide(F.least("between", F.lit(near).cast("double")), F.greatest("within", F.lit(far).cast("double"))).alias("dunn_score")
    )


def dunn_blocks(rows: DataFrame, per_block: int = VECTORS_PER_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, the pairs (block, other, low) that may hold the least distance between labels, and
    those (block, other, high) that may hold the largest within one."""
    # copies of one label have the same distances; as text a null label is a key like others
    placed = balls.grown(rows.dropDuplicates(["label", "vec"]).withColumn("root", F.to_json(F.struct("label"))), per_block)
    packed = written(balls.packed(placed, per_block, "label"), "packed")
    blocks = written(balls.summaries(packed), "blocks")
    a, b = F.struct("a_root", "a_node"), F.struct("b_root", "b_node")
    low = F.greatest(F.col("apart") - F.col("a_radius") - F.col("b_radius") - balls.slack(), F.lit(0.0))
    high = F.col("apart") + F.col("a_radius") + F.col("b_radius") + balls.slack()

    def nearest(pairs: DataFrame) -> DataFrame:
        # some row of either ball is as near
        return pairs.filter(low <= pairs.agg(F.min(high)).scalar())

    def farthest(pairs: DataFrame) -> DataFrame:
        # centres are means of rows, so some rows are at least as far apart
        pairs = pairs.filter(a <= b)
        return pairs.filter(high >= pairs.agg(F.max(F.col("apart") - balls.slack())).scalar())

    def of_blocks(leaves: DataFrame) -> DataFrame:
        sides = [blocks.select(*[F.col(c).alias(f"{x}_{c}") for c in ("root", "node", "block", "centre", "radius")]) for x in "ab"]
        both = leaves.join(sides[0], ["a_root", "a_node"]).join(sides[1], ["b_root", "b_node"])
        both = both.withColumn("apart", distance(F.col("a_centre"), F.col("b_centre"), "euclidean"))
        return both.select(F.col("a_block").alias("block"), F.col("b_block").alias("other"), low.alias("low"), high.alias("high"))

    between = of_blocks(balls.followed(blocks, F.col("a_root") < F.col("b_root"), nearest)).drop("high")
    within = of_blocks(balls.followed(blocks, F.col("a_root") == F.col("b_root"), farthest)).drop("low")
    return packed, written(between, "between"), written(within, "within")


def davies_bouldin(labelled: DataFrame) -> DataFrame:
    """One row: mean over clusters of the worst ratio of spreads to centre distance."""
    rows = with_ml_vector(labelled).select("label", "vec", "features")
    centres = rows.groupBy("label").agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("centre"))
    length = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    spread = rows.join(centres, "label").groupBy("label").agg(
        F.avg(length(F.col("vec").cast("array<double>"), F.col("centre"))).alias("spread")
    )
    each = cut(centres.join(spread, "label"))  # one row per cluster
    everyone = each.agg(F.collect_list(F.struct("label", "centre", "spread")).alias("c")).scalar()
    worst = (
        each.withColumn("others", everyone).select("label", "centre", "spread", F.explode("others").alias("o"))
        .filter(F.col("o.label") != F.col("label"))
        .groupBy("label")
        .agg(F.max(F.try_divide(F.col("spread") + F.col("o.spread"), length(F.col("centre"), F.col("o.centre")))).alias("worst"))
    )
    return worst.agg(F.avg("worst").alias("davies_bouldin_score"))


INTERNAL = {"silhouette_score": silhouette, "davies_bouldin_score": davies_bouldin, "dunn_score": dunn}


def evaluate(labelled: DataFrame, scoring: Sequence[str], truth: str | None = None) -> DataFrame:
    """(metric, score) of the named indices; null for an unknown name."""
    spark = labelled.sparkSession
    found = None
    if truth is not None:
        found = external_indices(labelled, truth).unionByName(binary_indices(labelled, truth))
    for name in scoring:
        if name in INTERNAL:
            one = INTERNAL[name](labelled).select(F.lit(name).alias("metric"), F.col(name).alias("score"))
            found = one if found is None else found.unionByName(one)
    wanted = spark.createDataFrame([(s,) for s in scoring], "metric string")
    if found is None:
        return wanted.withColumn("score", F.lit(None).cast("double"))
    return wanted.join(found, "metric", "left")


METHODS = {"k_means": k_means, "expectation_maximisation": expectation_maximisation, "hierarchical": hierarchical}
LOWER_IS_BETTER = ("davies_bouldin_score",)


def search(
    vectors: DataFrame, method: str, grid: Mapping[str, Sequence], scoring: Sequence[str] = ("silhouette_score",), *,
    truth: DataFrame | None = None, sampled: int | None = None, seed: int = 42, **fixed,
) -> tuple[Clusters, DataFrame]:
    """(best clusters, table of settings with their scores).

    Every combination of the listed parameters is tried, or ``sampled`` of them.
    The table has ``param_*`` and a column per score; the first score decides.
    ``truth`` (id, truth) is needed for scores against known labels.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known are {list(METHODS)}")
    names = list(grid)
    settings = [dict(zip(names, values)) for values in product(*[v if isinstance(v, (list, tuple)) else [v] for v in grid.values()])]
    if sampled is not None and sampled < len(settings):
        settings = random.Random(seed).sample(settings, sampled)
    table, best = [], None
    for setting in settings:
        found = METHODS[method](vectors, **{**fixed, **setting})
        labelled = cut(found.labels.join(vectors.select("id", "vec"), "id"))
        if truth is not None:
            labelled = labelled.join(truth, "id")
        scores = {r["metric"]: r["score"] for r in evaluate(labelled, scoring, None if truth is None else "truth").collect()}
        table.append((*[str(v) for v in setting.values()], *[scores.get(s) for s in scoring]))
        first = scores.get(scoring[0])
        rank = -math.inf if first is None else -first if scoring[0] in LOWER_IS_BETTER else first
        if best is None or rank > best[0]:
            best = (rank, found)
    columns = [f"`param_{n}` string" for n in names] + [f"`{s}` double" for s in scoring]
    return best[1], vectors.sparkSession.createDataFrame(table, ", ".join(columns))
