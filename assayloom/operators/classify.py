"""Classification of samples: labels, splits, models, model choice and scores."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from itertools import product
from statistics import fmean, pstdev
from typing import NamedTuple

from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.draws import uniform
from assayloom.operators.kernels import LANDMARKS, KernelMachine
from assayloom.operators.vectors import with_ml_vector
from assayloom.plans.prefix import running_totals, same_keys
from assayloom.plans.storage import cut
from assayloom.schema import col

# Names of the scores.
DEEPEST = 30  # Spark's limit of a tree's depth
SCORERS = ("accuracy", "precision", "recall", "f1_score", "matthews_corrcoef")


# -------------------------------------------------------------------- labels


def encode_labels(df: DataFrame, column: str, positive: str | None = None, *, order_by: str | None = None, name: str = "encoded_label") -> tuple[DataFrame, DataFrame]:
    """(rows with the code, mapping (code, label)).

    Two classes with a named positive one give 1 and 0; otherwise codes follow the
    first appearance along ``order_by`` (or the label itself).
    """
    first = F.min(col(order_by)) if order_by else F.min(col(column))
    classes = df.groupBy(col(column).alias("label")).agg(first.alias("first"))
    if positive is not None:
        known = classes.agg(F.count("*").alias("n"), F.count_if(F.col("label") == positive).alias("hit")).first()
        if known["n"] < 2:
            raise ValueError("a classifier needs two classes or more")
        if known["n"] == 2 and known["hit"] == 1:
            mapping = classes.select(F.when(F.col("label") == positive, 1).otherwise(0).alias("code"), "label")
            return df.join(mapping.select(F.col("label").alias(column), F.col("code").alias(name)), column), mapping
    ordered = classes.agg(F.array_sort(F.collect_list(F.struct("first", "label"))).alias("c"))
    mapping = ordered.select(F.posexplode("c").alias("code", "x")).select("code", F.col("x.label").alias("label"))
    return df.join(mapping.select(F.col("label").alias(column), F.col("code").alias(name)), column), mapping


def decode_labels(df: DataFrame, mapping: DataFrame, *, code: str = "encoded_label") -> DataFrame:
    """Attach the label of every code."""
    return df.join(mapping.select(F.col("code").alias(code), "label"), code, "left")


# -------------------------------------------------------------------- splits


def _numbered_in_group(df: DataFrame, by: Sequence[str], key: str, seed: int) -> DataFrame:
    """Add ``__row`` 1.. in a random but repeatable order within each group, and ``__size``."""
    drawn = df.withColumn("__draw", uniform(seed, col(key)))
    totals = running_totals(drawn, list(by), "__draw", {"__n": F.lit(1)})
    places = totals.select(*map(col, by), "__draw", F.col("__n_upto").alias("__row"), F.col("__n_total").alias("__size"))
    return same_keys(drawn, places, [*by, "__draw"]).drop("__draw")  # rows without a label are a group of their own


def train_test_split(
    df: DataFrame, label: str = "label", test_size: float = 0.2, *, stratify: bool = True, key: str = "id", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): exactly the share asked for, of every label when stratified."""
    numbered = _numbered_in_group(df, [label] if stratify else [], key, seed)
    in_test = F.col("__row") <= F.round(F.lit(float(test_size)) * F.col("__size"))
    marked = numbered.withColumn("__test", in_test).select(*map(col, df.columns), "__test")
    return marked.filter(~F.col("__test")).drop("__test"), marked.filter("__test").drop("__test")


def with_folds(
    df: DataFrame, strategy: str = "K-Fold", n_splits: int = 5, *, label: str = "label", key: str = "id", seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Add the fold number: ``K-Fold``, ``Stratified K-Fold`` or ``Leave one out``."""
    if strategy == "K-Fold":
        numbered = _numbered_in_group(df, [], key, seed)
        fold = (F.col("__row") - 1) % n_splits
    elif strategy == "Stratified K-Fold":
        numbered = _numbered_in_group(df, [label], key, seed)
        # shift by label, so that small labels do not all start in the first fold
        fold = (F.col("__row") - 1 + F.pmod(F.xxhash64(col(label)), F.lit(n_splits))) % n_splits
    elif strategy == "Leave one out":
        numbered = _numbered_in_group(df, [], key, seed)
        fold = F.col("__row") - 1
    else:
        raise ValueError(f"unknown cross validation {strategy!r}")
    return numbered.withColumn(name, fold.cast("int")).select(*map(col, df.columns), name)


def repeated_folds(df: DataFrame, n_splits: int = 5, n_repeats: int = 10, *, key: str = "id", seed: int = 42) -> list[DataFrame]:
    """One table with folds per repeat, each from a seed of its own."""
    return [with_folds(df, "K-Fold", n_splits, key=key, seed=seed + i) for i in range(n_repeats)]


# -------------------------------------------------------------------- models


class Fitted(NamedTuple):
    model: object
    evaluation: DataFrame  # (param_*, score) of every tried setting
    train: DataFrame
    test: DataFrame
    predictions: DataFrame  # of the test rows


def random_forest_estimator(n_estimators: int = 100, criterion: str = "gini", max_depth: int | None = None, bootstrap: bool = True, seed: int = 6):
    """A forest. Spark grows trees to ``DEEPEST`` levels: the default grows that deep, more raises."""
    if max_depth is not None and not 0 <= max_depth <= DEEPEST:
        raise ValueError(f"max_depth is 0 to {DEEPEST}, not {max_depth}")
    impurity = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy"}[criterion]
    return RandomForestClassifier(
        numTrees=n_estimators, impurity=impurity, maxDepth=DEEPEST if max_depth is None else max_depth, bootstrap=bootstrap, seed=seed, labelCol="label", featuresCol="features"
    )


def svm_estimator(c: float = 1.0, n_rows: int = 1, tolerance: float = 1e-4, max_iter: int = 100, classes: int = 2):
    """Linear support vector machine; the penalty is per row, hence 1 / (C n)."""
    machine = LinearSVC(regParam=1.0 / (c * max(n_rows, 1)), maxIter=max_iter, tol=tolerance, labelCol="label", featuresCol="features")
    return machine if classes == 2 else OneVsRest(classifier=machine, labelCol="label", featuresCol="features")


def parameter_grid(estimator, grid: Mapping[str, Sequence], *, sampled: int | None = None, seed: int = 42) -> list[dict]:
    """All combinations of the listed values, or a repeatable sample of them."""
    names = list(grid)
    combos = [dict(zip(names, values)) for values in product(*[v if isinstance(v, (list, tuple)) else [v] for v in grid.values()])]
    if sampled is not None and sampled < len(combos):
        combos = random.Random(seed).sample(combos, sampled)
    return [{estimator.getParam(n): v for n, v in combo.items()} for combo in combos]


def scores_of(predictions: DataFrame, scoring: Sequence[str], *, truth: str = "label", predicted: str = "prediction") -> dict[str, float]:
    """Scores over all classes; precision, recall and F1 are weighted by the size of the true class.

    Only the table of label pairs, as large as the square of the classes, reaches the driver.
    """
    unknown = [s for s in scoring if s not in SCORERS]
    if unknown:
        raise ValueError(f"unknown scores {unknown}; known are {list(SCORERS)}")
    cells = {(r[0], r[1]): r[2] for r in predictions.groupBy(col(truth), col(predicted)).count().collect()}
    classes = {c for pair in cells for c in pair}
    n = sum(cells.values())
    true = {c: sum(v for (t, _), v in cells.items() if t == c) for c in classes}
    said = {c: sum(v for (_, q), v in cells.items() if q == c) for c in classes}
    hit = {c: cells.get((c, c), 0) for c in classes}
    share = lambda a, b: a / b if b else 0.0
    weighted = lambda f: share(sum(true[c] * f(c) for c in classes), n)
    right = sum(hit.values())
    spread = lambda margin: n * n - sum(v * v for v in margin.values())
    found = {
        "accuracy": share(right, n),
        "precision": weighted(lambda c: share(hit[c], said[c])),
        "recall": weighted(lambda c: share(hit[c], true[c])),
        "f1_score": weighted(lambda c: share(2 * hit[c], said[c] + true[c])),
        "matthews_corrcoef": share(right * n - sum(true[c] * said[c] for c in classes), (spread(true) * spread(said)) ** 0.5),
    }
    return {s: float(found[s]) for s in scoring}


def splits(
    rows: DataFrame, validation: str = "K-Fold", n_splits: int = 5, *, n_repeats: int = 10, train_share: float = 0.8,
    label: str = "label", key: str = "id", seed: int = 42,
) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) pairs of a validation strategy.

    ``K-Fold``, ``Stratified K-Fold``, ``Repeated K-Fold``, ``Leave one out``, or
    ``Manual``: one random split with ``train_share`` of the rows in training.
    """
    if validation == "Manual":
        return [tuple(cut(part) for part in train_test_split(rows, label, 1 - train_share, stratify=False, key=key, seed=seed))]
    if validation == "Repeated K-Fold":
        tables = repeated_folds(rows, n_splits, n_repeats, key=key, seed=seed)
    else:
        if validation == "Leave one out":
            n_splits = rows.count()
        tables = [with_folds(rows, validation, n_splits, label=label, key=key, seed=seed)]
    found = []
    for table in map(cut, tables):
        found += [(table.filter(F.col("fold") != i).drop("fold"), table.filter(F.col("fold") == i).drop("fold")) for i in range(n_splits)]
    return found


def select_model(
    rows: DataFrame, estimator, grid: Sequence[dict], *, score: str | Sequence[str] = "accuracy", validation: str = "K-Fold", n_splits: int = 5,
    n_repeats: int = 10, train_share: float = 0.8, key: str = "id", seed: int = 42,
) -> tuple[object, DataFrame]:
    """(best model refitted on all rows, table of settings with their scores).

    The table has ``param_*`` and, for each score, its mean and deviation over the
    test parts and its mean over the training parts. The first score decides; of
    equal settings the first listed wins. Parts without a row are not scored.
    """
    scoring = [score] if isinstance(score, str) else list(score)
    maps = list(grid) or [{}]
    parts = splits(rows, validation, n_splits, n_repeats=n_repeats, train_share=train_share, key=key, seed=seed)
    table, best = [], None
    for setting in maps:
        test, train = [], []
        for train_rows, test_rows in parts:
            if train_rows.isEmpty() or test_rows.isEmpty():
                continue
            model = estimator.fit(train_rows, setting)
            test.append(scores_of(model.transform(test_rows), scoring))
            train.append(scores_of(model.transform(train_rows), scoring))
        row = [str(v) for v in setting.values()]
        for name in scoring:
            values = [t[name] for t in test]
            row += [fmean(values) if values else None, pstdev(values) if values else None, fmean(t[name] for t in train) if train else None]
        table.append(tuple(row))
        first = row[len(setting)]
        if best is None or (first is not None and (best[0] is None or first > best[0])):
            best = (first, setting)
    columns = [f"`param_{p.name}` string" for p in maps[0]]
    columns += [f"{kind}_{name} double" for name in scoring for kind in ("mean_test", "std_test", "mean_train")]
    return estimator.fit(rows, best[1]), rows.sparkSession.createDataFrame(table, ", ".join(columns))


SEARCHES = ("Grid search", "Randomized search", "Manual")


def _tried(search: str, n_iter: int) -> int | None:
    """How many settings are drawn; all of them in a grid, the first alone if set by hand."""
    if search not in SEARCHES:
        raise ValueError(f"unknown search {search!r}; known are {SEARCHES}")
    return {"Grid search": None, "Randomized search": n_iter, "Manual": 1}[search]


def _classify(labelled: DataFrame, make, grid, *, score, validation, n_splits, n_repeats, test_size, stratify, search, n_iter, seed) -> Fitted:
    """``labelled`` holds (id, vec, label) with codes 0, 1, ..."""
    rows = with_ml_vector(labelled).select("id", "features", F.col("label").cast("double").alias("label"))
    train, test = (cut(part) for part in train_test_split(rows, "label", test_size, stratify=stratify, seed=seed))
    estimator = make(train)
    base = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    settings = parameter_grid(base, grid or {}, sampled=_tried(search, n_iter), seed=seed)
    model, table = select_model(train, estimator, settings, score=score, validation=validation, n_splits=n_splits, n_repeats=n_repeats, seed=seed)
    return Fitted(model, table, train, test, model.transform(test))


def random_forest(
    labelled: DataFrame, grid: Mapping[str, Sequence] | None = None, *, n_estimators: int = 100, criterion: str = "gini",
    max_depth: int | None = None, bootstrap: bool = True, score: str | Sequence[str] = "accuracy", validation: str = "K-Fold", n_splits: int = 5, n_repeats: int = 10,
    test_size: float = 0.2, stratify: bool = True, search: str = "Grid search", n_iter: int = 10, seed: int = 42,
) -> Fitted:
    """Random forest with the chosen validation and parameter search."""
    make = lambda train: random_forest_estimator(n_estimators, criterion, max_depth, bootstrap, seed)
    return _classify(labelled, make, grid, score=score, validation=validation, n_splits=n_splits, n_repeats=n_repeats, test_size=test_size,
                     stratify=stratify, search=search, n_iter=n_iter, seed=seed)


def svm(
    labelled: DataFrame, grid: Mapping[str, Sequence] | None = None, *, c: float = 1.0, tolerance: float = 1e-4, max_iter: int = 100,
    score: str | Sequence[str] = "accuracy", validation: str = "K-Fold", n_splits: int = 5, n_repeats: int = 10, test_size: float = 0.2, stratify: bool = True,
    search: str = "Grid search", n_iter: int = 10, seed: int = 42,
    kernel: str = "linear", gamma: float | str = "scale", coef0: float = 0.0, degree: int = 3, landmarks: int = LANDMARKS,
) -> Fitted:
    """Support vector machine, one against the rest for more than two labels.

    Kernels other than the linear one work on at most ``landmarks`` training rows (see
    ``kernels``); their grid may name kernel, gamma, coef0, degree, C and landmarks.
    """

    def make(train):
        row = train.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first()
        if kernel != "linear":
            return KernelMachine(kernel, gamma, coef0, degree, c, landmarks, tolerance, max_iter, row["k"], seed)
        return svm_estimator(c, row["n"], tolerance, max_iter, row["k"])

    return _classify(labelled, make, grid, score=score, validation=validation, n_splits=n_splits, n_repeats=n_repeats, test_size=test_size,
                     stratify=stratify, search=search, n_iter=n_iter, seed=seed)


# -------------------------------------------------------------------- scores


def classification_scores(
    predictions: DataFrame, scoring: Sequence[str], *, truth: str = "label", predicted: str = "prediction", positive: float = 1
) -> DataFrame:
    """(Metric, Score) of two-class predictions from one confusion count.

    Accuracy and the correlation coefficient hold for any number of classes; an
    unknown name scores null with a note.
    """
    t, p = col(truth) == positive, col(predicted) == positive
    count = lambda c: F.count_if(c).cast("double")
    one = predictions.agg(
        count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"), count(~t & ~p).alias("tn"),
        count(col(truth) == col(predicted)).alias("right"), F.count("*").alias("n"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    known: Mapping[str, Column] = {
        "accuracy": zero(F.col("right"), F.col("n")),
        "precision": zero(tp, tp + fp),
        "recall": zero(tp, tp + fn),
        "matthews_corrcoef": zero(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "f1_score": zero(2 * tp, 2 * tp + fp + fn),
    }
    rows = [
        F.struct(
            F.lit(s).alias("Metric"), known.get(s, F.lit(None)).cast("double").alias("Score"),
            F.lit(None if s in known else "Score not known").alias("Note"),
        )
        for s in scoring
    ]
    return one.select(F.inline(F.array(*rows)))


def _cumulative(scored: DataFrame, truth: str, score: str, positive) -> DataFrame:
    hit = (col(truth) == positive).cast("int")
    return running_totals(scored, [], score, {"tp": hit, "fp": 1 - hit}, descending=True)


def roc_curve(scored: DataFrame, *, truth: str = "label", score: str = "score", positive=1) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, from the highest down, after the origin."""
    totals = _cumulative(scored, truth, score, positive)
    points = totals.select(
        col(score).cast("double").alias("threshold"),
        F.try_divide(F.col("fp_upto"), F.col("fp_total")).alias("fpr"), F.try_divide(F.col("tp_upto"), F.col("tp_total")).alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def roc_auc(scored: DataFrame, *, truth: str = "label", score: str = "score", positive=1) -> DataFrame:
    """One row: area under the ROC curve (trapezoids over distinct scores)."""
    totals = _cumulative(scored, truth, score, positive)
    area = F.sum(F.col("fp") * (F.col("tp_upto") - F.col("tp") / 2.0))
    return totals.agg(F.try_divide(area, F.max("tp_total").cast("double") * F.max("fp_total")).alias("roc_auc"))


def precision_recall_curve(scored: DataFrame, *, truth: str = "label", score: str = "score", positive=1) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, and the end point (1, 0)."""
    totals = _cumulative(scored, truth, score, positive)
    points = totals.select(
        col(score).cast("double").alias("threshold"),
        F.try_divide(F.col("tp_upto"), F.col("tp_upto") + F.col("fp_upto")).alias("precision"),
        F.try_divide(F.col("tp_upto"), F.col("tp_total")).alias("recall"),
    )
    end = scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def average_precision(scored: DataFrame, *, truth: str = "label", score: str = "score", positive=1) -> DataFrame:
    """One row: precision averaged over the steps in recall."""
    totals = _cumulative(scored, truth, score, positive)
    step = F.try_divide(F.col("tp"), F.col("tp_total")) * F.try_divide(F.col("tp_upto"), F.col("tp_upto") + F.col("fp_upto"))
    return totals.agg(F.sum(step).alias("average_precision"))


def model_scores(predictions: DataFrame, positive: int = 1) -> DataFrame:
    """Add ``score`` for the positive class, from probabilities if there are any."""
    source = "probability" if "probability" in predictions.columns else "rawPrediction"
    return predictions.withColumn("score", F.get(vector_to_array(source), F.lit(positive)))
