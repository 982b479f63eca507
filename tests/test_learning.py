import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import classify, cluster, embed, kernels, mixture, outliers
from assayloom.operators.vectors import to_vectors
from tests.conftest import values


@pytest.fixture
def samples(long):
    return long({"Protein1": [18, 20, 22, 8, 10, 12, 12], "Protein2": [16, 18, 19, 15, 14, 13, 13], "Protein3": [1, 2, 3, 1, 2, 3, 3]})


def _partition(labels):
    found = {}
    for r in labels.collect():
        found.setdefault(r["label"], set()).add(int(r["id"].removeprefix("Sample")))
    return sorted(map(sorted, found.values()))


def test_clusters(samples):
    vectors = to_vectors(samples)
    found = cluster.k_means(vectors, 2, init="random")
    assert _partition(found.labels) == [[1, 2, 3], [4, 5, 6, 7]]
    centres = {}
    for r in found.centres.orderBy("label", "position").collect():
        centres.setdefault(r["label"], []).append(round(r["value"], 6))
    assert sorted(centres.values()) == [[10.5, 13.75, 2.25], [20.0, 17.666667, 2.0]]
    assert _partition(cluster.hierarchical(vectors, 2).labels) == [[1, 2, 3], [4, 5, 6, 7]]
    one = cluster.expectation_maximisation(vectors)
    assert {r["label"] for r in one.labels.collect()} == {0} and {r["probability"] for r in one.probabilities.collect()} == {1.0}
    assert _partition(cluster.k_means(vectors, 1).labels) == [[1, 2, 3, 4, 5, 6, 7]]


def test_cluster_errors(samples, long):
    with pytest.raises(ValueError, match="can.t make"):
        cluster.k_means(to_vectors(samples), 8)
    with pytest.raises(ValueError, match="missing"):
        cluster.k_means(to_vectors(long({"A": [1, None], "B": [1, 2]})), 2)


def test_indices_of_a_perfect_and_a_known_clustering(spark):
    score = lambda rows: {r["metric"]: r["score"] for r in cluster.external_indices(spark.createDataFrame(rows, "truth int, label int")).collect()}
    perfect = score([(0, 1), (0, 1), (1, 0), (1, 0)])
    assert perfect["adjusted_rand_score"] == perfect["rand_score"] == perfect["fowlkes_mallows_score"] == 1.0
    assert perfect["adjusted_mutual_info_score"] == pytest.approx(1.0) and perfect["mutual_info_score"] == pytest.approx(math.log(2))
    mixed = score([(0, 0), (0, 0), (1, 1), (1, 2)])
    assert mixed["homogeneity_score"] == pytest.approx(1.0) and mixed["completeness_score"] == pytest.approx(2 / 3)
    assert mixed["v_measure_score"] == pytest.approx(0.8) and mixed["adjusted_rand_score"] == pytest.approx(0.571428571)


def test_distance_indices_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (20, 3)), rng.normal(4, 1, (15, 3)), rng.normal(-5, 1, (1, 3))])
    labels = np.array([0] * 20 + [1] * 15 + [2])
    df = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, labels))], "id int, vec array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i, l in enumerate(labels):
        if (labels == l).sum() == 1:
            s.append(0.0)
            continue
        a = d[i, labels == l].sum() / ((labels == l).sum() - 1)
        b = min(d[i, labels == m].mean() for m in set(labels) - {l})
        s.append((b - a) / max(a, b))
    assert cluster.silhouette(df).first()[0] == pytest.approx(np.mean(s))
    same = labels[:, None] == labels[None]
    assert cluster.dunn(df).first()[0] == pytest.approx(d[~same].min() / d[same].max())
    found = {r["metric"]: r["score"] for r in cluster.evaluate(df, ["silhouette_score", "dunn_score", "unknown"]).collect()}
    assert found["unknown"] is None and found["silhouette_score"] == pytest.approx(np.mean(s))


def test_dunn_by_branch_and_bound_sees_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (400, 2)) + c for c in ((0, 0), (30, 0), (0, 40))])
    x[7] = x[8]  # a copy
    labels = np.repeat([0, 1, 2], 400)
    df = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, labels))], "id int, vec array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    same = labels[:, None] == labels[None]
    packed, between, within = cluster.dunn_blocks(df, 20)
    blocks = packed.count()
    assert between.count() + within.count() < blocks * (blocks + 1) / 2 / 5
    monkeypatch.setattr(cluster, "FEW_BLOCKS", 0)
    assert cluster.dunn(df).first()[0] == pytest.approx(d[~same].min() / d[same].max())


@pytest.mark.parametrize("most", [1, 2, 64])
def test_silhouettes_ship_a_block_once_to_each_tile(spark, monkeypatch, most):
    from assayloom.plans import blocks

    monkeypatch.setattr(blocks, "VECTORS_PER_BLOCK", 16)
    monkeypatch.setattr(cluster, "TILES", 3)
    monkeypatch.setattr(cluster, "BLOCKS_OF_TILE", most)
    rng = np.random.default_rng(6)
    x, labels = rng.normal(0, 1, (150, 3)), rng.integers(0, 4, 150)
    x[labels == 2] += 5
    df = spark.createDataFrame([(i, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(x, labels))], "id int, vec array<double>, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i, l in enumerate(labels):
        a, b = d[i, labels == l].sum() / ((labels == l).sum() - 1), min(d[i, labels == m].mean() for m in range(4) if m != l)
        s.append((b - a) / max(a, b))
    found = cluster.silhouette(df)
    assert found.first()[0] == pytest.approx(np.mean(s))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and " MapInPandas" not in plan


def test_dunn_ships_a_block_once_to_a_tile(spark, monkeypatch):
    monkeypatch.setattr(cluster, "FEW_BLOCKS", 0)
    seen = []
    monkeypatch.setattr(cluster, "in_tiles", lambda *a, real=cluster.in_tiles: seen.append(real(*a)) or seen[-1])
    df = spark.createDataFrame([(i, [float(i), 0.0], i // 3) for i in range(9)], "id int, vec array<double>, label int")
    assert cluster.dunn(df).first()[0] == pytest.approx(0.5)
    assert seen and all("FlatMapGroupsInPandas" in x._jdf.queryExecution().optimizedPlan().toString() for x in seen)


# ------------------------------------------------------------------ outliers


@pytest.fixture
def two_pairs(long):
    return long({"Protein1": [5, 1, 100, 100], "Protein2": [2, 3, 50, 50], "Protein3": [4, 2, 80, 80]})


def test_outlier_factors_over_a_tree_keep_plans_small(spark, monkeypatch):
    from assayloom.plans import blocks

    df = spark.range(64).selectExpr("id", "array(double(id * id)) as vec")
    scores = lambda: {r["id"]: round(r["anomaly_score"], 9) for r in outliers.local_outlier_factor(df, 3).collect()}
    whole, seen = scores(), []
    monkeypatch.setattr(blocks, "FEW_BLOCKS", 0)
    monkeypatch.setattr(blocks, "neighbour_blocks", lambda plain, k, plane, real=blocks.neighbour_blocks: seen.append(real(plain, k, plane, 4)) or seen[-1])
    assert scores() == whole
    assert seen[0][1]._jdf.queryExecution().optimizedPlan().toString().count(" div ") < 100


def test_outlier_methods_refuse_missing_values(long):
    table = long({"A": [None, 1, 2], "B": [1, 2, 3]})
    for method in (outliers.by_isolation_forest, outliers.by_local_outlier_factor, outliers.by_pca):
        with pytest.raises(ValueError, match="missing"):
            method(table)


def test_a_far_sample_is_an_outlier(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    x[7] = 60
    rows = [(f"s{i}", f"p{j}", float(x[i, j])) for i in range(40) for j in range(4)]
    df = spark.createDataFrame(rows, "Sample string, `Protein ID` string, Intensity double")
    for found in (outliers.by_isolation_forest(df, n_estimators=40), outliers.by_local_outlier_factor(df, None, 10), outliers.by_pca(df, None, 3, 2)):
        flagged = values(found.scores.filter("outlier"), "id")
        assert "s7" in flagged and len(flagged) < 20
        assert "s7" not in values(found.kept, "Sample")
    forest = outliers.by_isolation_forest(df, n_estimators=40).scores
    assert forest.orderBy("anomaly_score").first()["id"] == "s7"


def test_pca_flags_follow_the_definition(two_pairs):
    found = outliers.by_pca(two_pairs, threshold=1, number_of_components=2)
    rows = found.scores.toPandas()
    c = rows[["component_1", "component_2"]].to_numpy()
    sd = c.std(axis=0, ddof=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(sd > 1e-9, ((c - np.median(c, axis=0)) / sd) ** 2, 0)
    clear = np.abs(parts.sum(axis=1) - 1) > 1e-6
    assert ((parts.sum(axis=1) > 1) == rows.outlier)[clear].all()
    with pytest.raises(ValueError):
        outliers.by_pca(two_pairs, number_of_components=4)


def test_both_forms_of_principal_components_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(25, 6)) * [5, 3, 1, 1, 1, 1]
    rows = [(f"s{i:02}", f"p{j}", float(x[i, j])) for i in range(25) for j in range(6)]
    df = spark.createDataFrame(rows, "Sample string, `Protein ID` string, Intensity double")
    tall = embed.principal_components(to_vectors(df), 2)
    wide = embed.principal_components_wide(df, 2)
    a, b = (f.scores.orderBy("id").toPandas()[["component_1", "component_2"]].to_numpy() for f in (tall, wide))
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-8)
    assert np.allclose(a.mean(axis=0), 0, atol=1e-9)
    ratios = [f.explained.orderBy("component").toPandas().variance_ratio.to_numpy() for f in (tall, wide)]
    assert np.allclose(*ratios)
    flags = [{r["id"]: r["outlier"] for r in outliers.by_pca(df, threshold=1.0, number_of_components=2, wide=w).scores.collect()} for w in (False, True)]
    assert flags[0] == flags[1] and any(flags[0].values())


def _single(points, k):
    """Merge heights, and the partition into k clusters, by joining the nearest two clusters again and again."""
    clusters, heights, cut = [[i] for i in range(len(points))], [], None
    while len(clusters) > 1:
        if len(clusters) == k:
            cut = sorted(map(sorted, clusters))
        far = lambda a, b: min(((points[i] - points[j]) ** 2).sum() for i in a for j in b)
        d, i, j = min((far(a, b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters[:i]))
        heights.append(np.sqrt(d))
        clusters[j] += clusters.pop(i)
    return sorted(heights), cut or sorted(map(sorted, clusters))


@pytest.mark.parametrize("block", [512, 7])
def test_single_linkage_is_that_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "ROWS_OF_BLOCK", block)
    rng = np.random.default_rng(6)
    # two chains that no centre describes, a cloud, and a copy
    points = np.concatenate([np.c_[np.arange(12), rng.normal(0, 0.1, 12)], np.c_[np.arange(12), 4 + rng.normal(0, 0.1, 12)], rng.normal(30, 0.5, (8, 2)), [[30.0, 33.0]]])
    points = np.concatenate([points, points[-1:]])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    heights, parts = _single(points, 4)
    tree = cluster.spanning_tree(df).collect()
    assert np.allclose(sorted(r["height"] for r in tree), heights)
    found = {}
    for r in cluster.hierarchical(df, 4, linkage="single").labels.collect():
        found.setdefault(r["label"], []).append(r["id"])
    assert sorted(map(sorted, found.values())) == parts
    with pytest.raises(ValueError):
        cluster.hierarchical(df, 4, linkage="ward")


def test_spanning_trees_take_no_row_by_itself(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(3)
    a, b = (rng.normal(0, 1, (40, 5)) * 1e-3 + 1e6 for _ in "ab")
    b[3], a[7] = a[5], a[5]  # copies, and ties
    whole = np.concatenate([a, b])
    labels = rng.integers(0, 6, 80)
    frame = pd.DataFrame([(0, np.arange(40), list(a), labels[:40], 1, np.arange(40, 80), list(b), labels[40:])], columns=["ba", "na", "va", "ca", "bb", "nb", "vb", "cb"])

    class Pairs:
        mapInPandas = staticmethod(lambda run, schema: pd.concat(run(iter([frame]))))

    monkeypatch.setattr(cluster, "_row_by_row", lambda *_: pytest.fail("rows are compared one by one"))
    found = {r.c: (r.d, r.lo, r.hi) for r in cluster._nearest_outside(Pairs).itertuples()}
    edges = [(((whole[i] - whole[j]) ** 2).sum(), i, j) for i in range(40) for j in range(40, 80) if labels[i] != labels[j]]
    assert found == {c: min(e for e in edges if c in (labels[e[1]], labels[e[2]])) for c in set(labels)}


def test_spanning_trees_of_rows_that_are_no_numbers(spark):
    df = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate([0, 1, 3, float("nan"), 1e200])], "id long, vec array<double>")
    heights = sorted(str(r["height"]) for r in cluster.spanning_tree(df).collect())
    assert heights == ["1.0", "2.0", "None", "inf"]


def _scores(found, k):
    return found.scores.orderBy("id").toPandas()[[f"component_{i + 1}" for i in range(k)]].to_numpy()


@pytest.mark.parametrize("gram", [1024, 8])
def test_components_of_noise_are_those_of_a_full_decomposition(spark, monkeypatch, gram):
    """No gap between the variances: the hard case of any iteration."""
    monkeypatch.setattr(embed, "GRAM", gram)
    x = np.random.default_rng(3).normal(size=(60, 80))
    df = spark.createDataFrame([(f"s{i:02}", f"p{j}", float(x[i, j])) for i in range(60) for j in range(80)], "Sample string, `Protein ID` string, Intensity double")
    found = embed.principal_components_wide(df, 2)
    u, s, _ = np.linalg.svd(x - x.mean(axis=0))
    assert np.allclose(np.abs(_scores(found, 2)), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    assert np.allclose([r[1] for r in found.explained.orderBy("component").collect()], s[:2] ** 2 / (s ** 2).sum(), atol=1e-9)


def test_components_of_several_blocks_with_gaps(spark, monkeypatch):
    monkeypatch.setattr(embed, "GRAM", 100)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 20)) * np.r_[20, 9, 4, np.ones(17)]
    gone = rng.random(x.shape) < 0.1
    rows = [(f"s{i:03}", f"p{j}", float(x[i, j])) for i in range(300) for j in range(20) if not gone[i, j]]
    found = embed.principal_components_wide(spark.createDataFrame(rows, "Sample string, `Protein ID` string, Intensity double"), 3)
    held = np.where(gone, np.nan, x)
    centred = np.nan_to_num(held - np.nanmean(held, axis=0))  # absent cells lie at the mean
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(_scores(found, 3)), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def test_more_components_than_samples_are_zero(spark, monkeypatch):
    rows = [("a", "p", 1.0), ("a", "q", 2.0), ("b", "p", 3.0), ("b", "q", 2.0)]
    df = spark.createDataFrame(rows, "Sample string, `Protein ID` string, Intensity double")
    for gram in (1024, 1):
        monkeypatch.setattr(embed, "GRAM", gram)
        assert np.allclose(np.abs(_scores(embed.principal_components_wide(df, 3), 3)), [[1, 0, 0], [1, 0, 0]], atol=1e-7)


# ------------------------------------------------------------ classification


@pytest.fixture
def labelled(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=3) + (3 if i % 2 else 0)).tolist(), i % 2) for i in range(80)]
    return spark.createDataFrame(rows, "id int, vec array<double>, label int")


def test_labels(spark):
    df = spark.createDataFrame([(1, "CTR"), (2, "AD"), (3, "CTR"), (4, "X")], "n int, g string")
    coded, mapping = classify.encode_labels(df, "g", order_by="n")
    assert {r["g"]: r["encoded_label"] for r in coded.collect()} == {"CTR": 0, "AD": 1, "X": 2}
    back = classify.decode_labels(coded.select("n", "encoded_label"), mapping)
    assert {r["n"]: r["label"] for r in back.collect()} == {1: "CTR", 2: "AD", 3: "CTR", 4: "X"}
    two, _ = classify.encode_labels(df.filter("n < 4"), "g", "CTR")
    assert {r["g"]: r["encoded_label"] for r in two.collect()} == {"CTR": 1, "AD": 0}
    with pytest.raises(ValueError):
        classify.encode_labels(df.filter("n = 1"), "g", "CTR")


def test_splits_and_folds(labelled):
    train, test = classify.train_test_split(labelled, "label", 0.25)
    assert test.groupBy("label").count().select("count").distinct().collect()[0][0] == 10 and train.count() == 60
    assert not set(values(train, "id")) & set(values(test, "id"))
    again = classify.train_test_split(labelled.repartition(5), "label", 0.25)[1]
    assert values(again, "id") == values(test, "id")
    folds = classify.with_folds(labelled, "Stratified K-Fold", 4).groupBy("fold", "label").count().collect()
    assert len(folds) == 8 and {r["count"] for r in folds} == {10}
    assert classify.with_folds(labelled, "Leave one out").select("fold").distinct().count() == 80
    first, second = classify.repeated_folds(labelled, 5, 2)
    assert first.join(second.withColumnRenamed("fold", "other"), "id").filter("fold <> other").count() > 20


@pytest.mark.parametrize("fit", [
    lambda d: classify.random_forest(d, {"maxDepth": [2, 3], "numTrees": [5]}, n_splits=2),
    lambda d: classify.svm(d, {"regParam": [0.1, 0.01]}, max_iter=20, n_splits=2, validation="Stratified K-Fold"),
    lambda d: classify.random_forest(d, {"maxDepth": [2, 3, 4]}, n_estimators=5, search="Randomized search", n_iter=2, validation="Manual"),
])
def test_classifiers(labelled, fit):
    found = fit(labelled)
    assert found.evaluation.count() == 2 and "mean_test_accuracy" in found.evaluation.columns
    scores = {r["Metric"]: r["Score"] for r in classify.classification_scores(found.predictions, ["accuracy", "f1_score"]).collect()}
    assert scores["accuracy"] > 0.85 and scores["f1_score"] > 0.85
    assert found.train.count() + found.test.count() == 80
    assert classify.roc_auc(classify.model_scores(found.predictions)).first()[0] > 0.9


def test_scores_and_curves(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    assert classify.roc_auc(df).first()[0] == pytest.approx(0.75)
    points = {(round(r["fpr"], 2), round(r["tpr"], 2)) for r in classify.roc_curve(df).collect()}
    assert points == {(0, 0), (0, 0.5), (0.5, 0.5), (0.5, 1), (1, 1)}
    assert classify.average_precision(df).first()[0] == pytest.approx(0.8333333)
    ends = classify.precision_recall_curve(df).filter(F.col("threshold").isNull()).first()
    assert (ends["precision"], ends["recall"]) == (1.0, 0.0)
    rows = spark.createDataFrame([(1, 1)] * 6 + [(0, 1)] * 2 + [(1, 0)] + [(0, 0)] * 3, "label int, prediction int")
    found = {r["Metric"]: r["Score"] for r in classify.classification_scores(rows, ["accuracy", "precision", "recall", "f1_score", "matthews_corrcoef", "odd"]).collect()}
    assert found["accuracy"] == pytest.approx(9 / 12) and found["precision"] == pytest.approx(6 / 8) and found["recall"] == pytest.approx(6 / 7)
    assert found["matthews_corrcoef"] == pytest.approx((6 * 3 - 2 * 1) / math.sqrt(8 * 7 * 5 * 4)) and found["odd"] is None


def test_rows_without_label_are_split_and_folded_too(spark):
    rows = spark.range(100).selectExpr("id", "case when id % 10 = 0 then null when id % 2 = 0 then 'a' else 'b' end as label")
    train, test = classify.train_test_split(rows, test_size=0.2)
    assert train.count() + test.count() == 100 and test.filter("label is null").count() == 2
    for strategy in ("K-Fold", "Stratified K-Fold"):
        assert classify.with_folds(rows, strategy, 5).groupBy("fold").count().agg({"count": "sum"}).first()[0] == 100


def test_trees_deeper_than_spark_grows_them_raise():
    assert classify.random_forest_estimator().getMaxDepth() == 30
    with pytest.raises(ValueError):
        classify.random_forest_estimator(max_depth=40)


def test_neighbours_far_from_zero_are_those_of_brute_force(spark):
    import numpy as np

    from assayloom.plans.blocks import nearest_neighbours

    rng = np.random.default_rng(4)
    vecs = 1e9 + rng.integers(-20, 20, (120, 16)).astype(float)
    vecs[100:] = vecs[:20]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    got = {}
    for r in nearest_neighbours(spark.createDataFrame(rows, "id long, vec array<double>"), 3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["distance"], r["neighbour"]))
    for i, v in enumerate(vecs):
        d = np.sqrt(((vecs - v) ** 2).sum(axis=1)).round(10)
        want = sorted((x, j) for j, x in enumerate(d) if j != i)[:3]
        assert [(x, j) for _, x, j in sorted(got[i])] == want


def test_several_scores_over_repeated_folds(spark):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(3.0 * (i % 2), 1.0), rng.gauss(0.0, 1.0)], i % 2) for i in range(80)]
    labelled = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    found = classify.random_forest(labelled, {"maxDepth": [1, 3]}, n_estimators=5, max_depth=3, validation="Repeated K-Fold", n_splits=2, n_repeats=2,
                                   score=["matthews_corrcoef", "accuracy"])
    table = found.evaluation.collect()
    assert found.evaluation.columns == [
        "param_maxDepth", "mean_test_matthews_corrcoef", "std_test_matthews_corrcoef", "mean_train_matthews_corrcoef",
        "mean_test_accuracy", "std_test_accuracy", "mean_train_accuracy",
    ]
    assert len(table) == 2 and all(r["mean_test_accuracy"] > 0.7 and r["mean_train_accuracy"] >= 0.7 for r in table)
    by_hand = classify.random_forest(labelled, {"maxDepth": [1, 3]}, n_estimators=3, max_depth=3, validation="Manual", search="Manual")
    assert by_hand.evaluation.count() == 1
    for wrong in ({"score": "kappa"}, {"validation": "holdout"}, {"search": "all"}):
        with pytest.raises(ValueError):
            classify.random_forest(labelled, n_estimators=2, max_depth=2, **wrong)


def test_scores_over_classes_are_those_of_the_confusion_table(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 1)] + [(2, 2)] * 4
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "label double, prediction double")
    got = classify.scores_of(df, ["accuracy", "precision", "recall", "f1_score", "matthews_corrcoef"])
    assert got["accuracy"] == got["recall"] == pytest.approx(12 / 15)
    assert got["precision"] == pytest.approx((7 * 1 + 3 * 0.5 + 5 * 1) / 15)
    assert got["f1_score"] == pytest.approx((7 * 10 / 12 + 3 * 6 / 9 + 5 * 8 / 9) / 15)
    assert got["matthews_corrcoef"] == pytest.approx((12 * 15 - (7 * 5 + 3 * 6 + 5 * 4)) / math.sqrt((225 - 49 - 9 - 25) * (225 - 25 - 36 - 16)))


def test_clusterings_are_searched(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [10.0 * (i % 3) + rng.random(), rng.random()]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, vec array<double>")
    truth = spark.createDataFrame([(i, i % 3) for i, _ in rows], "id long, truth int")
    best, table = cluster.search(vectors, "k_means", {"n_clusters": [2, 3, 5]}, ["adjusted_rand_score", "silhouette_score"], truth=truth, n_init=3)
    scores = {r["param_n_clusters"]: r["adjusted_rand_score"] for r in table.collect()}
    assert scores["3"] == pytest.approx(1.0) and max(scores, key=scores.get) == "3"
    assert best.labels.select("label").distinct().count() == 3
    with pytest.raises(ValueError):
        cluster.search(vectors, "spectral", {"n_clusters": [2]})


def test_chance_information_of_large_labels_takes_no_large_array():
    import time

    def slow(a, b, n):
        log = math.lgamma
        total = 0.0
        for k in range(max(1, a + b - n), min(a, b) + 1):
            w = log(a + 1) + log(b + 1) + log(n - a + 1) + log(n - b + 1) - log(n + 1) - log(k + 1) - log(a - k + 1) - log(b - k + 1) - log(n - a - b + k + 1)
            total += k / n * math.log(n * k / (a * b)) * math.exp(w)
        return total

    for a, b, n in ((5, 7, 20), (1, 1, 2), (90, 40, 100), (300, 500, 1000), (1000, 1000, 1000)):
        assert cluster._expected(a, b, n) == pytest.approx(slow(a, b, n), abs=1e-10)
    start = time.time()
    assert 0 <= cluster._expected(10 ** 8, 10 ** 8, 10 ** 9) < 1e-6
    assert time.time() - start < 2


def test_silhouettes_of_text_labels(spark):
    rows = [(i, [float(i % 2) * 5 + i * 0.01, 1.0], "ab"[i % 2]) for i in range(20)]
    found = cluster.silhouette(spark.createDataFrame(rows, "id long, vec array<double>, label string")).first()[0]
    assert 0.9 < found < 1


def _blobs(kind):
    """Two clouds that touch, stretched as the kind of covariance allows; 7 apart, a million from zero."""
    rng = np.random.default_rng(11)
    stretch = {"full": [[3, 1], [0, 0.3]], "tied": [[3, 1], [0, 0.3]], "diag": [[3, 0], [0, 0.3]], "spherical": [[1, 0], [0, 1]]}[kind]
    x = np.concatenate([rng.normal(size=(80, 2)) @ stretch, rng.normal(size=(40, 2)) @ stretch + [0, 7.0]])
    return x + 1e6, np.r_[np.zeros(80), np.ones(40)]


@pytest.mark.parametrize("kind", mixture.KINDS)
def test_mixtures_of_each_covariance(spark, kind):
    x, truth = _blobs(kind)
    start = np.where(np.arange(120) % 5 == 0, 1 - truth, truth).astype(int)  # a fifth is wrong at first
    df = spark.createDataFrame([(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(x, start))], "id long, vec array<double>, label int").repartition(5)
    found, seen = mixture.fit(df, 2, kind, max_iter=60, tolerance=1e-7, reg_covar=0.0)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and len(seen) > 2  # the likelihood never falls
    got = {(r["id"], r["component"]): r["probability"] for r in mixture.probabilities(df, found).collect()}
    right = np.mean([round(got[i, 1]) == t for i, t in enumerate(truth)])
    assert right > 0.97 and all(abs(got[i, 0] + got[i, 1] - 1) < 1e-9 for i in range(120))
    # one more round by brute force
    share = np.array([[got[i, c] for c in (0, 1)] for i in range(120)])
    means = (share.T @ x) / share.sum(axis=0)[:, None]
    after, _ = mixture.one_round(df, found, 0.0)
    assert np.allclose(after.means, means, atol=1e-6) and np.allclose(after.weights, share.mean(axis=0))
    each = [np.cov(x.T, aweights=share[:, c], ddof=0) for c in (0, 1)]
    want = {"full": np.array(each), "tied": np.tensordot(share.mean(axis=0), each, 1), "diag": np.array([np.diag(e) for e in each]),
            "spherical": np.array([np.diag(e).mean() for e in each])}[kind]
    assert np.allclose(after.covariances, want, atol=1e-5)


def test_mixture_labels_and_refusals(spark):
    x, truth = _blobs("diag")
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
    found = cluster.expectation_maximisation(df, 2, covariance_type="tied", tolerance=1e-6)
    labels = {r["id"]: r["label"] for r in found.labels.collect()}
    agree = np.mean([labels[i] == t for i, t in enumerate(truth)])
    assert len(labels) == 120 and max(agree, 1 - agree) > 0.97 and found.probabilities.count() == 240
    with pytest.raises(ValueError):
        cluster.expectation_maximisation(df, 2, covariance_type="round")
    wide = spark.createDataFrame([(0, [0.0] * 1200, 0)], "id long, vec array<double>, label int")
    with pytest.raises(ValueError):
        mixture.from_labels(wide, 1, "full")
    assert mixture.from_labels(wide, 1, "diag").covariances.shape == (1, 1200)


def test_products_of_mapped_rows_are_kernel_values(spark):
    x = np.random.default_rng(5).normal(size=(30, 4))
    x[7] = x[8]  # a copy among the landmarks
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>")
    shape = kernels.kernel(df, "rbf")
    assert np.isclose(shape.gamma, 1 / (4 * x.var())) and kernels.kernel(df, "rbf", "auto").gamma == 0.25
    mapped = kernels.fit_map(df, shape)(df.repartition(4)).orderBy("id").toPandas()["mapped"]
    z = np.array(mapped.tolist())
    assert np.allclose(z @ z.T, np.exp(-shape.gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2)), atol=1e-6)
    few = kernels.landmarks(df, 6)
    assert few.shape == (6, 4) and np.array_equal(few, kernels.landmarks(df.repartition(7), 6))
    with pytest.raises(ValueError):
        kernels.landmarks(df, 10**7)
    with pytest.raises(ValueError):
        kernels.kernel(df, "laplace")
    with pytest.raises(ValueError):
        kernels.kernel(df.limit(0), "rbf")


def test_a_ring_needs_a_kernel(spark):
    rng = np.random.default_rng(2)
    turn, far = rng.uniform(0, 2 * np.pi, 240), np.r_[rng.uniform(0, 1, 120), rng.uniform(1.5, 2.5, 120)]
    rows = [(i, [float(r * np.cos(t)), float(r * np.sin(t))], int(i >= 120)) for i, (t, r) in enumerate(zip(turn, far))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    right = lambda found: found.predictions.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
    assert right(classify.svm(df, n_splits=2, max_iter=10)) < 0.75
    found = classify.svm(df, {"gamma": [1e-6, 1.0]}, kernel="rbf", c=10.0, landmarks=40, n_splits=2, max_iter=15)
    assert right(found) > 0.9
    scores = {r["param_gamma"]: r["mean_test_accuracy"] for r in found.evaluation.collect()}
    assert set(scores) == {"1e-06", "1.0"} and scores["1.0"] > 0.9
