import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayloom.functions.draws import normal, shuffled, uniform
from assayloom.plans import balls, blocks, prefix, storage
from assayloom.plans.blocks import nearest_neighbours


@pytest.fixture
def skewed(spark):
    """Three groups; one holds most rows, and a third of its values are one and the same."""
    rng = np.random.default_rng(7)
    rows = [("hot", 0.5 if i % 3 == 0 else float(rng.normal())) for i in range(3000)]
    rows += [("cold", float(rng.normal())) for _ in range(50)] + [("one", 2.0)]
    return spark.createDataFrame(rows, "k string, x double").repartition(6)


def test_running_totals(skewed):
    pdf = skewed.toPandas()
    for descending in (False, True):
        found = prefix.running_totals(skewed, ["k"], "x", {"n": F.lit(1), "s": F.col("x")}, descending=descending).toPandas()
        for key, group in pdf.groupby("k"):
            got = found[found.k == key].sort_values("x", ascending=not descending)
            values, counts = np.unique(group.x, return_counts=True)
            if descending:
                values, counts = values[::-1], counts[::-1]
            assert np.array_equal(got.x, values)
            assert np.array_equal(got.n_upto, counts.cumsum())
            assert np.allclose(got.s_upto, (values * counts).cumsum())
            assert (got.n_total == len(group)).all()


def test_ranges_stay_small_in_a_hot_group(skewed):
    found = prefix.running_totals(skewed, ["k"], "x", {"n": F.lit(1)})
    sizes = found.groupBy("k", "__range").count().toPandas()
    assert sizes[sizes.k == "hot"]["count"].max() < 100  # of about 2000 distinct values


def test_whole_table_needs_no_single_task_window(skewed):
    found = prefix.running_totals(skewed, [], "x", {"n": F.lit(1)})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    by_value = [line for line in plan.splitlines() if "Window [" in line and "__order" in line]
    assert by_value and all("windowspecdefinition(__range" in line for line in by_value)
    assert found.agg(F.max("n_upto")).first()[0] == 3051


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.77, 1.0])
def test_quantiles(skewed, p):
    got = {r["k"]: r["q"] for r in prefix.group_quantiles(skewed, ["k"], "x", {"q": p}).collect()}
    for key, group in skewed.toPandas().groupby("k"):
        assert got[key] == pytest.approx(np.quantile(group.x, p))


def test_running_extreme(skewed):
    totals = prefix.running_totals(skewed, ["k"], "x", {"s": F.col("x")})
    found = prefix.running_extreme(totals, ["k"], F.abs("x"), "m", lowest=True, backwards=True).toPandas()
    for key, group in skewed.toPandas().groupby("k"):
        values = np.unique(group.x)
        want = np.minimum.accumulate(np.abs(values)[::-1])[::-1]
        assert np.allclose(found[found.k == key].sort_values("x").m, want)


def test_running_extreme_keeps_no_frame_that_is_computed_anew_for_each_row(skewed):
    totals = prefix.running_totals(skewed, ["k"], "x", {"s": F.col("x")})
    for backwards in (False, True):
        found = prefix.running_extreme(totals, ["k"], F.col("x"), "m", lowest=True, backwards=backwards)
        assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower().split("__best", 1)[1]
        assert found.count() == totals.count()


def test_draws(spark):
    df = spark.range(20000).select("id", uniform(3, F.col("id")).alias("u"), normal(3, F.col("id")).alias("z"))
    row = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z")).first()
    assert row[0] == pytest.approx(0.5, abs=0.02) and row[1] > 0 and row[2] < 1
    assert row[3] == pytest.approx(0, abs=0.03) and row[4] == pytest.approx(1, abs=0.03)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000])
def test_shuffles_are_permutations(spark, n):
    keys = F.expr("explode(array(5L, -9L))").alias("key")
    df = spark.range(n).select("id", keys, F.lit(n).cast("long").alias("n"))
    moved = df.select("key", shuffled("id", "key", "n").alias("to")).toPandas()
    for _, group in moved.groupby("key"):
        assert sorted(group.to) == list(range(n))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_neighbours_with_many_copies(spark, metric, monkeypatch):
    from assayloom.plans import blocks

    monkeypatch.setattr(blocks, "VECTORS_PER_BLOCK", 32)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(150, 6)), np.tile(rng.normal(size=6), (75, 1))])  # a third are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    found = nearest_neighbours(df, 4, metric).toPandas().sort_values(["id", "rank"])
    if metric == "euclidean":
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    elif metric == "manhattan":
        d = np.abs(x[:, None] - x[None]).sum(-1)
    else:
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    assert np.allclose(found.distance.to_numpy().reshape(len(x), 4), np.sort(d, axis=1)[:, :4], atol=1e-6)
    assert (found.id != found.neighbour).all()


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id int, vec array<double>")
    assert nearest_neighbours(df, 20).count() == 6


def test_storage_uses_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage.shared_folder(spark)
    assert folder == (named or spark.sparkContext.getCheckpointDir())
    assert storage.scratch_path(spark, "x").startswith(folder)
    assert storage.cut(spark.range(5)).count() == 5


def test_scratch_tables_are_cleared(spark):
    from assayloom.plans import storage

    storage.clear(spark)
    path = storage.scratch_path(spark, "kept")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert storage.clear(spark) == 1 and storage.clear(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_neighbours_by_balls_equal_all_pairs(spark, monkeypatch, metric):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 1, (120, 3)) + c for c in ((0, 0, 9), (40, 0, 1), (0, 50, 2))] + [np.full((90, 3), 7.0), [[1e4, 0, 0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    key = lambda found: {(r["id"], r["rank"]): (r["neighbour"], round(r["distance"], 8)) for r in found.collect()}
    whole = key(nearest_neighbours(df, 4, metric))
    few = lambda plain, k, plane: blocks_of(plain, k, plane, 16)
    blocks_of = blocks.neighbour_blocks
    monkeypatch.setattr(blocks, "FEW_BLOCKS", 0)
    monkeypatch.setattr(blocks, "neighbour_blocks", few)
    assert key(nearest_neighbours(df, 4, metric)) == whole


def test_pairs_of_balls_grow_slower_than_all_pairs(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for n in (500, 4000):  # more clusters of a like size, as when data of more kinds come
        x = rng.normal(0, 1, (n, 2)) + rng.uniform(0, 1e4, (n // 60, 2))[rng.integers(0, n // 60, n)]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
        pairs.append(blocks.neighbour_blocks(df, 3, "euclidean", 25)[1].count())
    assert pairs[1] < pairs[0] * 8 ** 1.5, pairs  # all pairs would be 64 times as many


def test_plans_of_pairs_do_not_grow_with_the_tree(spark):
    df = spark.range(64).selectExpr("id", "array(double(id * id)) as vec")
    size = lambda per_block: blocks.neighbour_blocks(df, 2, "euclidean", per_block)[1]._jdf.queryExecution().optimizedPlan().toString().count(" div ")
    assert size(4) == size(16)  # four levels and two: conditions of a level say nothing about the next


def test_cells_are_even_but_for_copies(spark):
    x = [(i, [float(i % 50), float(i * i % 97)]) for i in range(600)] + [(1000 + i, [3.0, 3.0]) for i in range(100)]
    df = spark.createDataFrame(x, "id long, vec array<double>").withColumn("root", F.lit(0))
    sizes = [(r["n"], r["copies"]) for r in balls.grown(df, 40).groupBy("root", "node").agg(F.count("*").alias("n"), F.count_distinct("vec").alias("copies")).collect()]
    assert sum(n for n, _ in sizes) == 700 and all(n <= 40 or copies == 1 for n, copies in sizes)


def test_a_block_is_shipped_once_to_a_tile_of_others(spark):
    rng = np.random.default_rng(4)
    made, rows = [], []
    for node, part in [(32, 0), (33, 0), (33, 1), (33, 40), (40, 0), (64, 0)]:
        ids = list(range(len(rows), len(rows) + 8))
        rows += [(i, rng.normal(0, 1, 3).tolist()) for i in ids]
        made.append((f"0.{node}.{part}", 0, node, ids, [v for _, v in rows[-8:]]))
    packed = spark.createDataFrame(made, "block string, root int, node long, ids array<long>, vecs array<array<double>>")
    pairs = spark.createDataFrame([(a[0], b[0], [float("inf")] * 8) for a in made for b in made], "block string, other string, bounds array<double>")
    found = blocks.nearest_in_tiles(packed, pairs, 48, "euclidean", "id long, neighbour long, distance double")
    got = {(r["id"], r["neighbour"]): r["distance"] for r in found.collect()}
    want = {(i, j): np.linalg.norm(np.subtract(v, w)) for i, v in rows for j, w in rows if i != j}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "MapInPandas run" not in plan


@pytest.mark.parametrize("far", [0.0, 1e6, 1e12])
def test_screened_sums_of_differences_keep_their_bound(far):
    rng = np.random.default_rng(8)
    for d in (1, 7, 300):
        a, b = rng.normal(0, 1, (40, d)) * rng.choice([1e-6, 1, 1e3], d) + far, rng.normal(0, 1, (50, d)) + far
        b[3] = a[5]
        rough, error = blocks._screened(a, b)
        exact = np.abs(a[:, None] - b[None]).sum(axis=2)
        assert np.abs(rough - exact).max() <= error
    assert error < (0.1 if far < 1e9 else 100) * exact.max()


def test_manhattan_neighbours_are_screened_in_single_precision(spark, monkeypatch):
    calls = []
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(0, 1, (60, 5)), 1)
    x[10] = x[40]
    frame = pd.DataFrame({"block": [0], "q_ids": [np.arange(60)], "q_vecs": [list(x)], "t_ids": [np.arange(60)], "t_vecs": [list(x)], "bound": [np.inf]})
    monkeypatch.setattr(blocks, "_screened", lambda a, b, real=blocks._screened: calls.append(1) or real(a, b))
    found = pd.concat(blocks._top(4, "manhattan")(iter([frame])))
    d = np.round(np.abs(x[:, None] - x[None]).sum(axis=2), 10)
    np.fill_diagonal(d, np.inf)
    want = {(i, j, d[i, j]) for i in range(60) for j in np.lexsort((np.arange(60), d[i]))[:4]}
    assert calls and set(zip(found["id"], found["neighbour"], found["distance"])) == want


@pytest.mark.parametrize("far", [0.0, 1e6, 1e12])
def test_pairs_within_limits_are_screened_in_single_precision(far):
    rng = np.random.default_rng(5)
    for d in (1, 7, 300):
        a, b = rng.normal(0, 1, (40, d)) * rng.choice([1e-6, 1, 1e3], d) + far, rng.normal(0, 1, (50, d)) + far
        b[3] = a[5]
        exact = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
        for limits in (np.sort(exact, axis=1)[:, 4], np.zeros(40), np.full(40, 1e300)):
            found = set(zip(*blocks._within(a, b, limits)))
            assert found >= set(zip(*np.nonzero(exact <= limits[:, None])))
    assert far or len(set(zip(*blocks._within(a, b, np.zeros(40))))) < 40


def test_bounded_rows_meet_blocks_without_a_matrix_of_distances(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(0, 1, (60, 5)), np.tile(rng.normal(0, 1, 5), (30, 1))])
    ids = np.array([f"s{i}" for i in range(90)], dtype=object)
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 10)
    np.fill_diagonal(d, np.inf)
    bound = np.sort(d, axis=1)[:, 3] + 0.5
    parts = np.split(np.arange(90), 6)
    rows = [(int(a), ids[p], list(x[p]), ids[q], list(x[q]), bound[p]) for a, p in enumerate(parts) for q in parts]
    frame = pd.DataFrame(rows, columns=["block", "q_ids", "q_vecs", "t_ids", "t_vecs", "bound"])
    monkeypatch.setattr(blocks, "distance_matrix", lambda *_: pytest.fail("all distances are taken"))
    found = pd.concat(blocks._top(4, "euclidean")(iter([frame])))
    want = {(ids[i], ids[j], d[i, j]) for i in range(90) for j in np.lexsort((ids, d[i]))[:4]}
    assert set(zip(found["id"], found["neighbour"], found["distance"])) == want


def test_tiles_are_dealt_out_to_all_tasks(spark):
    made = [(f"0.{node}.0", 0, node, [node], [[float(node)]]) for node in range(32, 64)]
    packed = spark.createDataFrame(made, "block string, root int, node long, ids array<long>, vecs array<array<double>>")
    pairs = spark.createDataFrame([(a[0], b[0], [float("inf")]) for a in made for b in made], "block string, other string, bounds array<double>")
    found = blocks.nearest_in_tiles(packed, pairs, 2, "euclidean", "id long, neighbour long, distance double")
    assert found.count() == 64
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
