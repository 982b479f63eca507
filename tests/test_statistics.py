import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.functions import tails
from assayloom.operators import charts, filters, ptm, stats
from tests.conftest import column, values


@pytest.fixture
def table(long):
    return long({
        "Protein1": [20, 20, 22, 8, 10, 12, 12], "Protein2": [16, 15, 14, 15, 14, 13, 13],
        "Protein3": [1, 2, 3, 1, 2, 3, 3], "Protein4": [14, 15, 16, 9, 10, 11, 11],
    })


@pytest.fixture
def groups(metadata):
    return metadata(["Group1"] * 3 + ["Group2"] * 3 + ["Group3"])


def _p(found):
    return list(dict(sorted(column(found.results, "Protein ID", "corrected_p_value").items())).values())


def test_t_tests(table, groups):
    welch = stats.t_test(table, groups, "Group", "Group1", "Group2", equal_var=False)
    assert _p(welch) == [0.0072, 0.3838, 1.0, 0.0072]
    pooled = stats.t_test(table, groups, "Group", "Group1", "Group2")
    assert _p(pooled) == [0.0053, 0.3838, 1.0, 0.0072]
    assert values(stats.significant(pooled), "Protein ID") == ["Protein1", "Protein4"]
    assert pooled.corrected_alpha.first()["corrected_alpha"] == 0.05
    assert stats.with_results(table, pooled.results).count() == 28


def test_linear_model(table, groups):
    found = stats.linear_model(table, groups, "Group", "Group1", "Group2", log_base="log2")
    assert _p(found) == [0.0053, 0.3838, 1.0, 0.0072]
    assert column(found.results, "Protein ID", "log2_fold_change") == {"Protein1": -10.1926, "Protein2": -1.0, "Protein3": 0.0, "Protein4": -5.0}


def test_fold_change_of_logged_data(long, groups):
    rows = {"Protein1": [18, 20, 22, 8, 10, 12], "Protein2": [16, 15, 14, 15, 14, 13]}
    logged = long({k: [float(np.log2(x)) for x in v] for k, v in rows.items()})
    found = stats.t_test(logged, groups, "Group", "Group1", "Group2", equal_var=False, log_base="log2")
    assert column(found.results, "Protein ID", "log2_fold_change", 1) == {"Protein1": -1.0, "Protein2": -0.1}


def test_anova(long, metadata):
    table = long({"Protein1": [18, 20, 22, 8, 10, 12], "Protein2": [16, 15, 14, 2, 5, 4], "Protein3": [1, 2, 3, 1, 2, 3]})
    groups = metadata(["Group1"] * 3 + ["Group2"] * 3)
    found = stats.anova(table, groups, "Group")
    assert _p(found) == [0.0054, 0.0013, 1.0]
    assert stats.sample_groups(table, groups, "Group", found.results).count() == 6
    with pytest.raises(ValueError):
        stats.anova(table, groups, "Group", ["Group1", "Nobody"])


def test_undefined_features_are_omitted(long, groups):
    table = long({
        "gap": [1, None, 3, 4, 5, 6], "flat": [2] * 6, "step": [1, 1, 1, 2, 2, 2], "fine": [1, 2, 3, 4, 5, 7],
    })
    for test in (stats.t_test, stats.linear_model):
        found = test(table, groups, "Group", "Group1", "Group2")
        assert values(found.results, "Protein ID") == ["fine", "step"]
        assert values(found.omitted, "Protein ID") == ["flat", "gap"]
        assert column(found.results, "Protein ID", "p_value")["step"] == 0.0
    found = stats.anova(table, groups, "Group", ["Group1", "Group2"])
    assert values(found.omitted, "Protein ID") == ["flat", "gap"]


def test_group_choice(groups):
    assert stats.two_groups(groups, "Group", "Group2", "Group1") == ("Group2", "Group1")
    assert stats.two_groups(groups, "Group", "x", "Group1") == ("Group1", "Group2")
    assert stats.two_groups(groups, "Group", "Group3", "Group3") == ("Group3", "Group1")


def test_mann_whitney(table, groups):
    found = stats.mann_whitney(table, groups, "Group", "Group1", "Group2")
    assert column(found.results, "Protein ID", "u_statistic") == {"Protein1": 9, "Protein2": 7, "Protein3": 4.5, "Protein4": 9}
    p = column(found.results, "Protein ID", "p_value")
    assert p["Protein4"] == 0.1  # exact: 2 of 20 arrangements
    assert p["Protein3"] == 1.0
    wide = table.groupBy("Sample").pivot("`Protein ID`").agg(F.first("Intensity"))
    on_columns = stats.mann_whitney_on_columns(wide, groups, "Group", "Group1", "Group2")
    assert column(on_columns.results, "column", "p_value") == p


def test_exact_u_distribution_counts_arrangements():
    from itertools import combinations

    n1, n2 = 3, 4
    us = [sum(r) - n1 * (n1 + 1) // 2 for r in combinations(range(1, n1 + n2 + 1), n1)]
    lower = tails.rank_sum_lower(n1, n2, n1 * n2)
    for u in range(n1 * n2 + 1):
        assert lower[u] == pytest.approx(sum(x <= u for x in us) / len(us))
    assert tails.rank_sum_lower(n2, n1, 5) == pytest.approx(lower[:6])


def test_exact_u_distribution_of_large_groups():
    # far tails: one arrangement of all has U = 0, one U = 1, two U = 2, three U = 3
    far = tails.rank_sum_lower(30_000, 8, 3)
    assert far == pytest.approx(np.array([1, 2, 4, 7]) / math.comb(30_008, 8), rel=1e-12)
    # half of the arrangements lie on either side of the middle; of 600 there are more than a float can count
    for n, error in ((200, 1e-12), (600, 1e-6)):
        middle = tails.rank_sum_lower(n, n, n * n // 2)
        assert np.all(np.diff(middle) >= 0)
        assert middle[-1] + middle[-2] == pytest.approx(1.0, abs=error)


def test_exact_p_of_a_feature_that_one_group_lacks(long, metadata):
    table = long({"a": [1, 2, 3, 4], "b": [5, 6, 7, 8]}).filter("not (`Protein ID` = 'b' and Sample in ('Sample1', 'Sample2'))")
    found = stats.mann_whitney(table, metadata(["x", "x", "y", "y"]), "Group", "x", "y", p_value="exact").results
    assert column(found, "Protein ID", "p_value") == {"a": 0.3333}


def test_incomplete_beta():
    assert tails.incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248)  # 1 - sum of binomial terms
    assert tails.incomplete_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)
    assert tails.incomplete_beta(5.0, 1.0, [0.0, 0.5, 1.0]) == pytest.approx([0, 0.5**5, 1])
    assert np.isnan(tails.incomplete_beta(np.nan, 1.0, 0.5))


def test_benjamini_hochberg(spark):
    rng = random.Random(1)
    p = [round(rng.random() ** 3, 3) for _ in range(500)] + [1.0] * 300  # many ties
    df = spark.createDataFrame(list(enumerate(p)), "id int, p_value double")
    got = {r["id"]: r["corrected_p_value"] for r in stats.correct_p_values(df).collect()}
    order = np.argsort(p, kind="stable")
    raw = np.array(p)[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    for place, i in enumerate(order):
        assert got[i] == pytest.approx(max(want[place], 0))
    assert all(got[i] >= p[i] for i in got)


def test_bonferroni_changes_the_level_only(table, groups):
    found = stats.t_test(table, groups, "Group", "Group1", "Group2", method=stats.BONFERRONI)
    assert found.corrected_alpha.first()["corrected_alpha"] == pytest.approx(0.05 / 4)
    assert found.results.filter("p_value <> corrected_p_value").count() == 0
    with pytest.raises(ValueError):
        stats.t_test(table, groups, "Group", "Group1", "Group2", method="other")


def test_most_significant(table, groups):
    found = stats.t_test(table, groups, "Group", "Group1", "Group2").results
    assert filters.most_significant(found).first()["Protein ID"] == "Protein1"


def test_partitioning_does_not_matter(table, groups):
    once = stats.t_test(table, groups, "Group", "Group1", "Group2").results
    again = stats.t_test(table.repartition(9), groups, "Group", "Group1", "Group2").results
    assert column(once, "Protein ID", "corrected_p_value", 12) == column(again, "Protein ID", "corrected_p_value", 12)


# ------------------------------------------------------------- modifications


@pytest.fixture
def evidence(spark):
    plain, acetyl = "Unmodified", "Acetyl (Protein N-term)"
    rows = [
        ("S1", "A", plain), ("S1", "B", plain), ("S1", "B", acetyl), ("S1", "B", acetyl + ",Oxidation (M)"),
        ("S2", "A", "2 Oxidation (M)," + acetyl), ("S2", "A", plain + "," + plain), ("S3", "A", None),
    ]
    return spark.createDataFrame(rows, "Sample string, `Protein ID` string, Modifications string")


def test_modifications(evidence):
    found = {(r["Sample"], r["modification"]): r["amount"] for r in ptm.modifications_per_sample(evidence).collect()}
    assert found == {
        ("S1", "Unmodified"): 2, ("S1", "Acetyl (Protein N-term)"): 2, ("S1", "Oxidation (M)"): 1,
        ("S2", "Oxidation (M)"): 2, ("S2", "Acetyl (Protein N-term)"): 1, ("S2", "Unmodified"): 1,
    }
    wide = ptm.modifications_per_sample_wide(evidence, ["Unmodified", "Oxidation (M)"])
    assert sorted(tuple(r) for r in wide.collect()) == [("S1", 2, 1), ("S2", 1, 2), ("S3", 0, 0)]
    texts = {(r["Sample"], r["Protein ID"]): r["Modifications"] for r in ptm.modifications_per_feature(evidence).collect()}
    assert texts["S1", "B"] == "(2) Acetyl (Protein N-term), (1) Oxidation (M), (1) Unmodified, "
    assert texts["S3", "A"] == ""


# -------------------------------------------------------------------- charts


def test_box_statistics(long):
    found = charts.box_statistics(long({"A": [1, 2, 3, 4, None]}), "Protein ID").first()
    assert [found[c] for c in ("min", "q1", "median", "q3", "max")] == [1, 1.75, 2.5, 3.25, 4]


def test_histogram_puts_the_largest_value_into_the_last_bin(long):
    found = charts.histogram(long({"A": list(range(11))}), bins=10).collect()
    assert {r["bin"]: r["n"] for r in found} == {**{i: 1 for i in range(9)}, 9: 2}
    flat = charts.histogram(long({"A": [5, 5]})).collect()
    assert [(r["bin"], r["n"]) for r in flat] == [(0, 2)]


def test_volcano(table, groups):
    found = stats.t_test(table, groups, "Group", "Group1", "Group2").results
    rows = {r["Protein ID"]: r for r in charts.volcano(found, 0.05, 0.9, ["Protein4"]).collect()}
    assert [p for p, r in sorted(rows.items()) if r["significant"]] == ["Protein1"]
    assert rows["Protein4"]["of_interest"] and not rows["Protein1"]["of_interest"]


def test_similar_features(long):
    table = long({"A": [1, 2, 3], "B": [10, 20, 30], "C": [3, 2, 1]})
    assert values(charts.similar_features(table, "A", 0.1), "Protein ID") == ["B"]
    assert values(charts.similar_features(table, "A", -1.0, "cosine similarity"), "Protein ID") == ["B", "C"]
    with pytest.raises(ValueError):
        charts.similar_features(table, "A", 2.0, "cosine similarity")


def test_p_values_without_a_family_are_a_family(spark):
    rows = [("f", 0.01), (None, 0.02), (None, 0.04), ("f", None)]
    df = spark.createDataFrame(rows, "family string, p_value double")
    got = stats.correct_p_values(df, by=["family"]).collect()
    assert sorted((r["family"] or "", r["p_value"] or 0, r["corrected_p_value"] or 0) for r in got) == [("", 0.02, 0.04), ("", 0.04, 0.04), ("f", 0, 0), ("f", 0.01, 0.01)]


def test_a_beta_function_that_does_not_settle_raises(monkeypatch):
    import builtins

    from assayloom.functions import tails

    assert abs(float(tails.incomplete_beta(3.0, 2.0, 0.5)) - 0.3125) < 1e-12
    monkeypatch.setattr(tails, "range", lambda a, b: builtins.range(a, 3), raising=False)
    with pytest.raises(ArithmeticError):
        tails.incomplete_beta(500.0, 700.0, 0.4)


def test_kinds_of_rank_p_values(spark):
    import itertools

    x, y = [1.0, 4.0, 6.0, 9.0], [2.0, 7.0, 11.0, 12.0, 13.0]
    rows = [(f"S{i}", "P", v) for i, v in enumerate(x + y)]
    table = spark.createDataFrame(rows, "Sample string, `Protein ID` string, Intensity double")
    groups = spark.createDataFrame([(f"S{i}", "a" if i < 4 else "b") for i in range(9)], "Sample string, Group string")
    p = {k: stats.mann_whitney(table, groups, "Group", "a", "b", p_value=k).results.first()["p_value"] for k in ("auto", "exact", "asymptotic")}
    u = sum(a > b for a in x for b in y)
    high = max(u, 20 - u)
    sums = [sum(c) - 10 for c in itertools.combinations(range(1, 10), 4)]
    assert p["exact"] == p["auto"] == pytest.approx(min(1, 2 * sum(s >= high for s in sums) / len(sums)))
    assert p["asymptotic"] != p["exact"] and 0 < p["asymptotic"] <= 1
    with pytest.raises(ValueError):
        stats.mann_whitney(table, groups, "Group", p_value="other")
