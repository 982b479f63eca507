import pytest
from pyspark.sql import functions as F

from assayloom import schema
from assayloom.operators import filters, impute, normalise, reshape
from tests.conftest import LONG, cells, values


@pytest.fixture
def gaps(long):
    return long({"A": [7, 6, None, None], "B": [None, 9, 8, None], "C": [11, 2, None, 0], "D": [30, None, None, None], "E": [6, 4, 5, None], "F": [None, 3, None, None]})


@pytest.fixture
def peptides(spark):
    """A peptide of every sample for each of three proteins, and one more of the last protein."""
    rows = [
        (f"Sample{i}", protein, sequence, 100.0 * i + j, 0.01 * j)
        for i in range(1, 5)
        for j, (protein, sequence) in enumerate([("Alpha", "LVK"), ("Beta", "MNPR"), ("Gamma", "TYQK"), ("Gamma", "WWER")])
    ]
    return spark.createDataFrame(rows, "Sample string, `Protein ID` string, Sequence string, Intensity double, PEP double")


@pytest.mark.parametrize("share, gone", [(0.3, ["Sample4"]), (0.5, ["Sample3", "Sample4"]), (0.8, ["Sample1", "Sample3", "Sample4"])])
def test_samples_by_missing_features(gaps, peptides, share, gone):
    found = filters.by_features_missing(gaps, peptides, share)
    assert values(found.removed, "Sample") == gone
    assert not set(values(found.kept, "Sample")) & set(gone)
    assert set(values(found.peptides, "Sample")) == set(values(found.kept, "Sample"))


@pytest.mark.parametrize("share, gone", [(1.0, ["A", "B", "C", "D", "E", "F"]), (0.75, ["A", "B", "D", "F"]), (0.5, ["D", "F"]), (0.25, []), (0.0, [])])
def test_features_by_missing_samples(gaps, share, gone):
    assert values(filters.by_samples_missing(gaps, percentage=share).removed, "Protein ID") == gone


def test_samples_by_sum_and_by_count(gaps):
    # sums 54, 24, 13, 0: median 18.5, deviation 22.97
    assert values(filters.by_intensity_sum(gaps, deviation_threshold=2.0).removed, "Sample") == []
    assert values(filters.by_intensity_sum(gaps, deviation_threshold=1.0).removed, "Sample") == ["Sample1"]
    # counts 4, 5, 2, 1: median 3, deviation 1.826
    assert values(filters.by_feature_count(gaps, deviation_threshold=1.0).removed, "Sample") == ["Sample2", "Sample4"]
    assert values(filters.by_feature_count(gaps, deviation_threshold=0.3).removed, "Sample") == ["Sample1", "Sample2", "Sample3", "Sample4"]


def test_single_sample_has_no_band(long):
    found = filters.by_intensity_sum(long({"A": [1], "B": [2]}), deviation_threshold=2.0)
    assert values(found.removed, "Sample") == ["Sample1"]


def test_samples_without_values_stay_in_the_count_filter(long):
    table = long({"A": [1, 1, None], "B": [1, 1, None]})
    assert values(filters.by_feature_count(table, deviation_threshold=1.0).kept, "Sample") == ["Sample1"] * 2 + ["Sample2"] * 2 + ["Sample3"] * 2


def test_pep_filter_removes_low_values_and_keeps_missing(spark):
    rows = [("S", "A", "X", 1.0, 0.01), ("S", "A", "Y", 1.0, 0.5), ("S", "A", "Z", 1.0, None)]
    table = spark.createDataFrame(rows, "Sample string, `Protein ID` string, Sequence string, Intensity double, PEP double")
    found = filters.by_pep_value(table, 0.05)
    assert values(found.kept, "Sequence") == ["Y", "Z"] and values(found.removed, "Sequence") == ["X"]


def test_peptides_of_features(peptides, spark):
    assert values(filters.peptides_containing(peptides, ["Beta"]), "Sequence") == ["MNPR"] * 4
    ids = spark.createDataFrame([("Gamma",), ("nowhere",)], "id string")
    assert filters.peptides_of_features(peptides, ids).count() == 8


def test_peptides_for_isoforms(spark, metadata):
    rows = [
        ("Sample1", "Q1", "own", 5.0), ("Sample2", "Q1-3", "other isoform", 6.0), ("Sample3", "Q1-2;Q1", "own of a group", 7.0),
        ("Sample1", "R7", "measured", 8.0), ("Sample2", "R7", "missing", None), ("Sample3", "R7", "zero", 0.0),
    ]
    table = spark.createDataFrame(rows, "Sample string, `Protein ID` string, Sequence string, Intensity double")
    groups = metadata(["ill", "well", "ill"])
    find = lambda *a: values(filters.peptides_for_isoforms(table, *a), "Sequence")
    assert find("Q1") == ["own", "own of a group"]
    assert find("R7") == ["measured"]
    assert find("Q1", groups, ["well"]) == []


# ----------------------------------------------------------------- normalise


@pytest.fixture
def shapes(spark):
    table = {"Sample_1": [0] * 9, "Sample_2": range(1, 10), "Sample_3": [30, 30, 40, 20, 0, 60, 40, 20, 0], "Sample_4": [0, 0, 0, 1, 20, 10, 0, 20, 0]}
    return spark.createDataFrame([(s, f"P{i}", float(x)) for s, xs in table.items() for i, x in enumerate(xs)], LONG)


def _row(df, sample):
    found = cells(df)
    return [round(found[sample, f"P{i}"], 3) + 0.0 for i in range(9)]


def test_z_score(shapes):
    found = normalise.by_z_score(shapes)
    assert found.columns == ["Sample", "Protein ID", "Normalised Intensity"]
    assert _row(found, "Sample_1") == [0] * 9
    assert _row(found, "Sample_2") == [-1.549, -1.162, -0.775, -0.387, 0, 0.387, 0.775, 1.162, 1.549]
    assert _row(found, "Sample_3") == [0.183, 0.183, 0.730, -0.365, -1.461, 1.826, 0.730, -0.365, -1.461]
    assert _row(found, "Sample_4") == [-0.687, -0.687, -0.687, -0.566, 1.738, 0.525, -0.687, 1.738, -0.687]


def test_median(shapes):
    found = normalise.by_median(shapes)
    assert _row(found.table, "Sample_2") == [0.2, 0.4, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8]
    assert _row(found.table, "Sample_3") == [1, 1, 1.333, 0.667, 0, 2, 1.333, 0.667, 0]
    assert _row(found.table, "Sample_4") == [0] * 9
    assert values(found.samples, "Sample") == ["Sample_1", "Sample_4"]
    for wrong in (-1, 1.1):
        with pytest.raises(ValueError):
            normalise.by_median(shapes, wrong)


def test_total_sum(shapes):
    found = normalise.by_total_sum(shapes)
    assert _row(found.table, "Sample_2") == [0.022, 0.044, 0.067, 0.089, 0.111, 0.133, 0.156, 0.178, 0.2]
    assert _row(found.table, "Sample_4") == [0, 0, 0, 0.02, 0.392, 0.196, 0, 0.392, 0]
    assert values(found.samples, "Sample") == ["Sample_1"]
    shares = found.table.groupBy("Sample").agg(F.sum("`Normalised Intensity`").alias("t")).collect()
    assert {round(r["t"], 9) for r in shares if r["Sample"] != "Sample_1"} == {1.0}


def test_reference_feature(spark):
    first, second, third = "XCV993;ABC32;BBD55;AB9393", "MNSZ9", "G99490;ABC321"
    table = {"Sample_1": [0, 0, 30], "Sample_2": [10, 2, 3], "Sample_3": [30, 30, 90], "Sample_4": [None, 0, 0]}
    rows = [(s, p, None if x is None else float(x)) for s, xs in table.items() for p, x in zip((first, second, third), xs)]
    df = spark.createDataFrame(rows, LONG)
    found = normalise.by_reference_feature(df, "ABC32")
    got = {k: round(v, 3) for k, v in cells(found.table).items()}
    assert got == {("Sample_2", first): 1, ("Sample_2", second): 0.2, ("Sample_2", third): 0.3,
                   ("Sample_3", first): 1, ("Sample_3", second): 1, ("Sample_3", third): 3}
    assert values(found.samples, "Sample") == ["Sample_1", "Sample_4"]
    absent = normalise.by_reference_feature(df, "nowhere")
    assert absent.table.count() == 0 and absent.samples.count() == 0


def test_log(long):
    table = long({"A": [8, 0, None]})
    assert cells(normalise.by_log(table, "log2")) == {("Sample1", "A"): 3.0, ("Sample2", "A"): None, ("Sample3", "A"): None}
    with pytest.raises(ValueError):
        normalise.by_log(table, "ln")


# -------------------------------------------------------------------- impute


@pytest.fixture
def holes(long):
    return long({"Protein1": [None, 1, 100], "Protein2": [20, None, None], "Protein3": [10, 2, 80]})


@pytest.mark.parametrize("fill, expected", [
    (lambda d: impute.by_nearest_samples(d, 2), (50.5, 20, 20)),
    (lambda d: impute.by_simple_statistic(d, "mean"), (50.5, 20, 20)),
    (lambda d: impute.by_simple_statistic(d, "median"), (50.5, 20, 20)),
    (lambda d: impute.by_simple_statistic(d, "most_frequent"), (1, 20, 20)),
    (lambda d: impute.by_min_per_sample(d, 0.2), (2, 0.2, 16)),
    (lambda d: impute.by_min_per_feature(d, 1.0), (1, 20, 20)),
    (lambda d: impute.by_min_per_dataset(d, 0.1), (0.1, 0.1, 0.1)),
])
def test_fills(holes, fill, expected):
    before, after = cells(holes), cells(fill(holes))
    missing = [("Sample1", "Protein1"), ("Sample2", "Protein2"), ("Sample3", "Protein2")]
    assert [round(after[k], 9) for k in missing] == list(expected)
    assert {k: v for k, v in after.items() if k not in missing} == {k: v for k, v in before.items() if v is not None}


@pytest.mark.parametrize("fill, keeps", [
    (lambda d: impute.by_simple_statistic(d), False), (lambda d: impute.by_min_per_feature(d), False),
    (lambda d: impute.by_nearest_samples(d, 2), False), (lambda d: impute.by_min_per_dataset(d), True),
])
def test_features_without_any_value(long, fill, keeps):
    table = long({"A": [1, 2], "B": [None, None]})
    assert (("Sample1", "B") in cells(fill(table))) is keeps


def test_nearest_samples_against_brute_force(spark):
    import math
    import random

    rng = random.Random(4)
    n, p, k = 30, 40, 3
    x = [[None if rng.random() < 0.3 else rng.random() for _ in range(p)] for _ in range(n)]
    rows = [(f"s{i:02}", f"p{j:02}", x[i][j]) for i in range(n) for j in range(p)]
    got = cells(impute.by_nearest_samples(spark.createDataFrame(rows, LONG).repartition(5), k))

    def distance(a, b):
        both = [(u - v) ** 2 for u, v in zip(x[a], x[b]) if u is not None and v is not None]
        return math.sqrt(p / len(both) * sum(both)) if both else math.inf

    for i in range(n):
        for j in range(p):
            if x[i][j] is None:
                donors = sorted((distance(i, d), d) for d in range(n) if x[d][j] is not None)[:k]
                assert got[f"s{i:02}", f"p{j:02}"] == pytest.approx(sum(x[d][j] for _, d in donors) / k)


def test_normal_draws(holes, spark):
    low = cells(impute.by_normal_draws(holes, "perProtein", -10.0))
    assert 0 < low["Sample1", "Protein1"] < 1e-5  # two values: fitted; one value: left alone
    assert low["Sample2", "Protein2"] is None
    everywhere = cells(impute.by_normal_draws(holes, "perDataset", -10.0))
    assert all(v is not None and v >= 1 for k, v in everywhere.items() if k in {("Sample1", "Protein1"), ("Sample2", "Protein2")})
    again = cells(impute.by_normal_draws(holes.repartition(7), "perDataset", -10.0))
    assert again == pytest.approx(everywhere)
    single = spark.createDataFrame([("S", "A", 1.0), ("T", "A", None)], LONG)
    assert cells(impute.by_normal_draws(single, "perDataset"))["T", "A"] is None


def test_quality_and_counts(holes, long):
    assert impute.flag_invalid_values(holes).missing.first()["missing"] == 3
    assert values(impute.flag_invalid_values(long({"A": [2, 2], "B": [1, 2]})).constant, "Protein ID") == ["A"]
    assert impute.number_of_imputed_values(holes, impute.by_min_per_dataset(holes)).first()["imputed"] == 3


# ------------------------------------------------------------------- reshape


def test_wide_and_back(holes):
    wide = reshape.long_to_wide(holes, ["Protein1", "Protein2", "Protein3"])
    assert wide.count() == 3
    assert cells(reshape.wide_to_long(wide, "Intensity")) == cells(holes)
    assert reshape.duplicate_keys(holes).count() == 0
    assert reshape.duplicate_keys(holes.unionByName(holes.limit(1))).count() == 1


def test_grid(holes):
    observed = holes.filter("Intensity is not null")
    assert cells(reshape.complete_grid(observed)) == cells(holes)


def test_grid_is_unfolded_as_the_last_step(spark, monkeypatch):
    monkeypatch.setattr(reshape, "SAMPLES_UNFOLDED", 2)
    rows = [(f"s{i}", f"p{j}", float(i * j)) for i in range(5) for j in range(4) if (i + j) % 3] + [("s1", "p1", 7.0), ("s2", None, 8.0)]
    found = reshape.complete_grid(spark.createDataFrame(rows, LONG))
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # a join here would shuffle the grid
    held = {(s, p) for s, p, _ in rows}
    want = [r for r in rows if r[1]] + [(f"s{i}", p, None) for i in range(5) for p in ("p0", "p1", "p2", "p3", None) if p is None or (f"s{i}", p) not in held]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))


def test_grid_keeps_all_samples_next_to_a_null_one(spark):
    rows = [(f"s{i}", f"p{j}", float(i + j)) for i in range(6) for j in range(3) if i != j] + [(None, "p1", 5.0)]
    found = [tuple(r) for r in reshape.complete_grid(spark.createDataFrame(rows, LONG)).collect()]
    held = {(s, p): x for s, p, x in rows if s}
    assert sorted(map(str, found)) == sorted(str((s, p, held.get((s, p)))) for s in [None, *(f"s{i}" for i in range(6))] for p in ("p0", "p1", "p2"))


def test_grid_stays_small_in_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('sample', id % 2000) as Sample", "concat('protein', (id * 7919) % 500) as `Protein ID`", "id / 2 as Intensity")
    reshape.complete_grid(rows).write.parquet(str(tmp_path / "grid"))
    size = sum(f.stat().st_size for f in (tmp_path / "grid").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "grid")).count() == 2000 * 500 + 2000
    assert size < 1e6, size  # below a byte a row: the same samples come again and again


def test_identifiers(spark):
    df = spark.createDataFrame([("S", "P1-2;P1_VAR;Q7;P1", 1.0)], LONG)
    assert reshape.with_clean_groups(df).first()["Protein ID"] == "P1;Q7;P1"


def test_schema_checks(spark, holes):
    assert schema.measure_column(holes) == "Intensity"
    assert schema.is_intensity_table(holes) and not schema.is_long_format(holes)
    assert schema.is_intensity_table(normalise.by_z_score(holes))
    both = spark.createDataFrame([(1.0, 2.0)], "`iBAQ` double, `LFQ intensity` double")
    assert schema.measure_column(both) == "LFQ intensity"
    with pytest.raises(ValueError):
        schema.measure_column(spark.createDataFrame([(1,)], "a int"))


def test_rows_without_sample_stay_in_their_own_group(spark):
    rows = [(None, "A", 1.0), (None, "B", 3.0), ("S", "A", 2.0), ("S", "B", 2.0)]
    table = spark.createDataFrame(rows, LONG)
    scored = normalise.by_z_score(table).collect()
    assert sorted((r["Sample"] or "", r["Protein ID"], r["Normalised Intensity"]) for r in scored) == [("", "A", -1), ("", "B", 1), ("S", "A", 0), ("S", "B", 0)]
    shared = normalise.by_total_sum(table).table.collect()
    assert sorted((r["Sample"] or "", r["Normalised Intensity"]) for r in shared) == [("", 0.25), ("", 0.75), ("S", 0.5), ("S", 0.5)]
    halves = normalise.by_median(table).table.collect()
    assert sorted((r["Sample"] or "", r["Normalised Intensity"]) for r in halves) == [("", 0.5), ("", 1.5), ("S", 1), ("S", 1)]


def test_a_feature_twice_in_a_sample_has_no_wide_form(spark):
    table = spark.createDataFrame([("S", "A", 1.0), ("S", "A", 2.0), ("T", "A", 3.0)], LONG)
    assert reshape.duplicate_keys(table).count() == 1
    with pytest.raises(Exception, match="twice"):
        reshape.long_to_wide(table, ["A"]).collect()
    assert reshape.long_to_wide(table.filter("Sample = 'T'"), ["A"]).first()["A"] == 3.0
