import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import enrich, gsea, mapping
from assayloom.plans.storage import cut
from tests.conftest import column, values


def _groups(spark, *groups):
    return spark.createDataFrame([(g,) for g in groups], "`Protein ID` string")


def test_gene_mapping(spark):
    first = spark.createDataFrame([("a", "ABS"), ("b", "HKL GST"), ("x", None)], "Entry string, `Gene Names` string")
    second = spark.createDataFrame([("a", "WRONG"), ("c", "NNF")], "Entry string, `Gene Names (primary)` string")
    found = mapping.map_to_genes(_groups(spark, "a;b;c", "a-1;b-1_4", "c;d", "d-4;d-8"), [first, second])
    pairs = sorted(tuple(r) for r in found.pairs.collect())
    assert pairs == [("a-1;b-1_4", "ABS"), ("a-1;b-1_4", "HKL"), ("a;b;c", "ABS"), ("a;b;c", "HKL"), ("a;b;c", "NNF"), ("c;d", "NNF")]
    assert values(found.unmapped, "Protein ID") == ["d-4;d-8"]


def test_annotations(spark):
    df = _groups(spark, "P10636", "A234;BBB", "not_found", "A234-1;A234-2;nope")
    database = spark.createDataFrame([("P10636", "MAPT"), ("A234", "ZXY"), ("BBB", "M99")], "Entry string, Gene string")
    found = {r["Protein ID"]: r["Gene"] for r in mapping.add_annotations(df, database, "Gene").collect()}
    assert found == {"P10636": "MAPT", "A234;BBB": "ZXY;M99", "not_found": None, "A234-1;A234-2;nope": "ZXY;None"}
    links = {r["Protein ID"]: r["Links"] for r in mapping.add_annotations(df, None, ["Links"]).collect()}
    assert links["A234;BBB"].split() == ["https://uniprot.org/uniprotkb/A234", "https://uniprot.org/uniprotkb/BBB"]
    assert mapping.add_annotations(df, None, []) is df


@pytest.fixture
def sets(spark):
    members = {"Set1": [1, 2, 3, 4, 7, 8, 9, 10], "Set2": [1, 3, 5, 6, 7, 8, 9, 10]}
    return spark.createDataFrame([("lib", t, f"Gene{i}") for t, g in members.items() for i in g], "library string, term string, gene string")


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(f"Protein{i}", f"Gene{i}") for i in range(1, 7)], "`Protein ID` string, Gene string")


def _changes(spark, name, value):
    return spark.createDataFrame([(f"Protein{i}", value) for i in range(1, 7)], f"`Protein ID` string, {name} double")


def test_over_representation(spark, sets, pairs):
    found = enrich.enrich_regulated(_changes(spark, "fold_change", 1.0), "fold_change", 0.0, pairs, sets, direction="up")
    rows = {r["term"]: r for r in enrich.with_lists(found).collect()}
    assert rows["Set1"]["Overlap"] == "4/8" and rows["Set2"]["Overlap"] == "4/8"
    assert rows["Set1"]["Genes"] == "Gene1;Gene2;Gene3;Gene4" and rows["Set2"]["Proteins"] == "Protein1;Protein3;Protein5;Protein6"
    for r in rows.values():
        assert (r["p_value"], r["adjusted_p_value"], r["combined_score"]) == (1.0, 1.0, 0.0)
        assert r["odds_ratio"] == pytest.approx(0.5294118)


@pytest.mark.parametrize("kind", ["number", "table"])
def test_over_representation_with_background(spark, sets, pairs, kind):
    background = 12 if kind == "number" else spark.createDataFrame([(f"Gene{i}",) for i in range(1, 13)], "gene string")
    found = enrich.enrich_regulated(_changes(spark, "fold_change", -1.0), "fold_change", 1.0, pairs, sets, background, "down")
    for r in found.terms.collect():
        assert r["p_value"] == pytest.approx(0.7272727) and r["adjusted_p_value"] == pytest.approx(0.7272727)
        assert r["odds_ratio"] == pytest.approx(0.9529412)


def test_directions(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", -2.0), ("c", 0.5), ("a", 2.0)], "`Protein ID` string, log2_fc double")
    both = enrich.regulated(df, "log2_fc", 1.0)
    assert column(both.withColumn("n", F.when(F.col("direction") == "up", 1).otherwise(-1)), "Protein ID", "n") == {"a": 1, "b": -1}
    assert enrich.usable_directions(both) == ["up", "down"]
    plain = enrich.regulated(df.withColumnRenamed("log2_fc", "fc"), "fc", 1.0)
    assert plain.filter("direction = 'down'").count() == 2
    only = enrich.regulated(df, "log2_fc", 1.0).filter("direction = 'up'")
    assert enrich.usable_directions(only) == ["up"]
    with pytest.raises(ValueError):
        enrich.usable_directions(only, "down")


def _side(spark, rows):
    terms = spark.createDataFrame([(l, t, p, n) for l, t, p, n, *_ in rows], "library string, term string, adjusted_p_value double, overlap long")
    hits = [(l, t, g, p) for l, t, _, _, genes, proteins in rows for g, p in zip(genes.split(";"), (proteins.split(";") * 9)[: len(genes.split(";"))])]
    return terms, spark.createDataFrame(hits, "library string, term string, gene string, `Protein ID` string")


def test_merged_directions(spark):
    up = _side(spark, [("Set1", "Term1", 0.01, 1, "Gene1", "Protein1"), ("Set2", "Term2", 0.05, 1, "Gene2", "Protein2"), ("Set4", "Term4", 0.001, 2, "Gene4;GeneX", "Protein4;Protein5")])
    down = _side(spark, [("Set2", "Term2", 0.02, 1, "GeneX", "Protein3"), ("Set3", "Term3", 0.03, 1, "Gene4", "Protein4"), ("Set4", "Term4", 0.0001, 1, "GeneX", "Protein3")])
    merged, hits = enrich.merge_directions(up[0], down[0], up[1], down[1])
    got = {r["library"]: (r["adjusted_p_value"], r["overlap"]) for r in merged.collect()}
    assert got == {"Set1": (0.01, 1), "Set2": (0.05, 2), "Set3": (0.03, 1), "Set4": (0.001, 2)}
    united = hits.filter("library = 'Set4'")
    assert set(values(united, "gene")) == {"Gene4", "GeneX"} and set(values(united, "Protein ID")) == {"Protein3", "Protein4", "Protein5"}


def test_top_terms(spark):
    rows = [("a", f"t{i}", i / 100) for i in range(9)] + [("b", f"u{i}", 0.5) for i in range(5)]
    df = spark.createDataFrame(rows, "library string, term string, adjusted_p_value double")
    found = enrich.top_terms(df, 3, 0.5)
    assert values(found, "term") == ["t0", "t1", "t2", "u0", "u1", "u2"]
    assert values(enrich.top_terms(df, 3, 0.05, libraries=["b"]), "term") == []


# ---------------------------------------------------------------------- gsea


def test_ranked_genes(spark):
    group, con = "Protein3-1;Protein3-2;Protein4", "CON__Protein3-1;CON__Protein3-2;CON__Protein3"
    rows = [("Protein1", 0.01, -0.01), ("Protein2", 0.02, -0.02), (group, 0.03, 0.03), (con, 0.035, 0.035), ("Protein5", 0.04, 0.04),
            ("Protein6", 0.001, -0.001), ("Protein7", 0.0001, 0.0001), ("Protein8", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "`Protein ID` string, p double, fc double")
    pairs = spark.createDataFrame(
        [("Protein1", "Gene1"), ("Protein2", "Gene2"), (group, "Gene3"), (group, "Gene4"), (con, "Gene3"), ("Protein5", "Gene5"), ("Protein6", "Gene6")],
        "`Protein ID` string, Gene string",
    )
    up = gsea.rank_genes(df, "p", pairs).orderBy("rank").collect()
    assert [(r["gene"], r["score"]) for r in up] == [("Gene6", 0.001), ("Gene1", 0.01), ("Gene2", 0.02), ("Gene4", 0.03), ("Gene3", 0.035), ("Gene5", 0.04)]
    down = gsea.rank_genes(df, "fc", pairs, "descending").orderBy("rank", "gene").collect()
    assert [(r["gene"], r["score"]) for r in down] == [("Gene5", 0.04), ("Gene3", 0.03), ("Gene4", 0.03), ("Gene6", -0.001), ("Gene1", -0.01), ("Gene2", -0.02)]


def test_gene_intensities(spark, long):
    table = long({"Protein1": [10, 1, 100], "Protein2": [20, 2, 90], "Protein3": [30, 3, 80], "Protein4": [40, 4, 70], "Protein5": [50, 5, 60]})
    pairs = spark.createDataFrame(
        [("Protein1", "Gene1"), ("Protein1", "Gene1-1"), ("Protein2", "Gene2"), ("Protein3", "Gene3"), ("Protein4", "Gene3")], "`Protein ID` string, Gene string"
    )
    found = {(r["gene"], r["Sample"]): r["value"] for r in gsea.gene_intensities(table, pairs).collect()}
    assert len(found) == 12 and found["Gene1-1", "Sample3"] == 100 and [found["Gene3", f"Sample{i}"] for i in (1, 2, 3)] == [35, 3.5, 75]


@pytest.fixture
def ranked(spark):
    n = 120
    df = spark.createDataFrame([(f"p{i}", float(n - 2 * i) / n + 0.001) for i in range(n)], "`Protein ID` string, score double")
    pairs = spark.createDataFrame([(f"p{i}", f"g{i}") for i in range(n)], "`Protein ID` string, Gene string")
    sets = {"top": range(0, 20), "spread": range(0, n, 6), "bottom": range(n - 18, n), "tiny": range(3)}
    gene_sets = spark.createDataFrame([("l", t, f"g{i}") for t, g in sets.items() for i in g], "library string, term string, gene string")
    return n, df, pairs, sets, gene_sets


def test_scores_against_the_full_running_sum(ranked):
    n, df, pairs, sets, gene_sets = ranked
    ranking = cut(gsea.positions(gsea.rank_genes(df, "score", pairs, "descending").drop("rank")))
    scores = np.array([r["score"] for r in ranking.orderBy("position").collect()])
    found = {r["term"]: r["es"] for r in gsea.observed_scores(gsea.sized_sets(gene_sets, ranking, 15, 500), ranking, 1.0)[0].collect()}
    assert set(found) == {"top", "spread", "bottom"}
    for term, es in found.items():
        hit = np.isin(np.arange(n), list(sets[term]))
        walk = np.cumsum(np.where(hit, np.abs(scores) / np.abs(scores[hit]).sum(), -1 / (n - hit.sum())))
        want = walk.max() if abs(walk.max()) > abs(min(walk.min(), 0)) else walk.min()
        assert es == pytest.approx(want)
    curve = gsea.term_curve(ranking, gene_sets.filter("term = 'top'")).orderBy("position").collect()
    hit = np.isin(np.arange(n), list(sets["top"]))
    walk = np.cumsum(np.where(hit, np.abs(scores) / np.abs(scores[hit]).sum(), -1 / (n - hit.sum())))
    assert [r["running_sum"] for r in curve] == pytest.approx(list(walk))


def test_positions_with_many_ties(spark):
    df = spark.createDataFrame([(f"g{i}", 1.0 if i % 3 else float(i)) for i in range(600)], "gene string, score double")
    found = gsea.positions(df).orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(600))
    assert all(a["score"] >= b["score"] for a, b in zip(found, found[1:]))


def test_preranked(ranked):
    _, df, pairs, _, gene_sets = ranked
    found = gsea.gsea_preranked(df, "score", pairs, gene_sets, "descending", permutations=200)
    rows = {r["term"]: r for r in found.terms.collect()}
    assert rows["top"]["es"] > 0.9 and rows["bottom"]["es"] < -0.9
    assert rows["top"]["p_value"] < 0.01 and rows["top"]["fdr"] < 0.1 and rows["top"]["fwer"] < 0.1
    assert rows["spread"]["p_value"] > 0.05
    assert gsea.with_lead_lists(found).filter("term = 'top'").first()["Lead_genes"].split(";")[0] == "g0"


def test_class_gsea(spark, metadata):
    rng = np.random.default_rng(0)
    rows = [(f"Sample{s + 1}", f"p{g}", float(rng.normal(10 + (3 if g < 15 and s < 6 else 0), 1))) for s in range(12) for g in range(60)]
    df = spark.createDataFrame(rows, "Sample string, `Protein ID` string, Intensity double")
    pairs = spark.createDataFrame([(f"p{g}", f"g{g}") for g in range(60)], "`Protein ID` string, Gene string")
    sets = spark.createDataFrame([("l", "up", f"g{g}") for g in range(15)] + [("l", "none", f"g{g}") for g in range(1, 60, 4)], "library string, term string, gene string")
    groups = metadata(["A"] * 6 + ["B"] * 6)
    found = gsea.gsea(df, groups, "Group", "A", "B", pairs, sets, permutations=60)
    rows = {r["term"]: r for r in found.terms.collect()}
    assert rows["up"]["es"] > 0.9 and rows["up"]["p_value"] < 0.1
    assert abs(rows["none"]["es"]) < 0.6
    with pytest.raises(ValueError):
        gsea.gsea(df, groups, "Group", "A", "X", pairs, sets)
    with pytest.raises(ValueError):
        gsea.gsea(df.withColumn("Intensity", -F.col("Intensity")), groups, "Group", "A", "B", pairs, sets, method="log2_ratio_of_classes")


def test_scores_of_shuffled_labels_are_those_of_the_table(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    rows = [(f"g{g}", f"s{i:02}", float(rng.gamma(3.0) * 1e6)) for g in range(6) for i in range(11) if rng.random() > 0.1]
    cells = spark.createDataFrame(rows, "gene string, Sample string, value double")
    first = {f"s{i:02}": bool(rng.random() < 0.5) for i in range(11)}
    labelled = cells.join(spark.createDataFrame(list(first.items()), "Sample string, first boolean"), "Sample")
    for method in gsea.RANKING_METHODS:
        want = {r["gene"]: r["score"] for r in gsea.class_scores(labelled, F.col("first"), method, []).collect()}
        for gene in {r[0] for r in rows}:
            x = np.array([v for g, _, v in rows if g == gene])
            labels = np.array([[float(first[s]) for g, s, _ in rows if g == gene]])
            got = gsea._class_scores(x, labels, method)[0]
            assert (gene not in want and np.isnan(got)) or got == pytest.approx(want[gene], rel=1e-9)


def test_shuffled_labels_keep_the_class_sizes(spark):
    from assayloom.functions.draws import shuffled_positions

    import numpy as np

    for n in (1, 2, 7, 64, 100):
        assert sorted(shuffled_positions(np.arange(n), np.full(n, 12345), np.full(n, n))) == list(range(n))
