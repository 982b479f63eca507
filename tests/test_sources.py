import pytest

from assayloom.operators import sequences
from assayloom.sources import genesets, metadata, sinks, tables
from tests.conftest import LONG, cells, values


def _file(folder, name, lines):
    path = folder / name
    path.write_text("\n".join("\t".join(map(str, line)) if not isinstance(line, str) else line for line in lines) + "\n")
    return str(path)


def test_maxquant(spark, tmp_path):
    path = _file(tmp_path, "groups.txt", [
        ["Majority protein IDs", "Intensity A", "Intensity B.1", "iBAQ A", "iBAQ peptides", "iBAQ"],
        ["P00000", 1, 6, 5, 9, 9], ["P00000;REV__P12345", "", 2, 7, 9, 9], ["Q11111", 4, 0, "", 9, 9], ["Q11111;CON__P12345", 4, 4, 1, 9, 9],
        ["REV__X", 1, 1, 1, 1, 1],
    ])
    found = tables.read_maxquant(spark, path, "Intensity")
    assert cells(found.table) == {("A", "P00000"): 1, ("B.1", "P00000"): 8, ("A", "Q11111"): 4, ("B.1", "Q11111"): None}
    assert values(found.contaminants, "Protein ID") == ["Q11111;CON__P12345"]
    assert values(found.rejected, "id") == ["REV__P12345", "REV__X"]
    ibaq = tables.read_maxquant(spark, path, "iBAQ").table
    assert ibaq.columns == ["Sample", "Protein ID", "iBAQ"] and cells(ibaq, "iBAQ")["A", "P00000"] == 12
    with pytest.raises(ValueError, match="not found"):
        tables.read_maxquant(spark, path, "LFQ intensity")
    other = _file(tmp_path, "other.txt", [["ids", "Intensity A"], ["P00000", 1]])
    with pytest.raises(ValueError, match="Majority protein IDs"):
        tables.read_maxquant(spark, other, "Intensity")


@pytest.mark.parametrize("how, expected", [("Sum", 8.0), ("Mean", 4.0), ("Median", 4.0)])
def test_aggregation_of_duplicates(spark, tmp_path, how, expected):
    path = _file(tmp_path, "groups.txt", [["Majority protein IDs", "Intensity A", "Intensity B"], ["P00000", 6, ""], ["P00000;P00001", 2, 0]])
    assert cells(tables.read_maxquant(spark, path, "Intensity", how).table) == {("A", "P00000"): expected, ("B", "P00000"): None}


@pytest.mark.parametrize("place, measure", list(enumerate(tables.MSFRAGGER_MEASURES, start=1)))
def test_msfragger_measures_are_told_apart(spark, tmp_path, place, measure):
    heads = [f"run 1 {m}" for m in tables.MSFRAGGER_MEASURES]
    path = _file(tmp_path, "combined.tsv", [
        ["Protein ID", *heads, "Combined Spectral Count", "Combined Total Spectral Count"], ["P00000", *range(1, 10), 99, 99],
    ])
    assert cells(tables.read_msfragger(spark, path, measure).table, measure) == {("run 1", "P00000"): place}


def test_diann(spark, tmp_path):
    path = _file(tmp_path, "matrix.tsv", [
        ["Protein.Group", "Protein.Ids", "Protein.Names", "Genes", "First.Protein.Description", r"D:\a b\LM1.raw", "/home/x/LM2.raw"],
        ["x", "A0A2R2Y2Q3;J3KN67", "n", "g", "d", 329042.0, ""],
    ])
    assert cells(tables.read_diann(spark, path).table) == {("LM1", "A0A2R2Y2Q3"): 329042.0, ("LM2", "A0A2R2Y2Q3"): None}


def test_identifier_groups(spark):
    expected = {
        "P12345;Q12345-3;A0A009IHW8-8-7-6;M99999_7-8": "P12345", "P12345-9;P12345;P12345-1;P00000;P12345-11": "P12345-9",
        "ENSP12345678901.1;NP_123456;XP_123456789;NP_123456789": "ENSP12345678901", "P12345_VAR_38832": "P12345",
        "REV__P12345;YP_123456789;0000000;TAU-98": "",
    }
    df = spark.createDataFrame([("S", g, 1.0) for g in expected], LONG).withColumnRenamed("Sample", "x").selectExpr("`Protein ID` as g", "`Protein ID`")
    found = tables.clean_feature_groups(df)
    assert {r["g"]: r["Protein ID"] for r in found.collect()} == expected
    assert values(tables.rejected_identifiers(df), "id") == sorted(["REV__P12345", "YP_123456789", "0000000", "TAU-98"])


def test_identifier_mapping(spark):
    mapping = spark.createDataFrame(
        [("NP_123456", "P54321", True), ("NP_123456", "A00000", False), ("NP_777777", "Q54321", False)], "source_id string, uniprot_id string, reviewed boolean"
    )
    groups = ["NP_123456;P12321", "XP_123456789", "NP_777777", "P11111;NP_123456"]
    df = spark.createDataFrame([(g, g) for g in groups], "g string, `Protein ID` string")
    found = {r["g"]: r["Protein ID"] for r in tables.clean_feature_groups(df, mapping).collect()}
    assert found == {groups[0]: "P54321", groups[1]: "", groups[2]: "Q54321", groups[3]: "P11111"}


def test_peptides_and_evidence(spark, tmp_path):
    path = _file(tmp_path, "peptides.txt", [
        ["Sequence", "Missed cleavages", "Leading razor protein", "PEP", "Intensity", "Intensity S1", "Intensity S2", "LFQ intensity S1"],
        ["AAA", 0, "P00000", 0.01, 9, 5, "", 7], ["BBB", 1, "", 0.02, 9, 5, 6, 8],
    ])
    found = tables.read_peptides(spark, path, "Intensity").collect()
    assert sorted((r["Sample"], r["Intensity"], r["PEP"]) for r in found if r["Intensity"]) == [("S1", 5.0, 0.01)]
    assert len(found) == 2
    assert tables.read_peptides(spark, path, "iBAQ").first()["Intensity"] == 7.0
    path = _file(tmp_path, "evidence.txt", [
        ["Sequence", "Modifications", "Modified sequence", "Missed cleavages", "Leading razor protein", "Raw file", "Experiment", "PEP", "Intensity", "Charge"],
        ["AAA", "Unmodified", "_AAA_", 0, "CON__P00000", "r1", "S1", 0.5, 10, 2], ["AAA", "Unmodified", "_AAA_", 1, "P00000-2", "r1", "S1", 0, 10, 2],
    ])
    rows = {r["Protein ID"]: r for r in tables.read_evidence(spark, path).collect()}
    assert rows[""]["Missed cleavages"] is None and rows["P00000-2"]["PEP"] is None
    with pytest.raises(ValueError):
        tables.read_evidence(spark, path, "other")


def test_metadata(spark, tmp_path):
    columns = _file(tmp_path, "m.csv", ["Sample, Group,Age,Ok", "a, AD,25,true", "b,CTR,30,false"])
    found = metadata.read_metadata(spark, columns)
    assert dict(found.table.dtypes) == {"Sample": "string", "Group": "string", "Age": "bigint", "Ok": "boolean"}
    assert [tuple(r) for r in found.table.orderBy("Sample").collect()] == [("a", "AD", 25, True), ("b", "CTR", 30, False)]
    assert len(found.messages) == 2  # wider than tall
    rows = _file(tmp_path, "m.psv", ["Sample|a|b", "Group|AD|CTR", "Age|25|30.5"])
    turned = metadata.read_metadata(spark, rows, "Rows (features in rows)").table
    assert [tuple(r) for r in turned.select("Sample", "Group", "Age").orderBy("Sample").collect()] == [("a", "AD", 25.0), ("b", "CTR", 30.5)]
    for wrong in ("", "m.png"):
        with pytest.raises(ValueError):
            metadata.read_metadata(spark, wrong)
    table = found.table
    assert metadata.assign_column(table, "Batch", "Group").columns == ["Sample", "Batch", "Age", "Ok"]
    assert metadata.assign_column(table, "", "Group") is table
    with pytest.raises(ValueError):
        metadata.assign_column(table, "Group", "Age")


def test_medians_of_runs(spark):
    df = spark.createDataFrame([("r1", "A", 1.0), ("r2", "A", 3.0), ("r3", "A", None), ("r3", "B", 9.0), ("r4", "A", 5.0)], LONG)
    runs = spark.createDataFrame([("r1", "x"), ("r2", "x"), ("r3", "y")], "`MS run` string, `sample name` string")
    assert cells(metadata.medians_of_runs(df, runs)) == {("x", "A"): 2.0, ("y", "A"): None, ("y", "B"): 9.0}


@pytest.mark.parametrize("name, lines", [
    ("s.csv", ["Set1,G1,G2, ,", "Set2,G1"]), ("s.txt", ["Set1\tG1\tG2\t", "Set2\tG1"]),
    ("s.json", ['{"Set1": ["G1", "G2", ""],', ' "Set2": ["G1"]}']), ("s.gmt", ["Set1\tnote\tG1\tG2", "Set2\tnote\tG1"]),
    ("s.jsonl", ['{"Set1": ["G1", "G2"]}', '{"Set2": ["G1"]}']),
])
def test_gene_sets(spark, tmp_path, name, lines):
    found = genesets.read_gene_sets(spark, _file(tmp_path, name, lines), "lib")
    assert sorted(tuple(r) for r in found.collect()) == [("lib", "Set1", "G1"), ("lib", "Set1", "G2"), ("lib", "Set2", "G1")]


def test_quoted_and_very_long_lines_of_gene_sets(spark, tmp_path):
    many = [f'"gene ""{i}"", of many"' for i in range(30_000)]
    lines = ['"Set, one",G1,"G ""2""",,G3', ",".join(["Long", *many]), 'Odd,a"b,c']
    found = genesets.read_gene_sets(spark, _file(tmp_path, "q.csv", lines), "lib")
    assert sorted(r["gene"] for r in found.filter("term = 'Set, one'").collect()) == ['G "2"', "G1", "G3"]
    assert found.filter("term = 'Long'").select("gene").distinct().count() == 30_000
    assert found.filter("term = 'Long'").filter("gene = 'gene \"7\", of many'").count() == 1
    assert sorted(r["gene"] for r in found.filter("term = 'Odd'").collect()) == ['a"b', "c"]


def test_backgrounds_and_annotations(spark, tmp_path):
    assert values(genesets.read_background(spark, _file(tmp_path, "b.csv", ["G1,x", "G2,y", ",z"])), "gene") == ["G1", "G2"]
    assert values(genesets.read_background(spark, _file(tmp_path, "b.txt", ["G1", " ", "G2 "])), "gene") == ["G1", "G2"]
    assert genesets.read_background(spark, None) is None
    for wrong in ("x.abc",):
        with pytest.raises(ValueError):
            genesets.read_background(spark, wrong)
        with pytest.raises(ValueError):
            genesets.read_gene_sets(spark, wrong)
    path = _file(tmp_path, "uniprot.tsv", [["Entry", "Gene Names", "Length"], ["P1", "A B", 10], ["P2", "", 20], ["P3", "C", 30]])
    assert genesets.annotation_columns(spark, path) == ["Entry", "Gene Names", "Length"]
    ids = spark.createDataFrame([("P1",), ("P2",)], "id string")
    found = genesets.read_annotations(spark, path, ids, ["Gene Names"])
    assert sorted(tuple(r) for r in found.collect()) == [("P1", "A B"), ("P2", None)]


def test_sinks(spark, tmp_path, long):
    table = long({"A": [1, None]})
    paths = sinks.write_tables({"t": table}, str(tmp_path / "out"))
    assert cells(spark.read.parquet(paths["t"])) == cells(table)
    path = sinks.write_table(table, str(tmp_path / "c"), "csv")
    assert spark.read.csv(path, header=True).count() == 2


ENTRY = """ID   made_up        Unreviewed;         12 AA.
AC   made_up
FT   VARIANT         4
FT                   /note="D -> V (things)"
FT                   /id="x"
FT   VARIANT         5..6
FT                   /note="Missing (in a strain)"
FT   VARIANT         7
FT                   /note="A -> KV"
SQ   SEQUENCE   12 IDK; 1234 IDK; ABC12;
     ABCDEGABCD ET
//
"""


def test_flat_files(spark, tmp_path):
    path = tmp_path / "entries.txt"
    path.write_text(ENTRY + ENTRY.replace("made_up", "other").replace("     ABCDEGABCD ET\n", "") + ENTRY.replace("made_up", "bare").replace("SQ   SEQUENCE   12 IDK; 1234 IDK; ABC12;\n", ""))
    entries = sequences.read_flat_files(spark, str(path))
    assert [tuple(r) for r in sequences.proteins(entries).collect()] == [("made_up", "ABCDEGABCDET", 12)]
    assert values(sequences.incomplete_entries(entries), "protein_id") == ["bare", "other"]
    kept, dropped = sequences.split_variants(sequences.variants(entries).filter("protein_id = 'made_up'"))
    assert sorted((r["pos"], r["end_pos"], r["ref"], r["alt"]) for r in kept.collect()) == [(4, 4, "D", "V"), (5, 6, None, "")]
    assert [r["alt"] for r in dropped.collect()] == ["KV"]
