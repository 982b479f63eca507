import json
import random

import pytest

from assayloom.plans.workflow import STEPS, load_workflow, run_workflow
from tests.conftest import cells, values


@pytest.fixture
def files(tmp_path):
    rng = random.Random(11)
    samples = [f"s{i:02}" for i in range(12)]
    lines = [["Majority protein IDs", *[f"iBAQ {s}" for s in samples]]]
    for p in range(20):
        shift = 4.0 if p < 3 else 0.0
        row = [2 ** (rng.gauss(10, 0.3) + (shift if i < 6 else 0)) for i in range(12)]
        if p % 5 == 4:
            row[p % 12] = ""
        lines.append([f"P0000{p % 10}" if p < 10 else f"Q0000{p % 10}", *row])
    lines.append(["CON__P1", *[1] * 12])
    groups = tmp_path / "groups.txt"
    groups.write_text("\n".join("\t".join(map(str, x)) for x in lines))
    meta = tmp_path / "meta.csv"
    meta.write_text("Sample,Group\n" + "\n".join(f"{s},{'AD' if i < 6 else 'CTR'}" for i, s in enumerate(samples)))
    return str(groups), str(meta), tmp_path


def _standard(groups, meta):
    step = lambda kind, **inputs: {"type": kind, "form_inputs": inputs}
    return [
        step("MaxQuantImport", file_path=groups, intensity_name="iBAQ", map_to_uniprot=False, aggregation_method="Sum"),
        step("MetadataImport", file_path=meta, feature_orientation="Columns (samples in rows, features in columns)"),
        step("FilterProteinsBySamplesMissing", percentage=0.5),
        step("FilterSamplesByProteinIntensitiesSum", deviation_threshold=3.0),
        step("ImputationByKNN", number_of_neighbours=3),
        step("NormalisationByMedian", percentile=0.5),
        step("TransformationLog", log_base="log2"),
        step("DifferentialExpressionTTest", grouping="Group", group1="CTR", group2="AD", log_base="log2", alpha=0.05, unknown_setting=1),
        step("PlotVolcano", fc_threshold=1),
    ]


def test_the_usual_chain(spark, files):
    groups, meta, folder = files
    found = run_workflow(spark, _standard(groups, meta), folder=str(folder / "out"), keep=["results_df"], strict=False)
    assert values(found["contaminants"], "Protein ID") == ["CON__P1"]
    table = cells(found["protein_df"], "Normalised iBAQ")
    assert len(table) == 12 * 20 and all(v is not None for v in table.values())
    flagged = values(found["volcano_df"].filter("significant"), "Protein ID")
    assert flagged == ["P00000", "P00001", "P00002"]
    assert set(values(found["significant_proteins_df"], "Protein ID")) >= set(flagged)
    assert spark.read.parquet(str(folder / "out" / "results_df")).count() == 20


def test_the_label_of_a_t_test_names_the_other_one(spark, files):
    groups, meta, _ = files
    steps = _standard(groups, meta)[:8]
    by_label = {}
    for label in ("Student's t-Test", "Welch's t-Test"):
        steps[7]["form_inputs"]["ttest_type"] = label
        by_label[label] = {r["df"] for r in run_workflow(spark, steps, strict=False)["results_df"].collect()}
    assert by_label["Welch's t-Test"] == {10.0}
    assert all(df < 10 for df in by_label["Student's t-Test"])


def test_checks(spark, files, tmp_path):
    groups, meta, _ = files
    with pytest.raises(ValueError, match="unknown type"):
        run_workflow(spark, [{"type": "Nothing"}])
    with pytest.raises(ValueError, match="missing"):
        run_workflow(spark, [{"type": "TransformationLog", "form_inputs": {"log_base": "log2"}}])
    path = tmp_path / "w.json"
    path.write_text(json.dumps({"steps": _standard(groups, meta)}))
    assert [s["type"] for s in load_workflow(str(path))][:2] == ["MaxQuantImport", "MetadataImport"]


def test_every_import_and_analysis_has_a_step():
    assert len(STEPS) >= 55
    assert all(callable(f) and isinstance(o, tuple) and o for f, o in STEPS.values())


def test_settings_a_step_does_not_have_raise(spark, long):
    table = long({"A": [1, 2, 9], "B": [1, 3, 8]})
    run = lambda kind, **given: run_workflow(spark, [{"type": kind, "form_inputs": given}], {"protein_df": table})
    with pytest.raises(ValueError, match="unknown"):
        run("ClusteringKMeans", n_clusters=2, colour="red")
    with pytest.raises(ValueError, match="linkage"):
        run("ClusteringHierarchicalAgglomerative", n_clusters=2, linkage="ward")
    with pytest.raises(ValueError, match="method"):
        run("DimensionReductionTSNE")
    assert run("DimensionReductionTSNE", method="principal components")["embedded_data"].count() == 3


def test_a_clustering_step_returns_what_was_tried(spark, long):
    table = long({"A": [1, 1.1, 9, 9.2], "B": [1, 1.2, 9, 9.1]})
    found = run_workflow(spark, [{"type": "ClusteringKMeans", "form_inputs": {"n_clusters": [2, 3], "model_selection": "Grid search", "n_init": 2}}], {"protein_df": table})
    assert found["model_evaluation_df"].columns == ["param_n_clusters", "silhouette_score"] and found["model_evaluation_df"].count() == 2
    assert found["cluster_labels_df"].select("label").distinct().count() == 2
