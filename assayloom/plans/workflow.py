"""Chaining operators from a list of steps.

A step is ``{"type": name, "form_inputs": {...}}``.  Each step reads the newest
tables of the run by name (``protein_df``, ``peptide_df``, ``metadata_df``, ...)
and adds its own.  Nothing but DataFrames is handed on, so Spark plans each
result across all steps that lead to it.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayloom.operators import (
    charts, classify, cluster, embed, enrich, filters, gsea, impute, mapping, normalise, outliers, ptm, sequences, stats,
)
from assayloom.operators.kernels import KERNELS
from assayloom.operators.vectors import require_complete, to_vectors
from assayloom.schema import FEATURE, SAMPLE, col
from assayloom.sources import genesets, metadata as metadata_source, sinks, tables

STEPS: dict[str, tuple[Callable[..., dict], tuple[str, ...]]] = {}


def step(name: str, *outputs: str):
    """Register a function under a step type, with the tables it must return."""

    def register(function):
        STEPS[name] = (function, outputs)
        return function

    return register


def load_workflow(path: str) -> list[dict]:
    """Steps of a YAML (if a YAML reader is installed) or JSON file."""
    with open(path, encoding="utf-8") as file:
        if path.endswith(".json"):
            return json.load(file)["steps"]
        try:
            import yaml
        except ImportError as missing:
            raise ValueError("reading YAML needs a YAML package; use a JSON file") from missing
        return yaml.safe_load(file)["steps"]


def run_workflow(
    spark: SparkSession, steps: Sequence[Mapping], inputs: Mapping[str, object] | None = None,
    *, folder: str | None = None, keep: Sequence[str] = (), strict: bool = True,
) -> dict[str, object]:
    """Run the steps in order and return all named results, the newest of each name.

    Arguments a step does not know raise before it runs, or are ignored unless
    ``strict``; missing ones raise.  Results named in ``keep`` are written below ``folder``.
    """
    results: dict[str, object] = dict(inputs or {})
    results["spark"] = spark
    for number, entry in enumerate(steps, 1):
        name = entry["type"]
        if name not in STEPS:
            raise ValueError(f"step {number}: unknown type {name!r}")
        function, outputs = STEPS[name]
        given = {**results, **(entry.get("form_inputs") or {}), **(entry.get("inputs") or {})}
        known = inspect.signature(function).parameters
        asked = {**(entry.get("form_inputs") or {}), **(entry.get("inputs") or {})}
        unknown = [p for p in asked if p not in known]
        if unknown and strict:
            raise ValueError(f"step {number} ({name}): unknown {unknown}; known are {[p for p in known if p != 'spark']}")
        missing = [p for p, q in known.items() if p not in given and q.default is inspect.Parameter.empty]
        if missing:
            raise ValueError(f"step {number} ({name}): missing {missing}")
        found = function(**{p: given[p] for p in known if p in given})
        absent = [o for o in outputs if o not in found]
        if absent:
            raise ValueError(f"step {number} ({name}): did not return {absent}")
        results.update(found)
    results.pop("spark")
    if folder is not None:
        sinks.write_tables({k: results[k] for k in keep}, folder)
    return results


# ---------------------------------------------------------------- importing


def _imported(found: tables.Imported) -> dict:
    return {"protein_df": found.table, "contaminants": found.contaminants, "filtered_proteins": found.rejected}


def _wanted(map_to_uniprot, id_mapping_df):
    if str(map_to_uniprot) == "True" and id_mapping_df is None:
        raise ValueError("mapping needs the table id_mapping_df (source_id, uniprot_id, reviewed)")
    return id_mapping_df if str(map_to_uniprot) == "True" else None


@step("MaxQuantImport", "protein_df")
def _maxquant(spark, file_path, intensity_name="Intensity", aggregation_method="Sum", map_to_uniprot=False, id_mapping_df=None):
    return _imported(tables.read_maxquant(spark, file_path, intensity_name, aggregation_method, _wanted(map_to_uniprot, id_mapping_df)))


@step("MsFraggerImport", "protein_df")
def _msfragger(spark, file_path, intensity_name="Intensity", aggregation_method="Sum", map_to_uniprot=False, id_mapping_df=None):
    return _imported(tables.read_msfragger(spark, file_path, intensity_name, aggregation_method, _wanted(map_to_uniprot, id_mapping_df)))


@step("DiannImport", "protein_df")
def _diann(spark, file_path, aggregation_method="Sum", map_to_uniprot=False, id_mapping_df=None):
    return _imported(tables.read_diann(spark, file_path, aggregation_method, _wanted(map_to_uniprot, id_mapping_df)))


@step("PeptideImport", "peptide_df")
def _peptides(spark, file_path, intensity_name="Intensity", map_to_uniprot=False, id_mapping_df=None):
    return {"peptide_df": tables.read_peptides(spark, file_path, intensity_name, _wanted(map_to_uniprot, id_mapping_df))}


@step("EvidenceImport", "peptide_df")
def _evidence(spark, file_path, intensity_name="Intensity", map_to_uniprot=False, id_mapping_df=None):
    return {"peptide_df": tables.read_evidence(spark, file_path, intensity_name, _wanted(map_to_uniprot, id_mapping_df))}


@step("MetadataImport", "metadata_df")
def _metadata(spark, file_path, feature_orientation="Columns"):
    return {"metadata_df": metadata_source.read_metadata(spark, file_path, feature_orientation).table}


@step("MetadataImportMethodDiann", "metadata_df", "protein_df")
def _runs(spark, file_path, protein_df, groupby_sample=False):
    runs = metadata_source.read_metadata(spark, file_path).table
    return {"metadata_df": runs, "protein_df": metadata_source.medians_of_runs(protein_df, runs) if groupby_sample else protein_df}


@step("MetadataColumnAssignment", "metadata_df")
def _assign(metadata_df, metadata_required_column=None, metadata_unknown_column=None):
    return {"metadata_df": metadata_source.assign_column(metadata_df, metadata_required_column, metadata_unknown_column)}


# ------------------------------------------------------------ preprocessing


def _filtered(found, key: str) -> dict:
    out = {"protein_df": found.kept, key: found.removed}
    return out if found.peptides is None else {**out, "peptide_df": found.peptides}


@step("FilterProteinsBySamplesMissing", "protein_df")
def _f1(protein_df, peptide_df=None, percentage=0.5):
    return _filtered(filters.by_samples_missing(protein_df, peptide_df, percentage), "filtered_proteins")


@step("FilterByProteinsCount", "protein_df")
def _f2(protein_df, peptide_df=None, deviation_threshold=2.0):
    return _filtered(filters.by_feature_count(protein_df, peptide_df, deviation_threshold), "filtered_samples")


@step("FilterSamplesByProteinsMissing", "protein_df")
def _f3(protein_df, peptide_df=None, percentage=0.5):
    return _filtered(filters.by_features_missing(protein_df, peptide_df, percentage), "filtered_samples")


@step("FilterSamplesByProteinIntensitiesSum", "protein_df")
def _f4(protein_df, peptide_df=None, deviation_threshold=2.0):
    return _filtered(filters.by_intensity_sum(protein_df, peptide_df, deviation_threshold), "filtered_samples")


@step("FilterPeptidesByPEPThreshold", "peptide_df", "filtered_peptides")
def _f5(peptide_df, threshold):
    found = filters.by_pep_value(peptide_df, threshold)
    return {"peptide_df": found.kept, "filtered_peptides": found.removed}


def _outliers(found, table: str) -> dict:
    out = {"protein_df": found.kept, table: found.scores, "outlier_list": found.scores.filter("outlier").select("id")}
    return out if found.peptides is None else {**out, "peptide_df": found.peptides}


@step("OutlierDetectionByPCA", "protein_df", "pca_df")
def _o1(protein_df, peptide_df=None, number_of_components=3, threshold=2):
    found = outliers.by_pca(protein_df, peptide_df, threshold, number_of_components)
    return {**_outliers(found, "pca_df"), "explained_variance_ratio": found.explained}


@step("OutlierDetectionByLocalOutlierFactor", "protein_df", "anomaly_df")
def _o2(protein_df, peptide_df=None, number_of_neighbors=20):
    return _outliers(outliers.by_local_outlier_factor(protein_df, peptide_df, number_of_neighbors), "anomaly_df")


@step("OutlierDetectionByIsolationForest", "protein_df", "anomaly_df")
def _o3(protein_df, peptide_df=None, n_estimators=100):
    return _outliers(outliers.by_isolation_forest(protein_df, peptide_df, n_estimators), "anomaly_df")


@step("TransformationLog", "protein_df")
def _log(protein_df, log_base, peptide_df=None):
    out = {"protein_df": normalise.by_log(protein_df, log_base)}
    return out if peptide_df is None else {**out, "peptide_df": normalise.by_log(peptide_df, log_base, value="Intensity")}


@step("NormalisationByZScore", "protein_df")
def _n1(protein_df):
    return {"protein_df": normalise.by_z_score(protein_df)}


def _normalised(found: normalise.Normalised, key: str) -> dict:
    return {"protein_df": found.table, key: found.samples}


@step("NormalisationByTotalSum", "protein_df")
def _n2(protein_df):
    return _normalised(normalise.by_total_sum(protein_df), "zeroed_samples")


@step("NormalisationByMedian", "protein_df")
def _n3(protein_df, percentile=0.5):
    return _normalised(normalise.by_median(protein_df, percentile), "zeroed_samples")


@step("NormalisationByReferenceProtein", "protein_df")
def _n4(protein_df, reference_protein):
    return _normalised(normalise.by_reference_feature(protein_df, reference_protein), "dropped_samples")


@step("ImputationByMinPerDataset", "protein_df")
def _i1(protein_df, shrinking_value=1.0):
    return {"protein_df": impute.by_min_per_dataset(protein_df, shrinking_value)}


@step("ImputationByMinPerProtein", "protein_df")
def _i2(protein_df, shrinking_value=1.0):
    return {"protein_df": impute.by_min_per_feature(protein_df, shrinking_value)}


@step("ImputationByMinPerSample", "protein_df")
def _i3(protein_df, shrinking_value=1.0):
    return {"protein_df": impute.by_min_per_sample(protein_df, shrinking_value)}


@step("SimpleImputationPerProtein", "protein_df")
def _i4(protein_df, strategy="mean"):
    return {"protein_df": impute.by_simple_statistic(protein_df, strategy)}


@step("ImputationByKNN", "protein_df")
def _i5(protein_df, number_of_neighbours=5):
    return {"protein_df": impute.by_nearest_samples(protein_df, number_of_neighbours)}


@step("ImputationByNormalDistributionSampling", "protein_df")
def _i6(protein_df, strategy="perProtein", down_shift=0.0, scaling_factor=1.0):
    return {"protein_df": impute.by_normal_draws(protein_df, strategy, down_shift, scaling_factor)}


# ----------------------------------------------------------------- analysis


def _compared(df, found: stats.Comparison, *, strict: bool = False) -> dict:
    return {
        "results_df": found.results,
        "differentially_expressed_proteins_df": stats.with_results(df, found.results),
        "significant_proteins_df": stats.with_results(df, stats.significant(found, strict=strict)),
        "corrected_alpha": found.corrected_alpha,
        "filtered_proteins": found.omitted,
    }


@step("DifferentialExpressionTTest", "results_df")
def _t(protein_df, metadata_df, grouping="Group", group1=None, group2=None, ttest_type="Welch's t-Test",
       multiple_testing_correction_method=stats.BENJAMINI_HOCHBERG, alpha=0.05, log_base=None):
    # The labels name the opposite test: "Student's" runs Welch's and the other way round.
    found = stats.t_test(protein_df, metadata_df, grouping, group1, group2, equal_var=ttest_type != "Student's t-Test",
                         method=multiple_testing_correction_method, alpha=alpha, log_base=log_base)
    return _compared(protein_df, found)


@step("DifferentialExpressionLinearModel", "results_df")
def _lm(protein_df, metadata_df, grouping="Group", group1=None, group2=None,
        multiple_testing_correction_method=stats.BENJAMINI_HOCHBERG, alpha=0.05, log_base=None):
    return _compared(protein_df, stats.linear_model(protein_df, metadata_df, grouping, group1, group2,
                                                    method=multiple_testing_correction_method, alpha=alpha, log_base=log_base))


@step("DifferentialExpressionANOVA", "results_df", "sample_group_df")
def _anova(protein_df, metadata_df, grouping="Group", selected_groups=None,
           multiple_testing_correction_method=stats.BENJAMINI_HOCHBERG, alpha=0.05):
    found = stats.anova(protein_df, metadata_df, grouping, selected_groups, method=multiple_testing_correction_method, alpha=alpha)
    return {**_compared(protein_df, found, strict=True),
            "sample_group_df": stats.sample_groups(protein_df, metadata_df, grouping, found.results)}


@step("DifferentialExpressionMannWhitneyOnIntensity", "results_df")
def _mw(protein_df, metadata_df, grouping="Group", group1=None, group2=None,
        multiple_testing_correction_method=stats.BENJAMINI_HOCHBERG, alpha=0.05, log_base=None):
    return _compared(protein_df, stats.mann_whitney(protein_df, metadata_df, grouping, group1, group2,
                                                    method=multiple_testing_correction_method, alpha=alpha, log_base=log_base))


@step("DifferentialExpressionMannWhitneyOnPTM", "results_df")
def _mw_ptm(ptm_df, metadata_df, grouping="Group", group1=None, group2=None,
            multiple_testing_correction_method=stats.BENJAMINI_HOCHBERG, alpha=0.05, columns_name="PTM"):
    found = stats.mann_whitney(ptm_df, metadata_df, grouping, group1, group2, method=multiple_testing_correction_method,
                               alpha=alpha, value="amount", feature="modification")
    return {"results_df": found.results.withColumnRenamed("modification", columns_name), "corrected_alpha": found.corrected_alpha}


@step("SelectPeptidesForProtein", "peptide_df")
def _select(peptide_df, protein_ids):
    ids = [protein_ids] if isinstance(protein_ids, str) else list(protein_ids)
    return {"peptide_df": filters.peptides_containing(peptide_df, ids).drop("matched_id")}


@step("PTMsPerSample", "ptm_df")
def _ptm1(peptide_df):
    return {"ptm_df": ptm.modifications_per_sample(peptide_df)}


@step("PTMsProteinAndPerSample", "ptm_df")
def _ptm2(peptide_df):
    return {"ptm_df": ptm.modifications_per_feature(peptide_df)}


def _vectors(protein_df):
    require_complete(protein_df)
    return to_vectors(protein_df)


def _clusters(found: cluster.Clusters) -> dict:
    out = {"cluster_labels_df": found.labels, "model": found.model}
    if found.centres is not None:
        out["cluster_centers_df"] = found.centres
    if found.probabilities is not None:
        out["cluster_labels_probabilities_df"] = found.probabilities
    return out


def _only(name: str, value, *supported) -> None:
    if value not in supported:
        raise ValueError(f"{name} can be {' or '.join(map(repr, supported))} here, not {value!r}")


def _searched(rows, method, grid, model_selection, scoring, n_iter, fixed) -> dict:
    """Clusters of the best setting and, but for a single one set by hand, the table of all that were tried."""
    _only("model_selection", model_selection, *classify.SEARCHES)
    if model_selection == "Manual" and not any(isinstance(v, (list, tuple)) for v in grid.values()):
        return _clusters(cluster.METHODS[method](rows, **grid, **fixed))
    scores = [scoring] if isinstance(scoring, str) else list(scoring)
    sampled = {"Grid search": None, "Randomized search": n_iter, "Manual": 1}[model_selection]
    found, table = cluster.search(rows, method, grid, scores, sampled=sampled, **fixed)
    return {**_clusters(found), "model_evaluation_df": table}


@step("ClusteringKMeans", "cluster_labels_df")
def _kmeans(protein_df, n_clusters=8, n_init=10, max_iter=300, tolerance=1e-4, random_state=6, init="k-means||", model_selection="Manual",
            model_selection_scoring="silhouette_score", n_iter=10):
    rows, fixed = _vectors(protein_df), {"n_init": n_init, "max_iter": max_iter, "tolerance": tolerance, "seed": random_state, "init": init}
    return _searched(rows, "k_means", {"n_clusters": n_clusters}, model_selection, model_selection_scoring, n_iter, fixed)


@step("ClusteringExpectationMaximisation", "cluster_labels_df")
def _em(protein_df, n_components=1, max_iter=100, random_state=42, model_selection="Manual", model_selection_scoring="silhouette_score", n_iter=10,
        covariance_type="full", reg_covar=1e-6):
    fixed = {"max_iter": max_iter, "seed": random_state, "covariance_type": covariance_type, "reg_covar": reg_covar}
    return _searched(_vectors(protein_df), "expectation_maximisation", {"n_components": n_components}, model_selection, model_selection_scoring, n_iter, fixed)


@step("ClusteringHierarchicalAgglomerative", "cluster_labels_df")
def _hac(protein_df, n_clusters=2, metric="euclidean", linkage="bisecting", model_selection="Manual", model_selection_scoring="silhouette_score", n_iter=10):
    _only("linkage", linkage, "bisecting", "single")
    return _searched(_vectors(protein_df), "hierarchical", {"n_clusters": n_clusters}, model_selection, model_selection_scoring, n_iter, {"metric": metric, "linkage": linkage})


def _labelled(protein_df, metadata_df, labels_column, positive_label):
    rows = _vectors(protein_df).join(metadata_df.select(col(SAMPLE).alias("id"), col(labels_column)), "id")
    coded, codes = classify.encode_labels(rows, labels_column, positive_label, name="label")
    return coded, codes


def _fitted(found: classify.Fitted, codes) -> dict:
    return {"model": found.model, "model_evaluation_df": found.evaluation, "train_df": found.train, "test_df": found.test,
            "predictions_df": found.predictions, "label_codes_df": codes}


@step("ClassificationRandomForest", "model", "model_evaluation_df")
def _rf(protein_df, metadata_df, labels_column="Group", positive_label=None, test_size=0.2, n_estimators=100, criterion="gini",
        max_depth=None, bootstrap=True, validation_strategy="K-Fold", n_splits=5, n_repeats=10, model_selection="Grid search", grid=None, n_iter=10,
        model_selection_scoring="accuracy", split_stratify=True, random_state=42):
    rows, codes = _labelled(protein_df, metadata_df, labels_column, positive_label)
    return _fitted(classify.random_forest(rows, grid, n_estimators=n_estimators, criterion=criterion, max_depth=max_depth, bootstrap=bootstrap,
                                          test_size=test_size, validation=validation_strategy, n_splits=n_splits, n_repeats=n_repeats,
                                          score=model_selection_scoring, stratify=split_stratify, search=model_selection, n_iter=n_iter, seed=random_state), codes)


@step("ClassificationSVM", "model", "model_evaluation_df")
def _svm(protein_df, metadata_df, labels_column="Group", positive_label=None, test_size=0.2, C=1.0,  # noqa: N803
         kernel="linear", tolerance=1e-4, max_iter=100, validation_strategy="K-Fold", n_splits=5, n_repeats=10, model_selection="Grid search", grid=None, n_iter=10,
         model_selection_scoring="accuracy", split_stratify=True, random_state=42, gamma="scale", coef0=0.0, degree=3):
    _only("kernel", kernel, "linear", *KERNELS)
    rows, codes = _labelled(protein_df, metadata_df, labels_column, positive_label)
    return _fitted(classify.svm(rows, grid, c=C, tolerance=tolerance, max_iter=max_iter, test_size=test_size, validation=validation_strategy, n_splits=n_splits,
                                n_repeats=n_repeats, score=model_selection_scoring, stratify=split_stratify, search=model_selection, n_iter=n_iter,
                                seed=random_state, kernel=kernel, gamma=gamma, coef0=coef0, degree=degree), codes)


@step("ModelEvaluationClassificationModel", "scores_df")
def _scores(scoring, model=None, test_df=None, predictions_df=None):
    """Of a model on a test table, or of predictions that are there already."""
    if model is not None and test_df is not None:
        predictions_df = model.transform(test_df)
    if predictions_df is None:
        raise ValueError("scores need a model and its test table, or predictions")
    return {"scores_df": classify.classification_scores(predictions_df, [scoring] if isinstance(scoring, str) else scoring)}


def _embedded(protein_df, n_components):
    return {"embedded_data": embed.principal_components(_vectors(protein_df), n_components).scores}


@step("DimensionReductionTSNE", "embedded_data")
def _tsne(protein_df, method, n_components=2):
    """t-SNE layouts aren't offered: the step runs only if principal components are asked for."""
    _only("method", method, "principal components")
    return _embedded(protein_df, n_components)


@step("DimensionReductionUMAP", "embedded_data", "neighbour_df")
def _umap(protein_df, method, n_components=2, n_neighbors=15, metric="euclidean"):
    """UMAP layouts aren't offered: the step runs only if principal components are asked for; the neighbour graph is exact."""
    _only("method", method, "principal components")
    return {**_embedded(protein_df, n_components), "neighbour_df": embed.neighbour_graph(_vectors(protein_df), n_neighbors, metric)}


@step("ProteinGraphPeptidesToIsoform", "graph", "peptide_matches", "peptide_mismatches")
def _graph(sequence_df, variant_df, peptide_df, k=5, allowed_mismatches=2):
    peptides = peptide_df.select(col("Sequence").alias("peptide")).distinct()
    found = sequences.match_peptides(sequence_df, sequences.split_variants(variant_df)[0], peptides, k, allowed_mismatches)
    return {"graph": found.graph, "peptide_matches": found.matches, "peptide_mismatches": found.unmatched}


@step("ProteinGraphVariationGraph", "graph", "filtered_blocks")
def _variation(sequence_df, variant_df):
    kept, dropped = sequences.split_variants(variant_df)
    return {"graph": sequences.variation_graph(sequence_df, kept), "filtered_blocks": dropped}


# -------------------------------------------------------------- integration


@step("DatabaseIntegrationByGeneMapping", "gene_mapping_df")
def _genes(spark, protein_df, database_names):
    paths = [database_names] if isinstance(database_names, str) else database_names
    found = mapping.map_to_genes(protein_df, [genesets.read_annotations(spark, p) for p in paths])
    return {"gene_mapping_df": found.pairs, "filtered_protein_ids": found.unmapped}


@step("DatabaseIntegrationByUniprot", "results_df")
def _annotate(spark, results_df, database_name=None, fields=None):
    return {"results_df": mapping.add_annotations(results_df, genesets.read_annotations(spark, database_name) if database_name else None, fields)}


@step("EnrichmentAnalysisGOAnalysisOffline", "enrichment_df")
def _ora(spark, results_df, gene_mapping_df, gene_sets_path, differential_expression_col="log2_fold_change",
         differential_expression_threshold=0.0, direction="both", background_path=None, background_number=None):
    background = genesets.read_background(spark, background_path) if background_path else background_number
    found = enrich.enrich_regulated(results_df, differential_expression_col, differential_expression_threshold, gene_mapping_df,
                                    genesets.read_gene_sets(spark, gene_sets_path), background, direction)
    return {"enrichment_df": found.terms, "enrichment_hits_df": found.hits, "filtered_groups": found.unmapped}


def _gsea_out(found: gsea.GeneSetEnrichment) -> dict:
    return {"enrichment_df": found.terms, "leading_df": found.leading, "ranking": found.ranking, "filtered_groups": found.unmapped}


@step("EnrichmentAnalysisWithPrerankedGSEA", "enrichment_df", "ranking")
def _pre(spark, results_df, gene_mapping_df, gene_sets_path, ranking_column="corrected_p_value", ranking_direction="ascending",
         min_size=15, max_size=500, number_of_permutations=1000, weighted_score=1.0, seed=123):
    return _gsea_out(gsea.gsea_preranked(results_df, ranking_column, gene_mapping_df, genesets.read_gene_sets(spark, gene_sets_path),
                                         ranking_direction, min_size=min_size, max_size=max_size, permutations=number_of_permutations,
                                         weighted_score=weighted_score, seed=seed))


@step("EnrichmentAnalysisWithGSEA", "enrichment_df", "ranking")
def _gsea(spark, protein_df, metadata_df, gene_mapping_df, gene_sets_path, group1, group2, grouping="Group",
          ranking_method="signal_to_noise", permutation_type="phenotype", min_size=15, max_size=500,
          number_of_permutations=1000, weighted_score=1.0, seed=123):
    return _gsea_out(gsea.gsea(protein_df, metadata_df, grouping, group1, group2, gene_mapping_df, genesets.read_gene_sets(spark, gene_sets_path),
                               method=ranking_method, permutation_type=permutation_type, min_size=min_size, max_size=max_size,
                               permutations=number_of_permutations, weighted_score=weighted_score, seed=seed))


# -------------------------------------------------------------- chart tables


@step("PlotVolcano", "volcano_df")
def _volcano(results_df, alpha=0.05, fc_threshold=0.0, proteins_of_interest=()):
    return {"volcano_df": charts.volcano(results_df, alpha, fc_threshold, list(proteins_of_interest or ()))}


@step("PlotScatterPlot", "scatter_df")
def _scatter(embedded_data, color_df=None):
    return {"scatter_df": charts.scatter(embedded_data, color_df)}


@step("PlotClustergram", "heat_map_df")
def _heat(protein_df, cluster_labels_df=None, standardize=None, sample_group_df=None):
    return {"heat_map_df": charts.heat_map(protein_df, cluster_labels_df, standardize, sample_group_df)}


@step("PlotProtQuant", "similar_df", "band_df")
def _quant(protein_df, protein_group=None, similarity_measure="euclidean distance", similarity=1.0):
    if protein_group is None:  # the first group by name
        protein_group = protein_df.agg(F.min(col(FEATURE))).first()[0]
    return {"similar_df": charts.similar_features(protein_df, protein_group, similarity, similarity_measure), "band_df": charts.intensity_band(protein_df)}


@step("PlotGOEnrichmentBarPlot", "top_terms_df")
def _bars(enrichment_df, gene_sets=None, top_terms=10, cutoff=0.05):
    return {"top_terms_df": enrich.top_terms(enrichment_df, top_terms, cutoff, libraries=gene_sets)}


@step("PlotGOEnrichmentDotPlot", "top_terms_df")
def _dots(enrichment_df, gene_sets=None, top_terms=5, cutoff=0.05):
    return {"top_terms_df": enrich.top_terms(enrichment_df, top_terms, cutoff, libraries=gene_sets)}


@step("PlotGSEADotPlot", "top_terms_df")
def _gsea_dots(enrichment_df, gene_sets=None, top_terms=10, cutoff=0.05, dot_color_value="fdr"):
    return {"top_terms_df": enrich.top_terms(enrichment_df, top_terms, cutoff, libraries=gene_sets, p=dot_color_value)}


@step("PlotGSEAEnrichmentPlot", "curve_df")
def _curve(spark, ranking, gene_sets_path, term_name):
    members = genesets.read_gene_sets(spark, gene_sets_path).filter(F.col("term") == term_name)
    return {"curve_df": gsea.term_curve(ranking, members)}


@step("PlotPrecisionRecallCurve", "precision_recall_df")
def _pr(predictions_df):
    return {"precision_recall_df": classify.precision_recall_curve(classify.model_scores(predictions_df))}


@step("PlotROC", "roc_df")
def _roc(predictions_df):
    return {"roc_df": classify.roc_curve(classify.model_scores(predictions_df))}
