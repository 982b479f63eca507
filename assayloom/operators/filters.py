"""Row filters on intensity and peptide tables.

Decisions are small per-key tables that reach the long table by semi joins; the
scalar thresholds are scalar subqueries and never leave the plan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.plans.prefix import group_quantiles
from assayloom.schema import FEATURE, SAMPLE, col, measure_column


class Filtered(NamedTuple):
    kept: DataFrame
    removed: DataFrame  # the distinct keys that were filtered out
    peptides: DataFrame | None = None


def _by_key(df: DataFrame, peptides: DataFrame | None, key: str, decided: DataFrame) -> Filtered:
    """Split on a table (key, keep); rows of keys that are not in it stay."""
    removed = decided.filter(~F.coalesce("keep", F.lit(False))).select(col(key))
    return Filtered(
        df.join(removed, key, "left_anti"),
        removed,
        None if peptides is None else peptides.join(removed, key, "left_anti"),
    )


def by_samples_missing(
    df: DataFrame,
    peptides: DataFrame | None = None,
    percentage: float = 0.5,
    *,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> Filtered:
    """Keep features observed in at least this share of all samples."""
    measure = col(measure_column(df, value))
    n_samples = df.agg(F.count_distinct(col(sample)).alias("n")).scalar()
    decided = df.groupBy(col(feature)).agg(F.count(measure).alias("n")).select(
        col(feature), (F.col("n") >= F.lit(float(percentage)) * n_samples).alias("keep")
    )
    return _by_key(df, peptides, feature, decided)


def by_features_missing(
    df: DataFrame,
    peptides: DataFrame | None = None,
    percentage: float = 0.5,
    *,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> Filtered:
    """Keep samples in which at least this share of all features was observed."""
    measure = col(measure_column(df, value))
    n_features = df.agg(F.count_distinct(col(feature)).alias("n")).scalar()
    observed = F.count_distinct(F.when(measure.isNotNull(), col(feature)))
    decided = df.groupBy(col(sample)).agg(observed.alias("n")).select(
        col(sample), (F.col("n") >= F.lit(float(percentage)) * n_features).alias("keep")
    )
    return _by_key(df, peptides, sample, decided)


def _within_band(scores: DataFrame, key: str, deviations: float) -> DataFrame:
    """(key, keep): the score lies within median +- deviations x sample deviation."""
    median = group_quantiles(scores, [], "score", {"m": 0.5}).scalar()
    spread = scores.agg(F.stddev_samp("score").alias("s")).scalar()
    limit = F.lit(float(deviations)) * F.col("__spread")
    return (
        scores.withColumn("__median", median)
        .withColumn("__spread", spread)
        .select(
            col(key),
            F.col("score").between(F.col("__median") - limit, F.col("__median") + limit).alias("keep"),
        )
    )


def by_intensity_sum(
    df: DataFrame,
    peptides: DataFrame | None = None,
    deviation_threshold: float = 2.0,
    *,
    value: str | None = None,
    sample: str = SAMPLE,
) -> Filtered:
    """Keep samples whose summed intensity is close to the median sum."""
    measure = col(measure_column(df, value))
    scores = df.groupBy(col(sample)).agg(F.coalesce(F.sum(measure), F.lit(0.0)).alias("score"))
    return _by_key(df, peptides, sample, _within_band(scores, sample, deviation_threshold))


def by_feature_count(
    df: DataFrame,
    peptides: DataFrame | None = None,
    deviation_threshold: float = 2.0,
    *,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> Filtered:
    """Keep samples whose number of observed features is close to the median number.

    Samples without any observed feature do not enter the statistic and stay.
    """
    measure = col(measure_column(df, value))
    scores = (
        df.filter(measure.isNotNull())
        .groupBy(col(sample))
        .agg(F.count_distinct(col(feature)).cast("double").alias("score"))
    )
    return _by_key(df, peptides, sample, _within_band(scores, sample, deviation_threshold))


def by_pep_value(peptides: DataFrame, threshold: float, *, pep: str = "PEP", sequence: str = "Sequence") -> Filtered:
    """Remove peptide rows whose error probability is below the threshold."""
    low = F.coalesce(col(pep) < F.lit(float(threshold)), F.lit(False))
    return Filtered(peptides.filter(~low), peptides.filter(low).select(col(sequence)).distinct())


def peptides_of_features(
    peptides: DataFrame, wanted: DataFrame, *, feature: str = FEATURE, wanted_id: str = "id"
) -> DataFrame:
    """Peptide rows of the wanted ids; a row that belongs to two wanted ids comes twice.

    Ids are compared with the members of the ``;`` group by an equi-join.
    """
    members = peptides.withColumn("__member", F.explode(F.array_distinct(F.split(col(feature), ";"))))
    ids = wanted.select(col(wanted_id).alias("__member")).distinct()
    return members.join(ids, "__member").withColumnRenamed("__member", "matched_id")


def peptides_containing(peptides: DataFrame, ids: list[str], *, feature: str = FEATURE) -> DataFrame:
    """As ``peptides_of_features``, but an id matches anywhere in the group text.

    The ids are typed in by the caller (a handful), hence they are literals and
    every row is tested once in a map-only plan.
    """
    hits = F.filter(F.array(*map(F.lit, ids)), lambda i: F.contains(col(feature), i))
    return peptides.withColumn("matched_id", F.explode(hits))


def peptides_for_isoforms(
    peptides: DataFrame,
    protein_id: str,
    groups: DataFrame | None = None,
    selected: list[str] | None = None,
    *,
    grouping: str = "Group",
    value: str = "Intensity",
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> DataFrame:
    """Distinct observed peptide sequences of a protein, within the selected groups if given.

    Rows that belong to one named isoform (``id-<n>`` and nothing else) are left out.
    """
    isoform_only = col(feature).rlike("^" + _quoted(protein_id) + r"-\d+$")
    found = peptides.filter(F.contains(col(feature), F.lit(protein_id)) & ~isoform_only).filter(
        col(value).isNotNull() & (col(value) != 0)
    )
    if groups is not None and selected:
        found = restrict_to_groups(found, groups, grouping, selected, sample=sample)
    return found.select("Sequence").distinct()


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def most_significant(results: DataFrame, p: str = "corrected_p_value", *, feature: str = FEATURE) -> DataFrame:
    """The feature with the smallest corrected p-value (ties: first by name)."""
    return results.filter(col(p).isNotNull()).orderBy(col(p), col(feature)).select(col(feature), col(p)).limit(1)


def restrict_to_groups(
    df: DataFrame, metadata: DataFrame, grouping: str, selected: list[str], *, sample: str = SAMPLE
) -> DataFrame:
    """Rows whose sample belongs to one of the selected groups."""
    members = metadata.filter(col(grouping).isin(selected)).select(col(sample)).distinct()
    return df.join(members, sample, "left_semi")


def keep_share(kept: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Counts of kept and filtered keys, the input of a share chart."""
    n_kept = kept.agg(F.count_distinct(col(key)).alias("n")).withColumn("part", F.lit("kept"))
    n_removed = removed.agg(F.count_distinct(col(key)).alias("n")).withColumn("part", F.lit("filtered"))
    return n_kept.unionByName(n_removed).select("part", "n")


def present(value: Column) -> Column:
    """Turn NaN and zero into null, the rule for numbers read from result files."""
    return F.nullif(F.nanvl(value.cast("double"), F.lit(None).cast("double")), F.lit(0.0))
