"""Readers of search-engine result tables.

Only the header is read on the driver.  All cells arrive as text, are turned
into numbers by expressions, and the wide sample columns are unfolded in the
same scan, so nothing is inferred from the data.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.identifiers import (
    UNIPROT, first_member, is_contaminant, number_cell, rejected_members, text_cell, valid_members,
)
from assayloom.plans.prefix import group_quantiles
from assayloom.schema import FEATURE, SAMPLE, col

# Measures each program offers.
MAXQUANT_MEASURES = ["Intensity", "iBAQ", "LFQ intensity"]
MSFRAGGER_MEASURES = [
    "Intensity",
    "MaxLFQ Total Intensity",
    "MaxLFQ Intensity",
    "Total Intensity",
    "MaxLFQ Unique Intensity",
    "Unique Spectral Count",
    "Unique Intensity",
    "Spectral Count",
    "Total Spectral Count",
]
# Columns that are no samples.
MSFRAGGER_TOTALS = ["Combined Spectral Count", "Combined Unique Spectral Count", "Combined Total Spectral Count"]
DIANN_ANNOTATIONS = ["Protein.Group", "Protein.Names", "Genes", "First.Protein.Description"]
# Endings left over from longer measure names.
LONGER_MEASURE_ENDINGS = ("MaxLFQ Total", "MaxLFQ", "Total", "MaxLFQ Unique", "Unique")


class Imported(NamedTuple):
    table: DataFrame
    contaminants: DataFrame  # groups with a contaminant
    rejected: DataFrame  # identifiers that are not valid


def read_cells(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """A delimited file with a header, every cell as text."""
    return spark.read.csv(path, sep=separator, header=True, inferSchema=False, escape='"')


def _column(df: DataFrame, name: str) -> str:
    if name not in df.columns:
        raise ValueError(f"the file has no column {name!r}")
    return name


# ------------------------------------------------------- identifier groups


def mapped_members(groups: DataFrame, mapping: DataFrame, *, group: str = "group") -> DataFrame:
    """(group, id): the first valid identifier after mapping foreign ids.

    ``mapping`` holds (source_id, uniprot_id, reviewed).  Reviewed targets win;
    unreviewed ones count only for ids without any reviewed target.  Ids that
    already look like a UniProt accession stay.
    """
    best = mapping.filter(col("uniprot_id").isNotNull()).groupBy("source_id").agg(
        F.min(F.struct((~col("reviewed")).alias("rest"), col("uniprot_id"))).alias("best")
    )
    members = groups.select(col(group)).distinct().select(
        col(group), F.posexplode(valid_members(col(group))).alias("pos", "source_id")
    )
    target = F.when(F.col("source_id").rlike(UNIPROT), F.col("source_id")).otherwise(F.col("best.uniprot_id"))
    named = members.join(best, "source_id", "left").select(col(group), "pos", target.alias("id"))
    return named.filter("id is not null").groupBy(col(group)).agg(F.min_by("id", "pos").alias("id"))


def clean_feature_groups(df: DataFrame, mapping: DataFrame | None = None, *, feature: str = FEATURE) -> DataFrame:
    """Replace each group by its first valid identifier (empty text if it has none)."""
    if mapping is None:
        return df.withColumn(feature, first_member(col(feature)))
    named = mapped_members(df.select(col(feature)), mapping, group=feature)
    return df.join(named, feature, "left").withColumn(feature, F.coalesce("id", F.lit(""))).drop("id")


def rejected_identifiers(df: DataFrame, *, feature: str = FEATURE) -> DataFrame:
    """One row per member (with repeats) that is no valid identifier."""
    return df.select(F.explode(rejected_members(col(feature))).alias("id"))


def tidy(
    wide: DataFrame,
    group: str,
    samples: Mapping[str, str],
    measure: str,
    aggregation: str = "Sum",
    mapping: DataFrame | None = None,
) -> Imported:
    """Long intensity table of a wide one; ``samples`` maps column to sample name.

    Rows of a group with a contaminant are set aside, groups become their first
    valid id, rows without one are dropped and rows of one id are aggregated.
    An aggregate of missing values only is missing.
    """
    base = wide.select(text_cell(col(group), "0", "0.0").alias(FEATURE), *[col(c) for c in samples]).filter(
        col(FEATURE).isNotNull()
    )
    foreign = is_contaminant(col(FEATURE))
    own = base.filter(~foreign)
    cleaned = clean_feature_groups(own, mapping).filter(col(FEATURE) != "")
    long = cleaned.select(
        col(FEATURE), *[number_cell(col(c)).alias(s) for c, s in samples.items()]
    ).unpivot([col(FEATURE)], [col(s) for s in samples.values()], SAMPLE, measure)
    keys = [col(SAMPLE), col(FEATURE)]
    how = aggregation.lower()
    if how == "sum":
        table = long.groupBy(*keys).agg(F.sum(col(measure)).alias(measure))
    elif how == "mean":
        table = long.groupBy(*keys).agg(F.avg(col(measure)).alias(measure))
    elif how == "median":
        table = long.groupBy(*keys).agg(F.percentile(col(measure).cast("double"), 0.5).alias(measure))
    else:
        raise ValueError(f"unknown aggregation {aggregation!r}")
    return Imported(table.select(*keys, col(measure)), base.filter(foreign).select(col(FEATURE)), rejected_identifiers(own))


# ---------------------------------------------------------- protein tables


def read_maxquant(
    spark: SparkSession, path: str, measure: str = "Intensity", aggregation: str = "Sum", mapping: DataFrame | None = None
) -> Imported:
    """MaxQuant protein groups: sample columns are ``<measure> <sample>``."""
    if measure not in MAXQUANT_MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    cells = read_cells(spark, path)
    group = _column(cells, "Majority protein IDs")
    prefix = f"{measure} "
    samples = {c: c[len(prefix):] for c in cells.columns if c.startswith(prefix) and "peptides" not in c}
    if not samples:
        raise ValueError(f"{measure} was not found in the file")
    return tidy(cells, group, samples, measure, aggregation, mapping)


def read_msfragger(
    spark: SparkSession, path: str, measure: str = "Intensity", aggregation: str = "Sum", mapping: DataFrame | None = None
) -> Imported:
    """MSFragger combined proteins: sample columns are ``<sample> <measure>``.

    A shorter measure name is also the ending of longer ones; those columns are
    told apart by what is left before the measure.
    """
    if measure not in MSFRAGGER_MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    cells = read_cells(spark, path)
    group = _column(cells, "Protein ID")
    ending = [c for c in cells.columns if c.endswith(measure) and c not in MSFRAGGER_TOTALS]
    samples = {c: c[: -len(measure) - 1] for c in ending}
    samples = {c: s for c, s in samples.items() if not s.endswith(LONGER_MEASURE_ENDINGS)}
    if not samples:
        raise ValueError(f"{measure} was not found in the file")
    return tidy(cells, group, samples, measure, aggregation, mapping)


def read_diann(spark: SparkSession, path: str, aggregation: str = "Sum", mapping: DataFrame | None = None) -> Imported:
    """DIA-NN matrix: sample columns are raw file paths, with either kind of slash."""
    cells = read_cells(spark, path)
    group = _column(cells, "Protein.Ids")
    for name in DIANN_ANNOTATIONS:
        _column(cells, name)
    files = [c for c in cells.columns if c != group and c not in DIANN_ANNOTATIONS]
    samples = {c: re.split(r"[/\\]", c)[-1].removesuffix(".raw") for c in files}
    return tidy(cells, group, samples, "Intensity", aggregation, mapping)


# ---------------------------------------------------------- peptide tables


def _peptide_measure(measure: str) -> str:
    if measure not in MAXQUANT_MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    return "LFQ intensity" if measure == "iBAQ" else measure


def read_peptides(spark: SparkSession, path: str, measure: str = "Intensity", mapping: DataFrame | None = None) -> DataFrame:
    """MaxQuant peptides as long rows (sample, feature, sequence, intensity, PEP)."""
    prefix = f"{_peptide_measure(measure)} "
    cells = read_cells(spark, path)
    for name in ("Leading razor protein", "Sequence", "Missed cleavages", "PEP"):
        _column(cells, name)
    samples = {c: c[len(prefix):] for c in cells.columns if c.startswith(prefix)}
    base = cells.select(
        text_cell(col("Leading razor protein"), "0", "0.0").alias(FEATURE),
        text_cell(col("Sequence"), "0", "0.0").alias("Sequence"),
        number_cell(col("PEP")).alias("PEP"),
        *[number_cell(col(c)).alias(s) for c, s in samples.items()],
    ).filter(col(FEATURE).isNotNull())
    ids = [col(FEATURE), col("Sequence"), col("PEP")]
    long = base.unpivot(ids, [col(s) for s in samples.values()], SAMPLE, "Intensity")
    return clean_feature_groups(long, mapping).select(col(SAMPLE), col(FEATURE), "Sequence", "Intensity", "PEP")


def read_evidence(spark: SparkSession, path: str, measure: str = "Intensity", mapping: DataFrame | None = None) -> DataFrame:
    """MaxQuant evidence: one row per peptide-spectrum match with its modifications."""
    intensity = _peptide_measure(measure)
    cells = read_cells(spark, path)
    words = {"Experiment": SAMPLE, "Leading razor protein": FEATURE, "Sequence": "Sequence",
             "Modifications": "Modifications", "Modified sequence": "Modified sequence", "Raw file": "Raw file"}
    numbers = [intensity, "Missed cleavages", "PEP"]
    for name in (*words, *numbers):
        _column(cells, name)
    long = cells.select(
        *[text_cell(col(c), "0", "0.0").alias(n) for c, n in words.items()], *[number_cell(col(c)).alias(c) for c in numbers]
    ).filter(col(FEATURE).isNotNull())
    order = [SAMPLE, FEATURE, "Sequence", intensity, "Modifications", "Modified sequence", "Missed cleavages", "PEP", "Raw file"]
    return clean_feature_groups(long, mapping).select(*map(col, order))
