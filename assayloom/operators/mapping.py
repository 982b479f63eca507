"""Mapping feature groups to genes and annotations."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.reshape import clean_group
from assayloom.schema import FEATURE, GENE, col

# Gene columns of an annotation table, the preferred one first.
PRIMARY_GENE = "Gene Names (primary)"
ALL_GENES = "Gene Names"
LINK = "https://uniprot.org/uniprotkb/"


class GeneMapping(NamedTuple):
    pairs: DataFrame  # (feature, gene)
    unmapped: DataFrame  # features without a gene


def gene_names(database: DataFrame, *, key: str = "Entry") -> DataFrame | None:
    """(id, gene) of one annotation table, or None if it has no gene column."""
    if PRIMARY_GENE in database.columns:
        gene = col(PRIMARY_GENE)
    elif ALL_GENES in database.columns:
        gene = F.element_at(F.split(F.trim(col(ALL_GENES)), r"\s+"), 1)
    else:
        return None
    return database.select(col(key).alias("id"), gene.alias("gene")).filter("gene is not null and gene <> ''")


def genes_of_ids(databases: Sequence[DataFrame], *, key: str = "Entry") -> DataFrame:
    """(id, gene): the first database that knows an id decides."""
    found = [g.withColumn("priority", F.lit(i)) for i, g in enumerate(map(lambda d: gene_names(d, key=key), databases)) if g is not None]
    if not found:
        raise ValueError("none of the databases has a gene column")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("id").agg(F.min(F.struct("priority", "gene")).alias("best")).select("id", F.col("best.gene").alias("gene"))


def map_to_genes(df: DataFrame, databases: Sequence[DataFrame], *, feature: str = FEATURE, key: str = "Entry") -> GeneMapping:
    """Gene pairs of every feature group through its cleaned members."""
    groups = df.select(col(feature)).distinct()
    members = groups.select(col(feature), F.explode(F.array_distinct(clean_group(col(feature)))).alias("id"))
    hits = members.join(genes_of_ids(databases, key=key), "id").select(col(feature), F.col("gene").alias(GENE))
    return GeneMapping(hits, groups.join(hits, feature, "left_anti"))


def add_links(df: DataFrame, *, feature: str = FEATURE, name: str = "Links") -> DataFrame:
    """Blank-joined links of the cleaned members."""
    links = F.transform(clean_group(col(feature)), lambda i: F.concat(F.lit(LINK), i))
    return df.withColumn(name, F.array_join(links, " "))


def add_annotations(
    df: DataFrame, database: DataFrame, fields: Sequence[str] | str | None, *, feature: str = FEATURE, key: str = "Entry"
) -> DataFrame:
    """Add annotation fields to every row of a feature table.

    Each member of a group contributes one value.  If all are equal the value
    stands alone, else they are ``;``-joined with ``None`` for members that are
    not found.  ``Links`` is built from the members themselves.
    """
    fields = [fields] if isinstance(fields, str) else list(fields or [])
    if "Links" in fields:
        df = add_links(df, feature=feature)
    wanted = [f for f in fields if f != "Links"]
    if not wanted:
        return df
    members = df.select(col(feature)).distinct().select(
        col(feature), F.posexplode(clean_group(col(feature))).alias("pos", "id")
    )
    value = lambda f: F.element_at(F.split(F.trim(col(f)), r"\s+"), 1) if ALL_GENES in f else col(f)
    known = database.select(col(key).alias("id"), *[value(f).alias(f"f{i}") for i, f in enumerate(wanted)])
    found = members.join(known, "id", "left").groupBy(col(feature)).agg(
        F.array_sort(F.collect_list(F.struct("pos", *[f"f{i}" for i in range(len(wanted))]))).alias("rows")
    )  # as many entries as the group has members

    def joined(i: int):
        texts = F.transform(F.col(f"rows.f{i}"), lambda v: F.coalesce(v.cast("string"), F.lit("None")))
        same = F.size(F.array_distinct(texts)) == 1
        return F.when(same, F.get(F.col(f"rows.f{i}"), F.lit(0)).cast("string")).otherwise(F.array_join(texts, ";"))

    result = found.select(col(feature), *[joined(i).alias(f) for i, f in enumerate(wanted)])
    return df.join(result, feature, "left")
