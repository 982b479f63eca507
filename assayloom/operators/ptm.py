"""Counting peptide modifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.schema import FEATURE, SAMPLE, col


def amount_and_name(token: Column) -> tuple[Column, Column]:
    """The first number (1 if there is none) and the first text run of a modification token."""
    amount = F.coalesce(F.nullif(F.regexp_extract(token, r"\d+", 0), F.lit("")).cast("int"), F.lit(1))
    name = F.regexp_replace(F.regexp_extract(token, r"\D+", 0), "^ ", "")
    return amount, name


def modification_counts(
    peptides: DataFrame, by: Sequence[str], *, modifications: str = "Modifications"
) -> DataFrame:
    """Long counts (keys, modification, amount).

    A token counts once per row, however often it is listed; an amount above one
    in the token multiplies it, and then the token goes by its bare name.

    Equal texts of one key are counted before they are taken apart.
    """
    keys = [col(b) for b in by]
    texts = peptides.groupBy(*keys, col(modifications).alias("text")).agg(F.count("*").alias("rows"))
    tokens = F.filter(F.array_distinct(F.split("text", ",")), lambda t: t != "")
    amount, name = amount_and_name(F.col("token"))
    many = amount > 1
    return (
        texts.select(*keys, "rows", F.explode(tokens).alias("token"))
        .select(
            *keys,
            F.when(many, name).otherwise(F.col("token")).alias("modification"),
            (F.when(many, amount).otherwise(F.lit(1)) * F.col("rows")).alias("weight"),
        )
        .groupBy(*keys, "modification")
        .agg(F.sum("weight").alias("amount"))
    )


def modifications_per_sample(peptides: DataFrame, *, sample: str = SAMPLE) -> DataFrame:
    """Long counts per sample."""
    return modification_counts(peptides, [sample])


def modifications_per_sample_wide(peptides: DataFrame, names: Sequence[str], *, sample: str = SAMPLE) -> DataFrame:
    """One row per sample, one column per listed modification; zero where it does not occur."""
    counts = modification_counts(peptides, [sample])
    wide = counts.groupBy(col(sample)).pivot("modification", list(names)).agg(F.first("amount"))
    everyone = peptides.select(col(sample)).distinct()
    return everyone.join(wide, sample, "left").na.fill(0, list(names))


def modifications_per_feature(peptides: DataFrame, *, sample: str = SAMPLE, feature: str = FEATURE) -> DataFrame:
    """One text ``(n) name, `` per sample and feature, in name order, empty if there are none.

    Only the distinct modification names of one cell are gathered.
    """
    counts = modification_counts(peptides, [sample, feature])
    texts = counts.groupBy(col(sample), col(feature)).agg(
        F.array_sort(F.collect_list(F.struct("modification", "amount"))).alias("found")
    )
    part = lambda m: F.concat(F.lit("("), m["amount"].cast("string"), F.lit(") "), m["modification"], F.lit(", "))
    texts = texts.select(col(sample), col(feature), F.array_join(F.transform("found", part), "").alias("Modifications"))
    everyone = peptides.select(col(sample), col(feature)).distinct()
    return everyone.join(texts, [sample, feature], "left").na.fill("", ["Modifications"])
