"""Assay-shaped views of the driver tables, and the same views as SQL text.

A supplier (or nation) is a sample, a part (or its brand) is a feature and the
summed price is the measured intensity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators.reshape import complete_grid
from assayloom.schema import FEATURE, SAMPLE


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _summed(rows: DataFrame, sample: Column, feature: Column) -> DataFrame:
    return rows.groupBy(sample.cast("string").alias(SAMPLE), feature.cast("string").alias(FEATURE)).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("Intensity")
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def lines_with_parts(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    return lines(spark, folder).join(parts, F.col("l_partkey") == F.col("p_partkey"))


def by_part(spark: SparkSession, folder: str) -> DataFrame:
    """supplier x part: most cells are absent."""
    return _summed(lines(spark, folder), F.col("l_suppkey"), F.col("l_partkey"))


def by_brand(spark: SparkSession, folder: str) -> DataFrame:
    """supplier x brand: every cell is present."""
    return _summed(lines_with_parts(spark, folder), F.col("l_suppkey"), F.col("p_brand"))


def by_type(spark: SparkSession, folder: str) -> DataFrame:
    return _summed(lines_with_parts(spark, folder), F.col("l_suppkey"), F.col("p_type"))


def by_group(spark: SparkSession, folder: str) -> DataFrame:
    """supplier x ``brand;type`` group."""
    return _summed(lines_with_parts(spark, folder), F.col("l_suppkey"), F.concat_ws(";", "p_brand", "p_type"))


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def by_nation(spark: SparkSession, folder: str) -> DataFrame:
    """nation x part: about a third of the cells is absent."""
    nations = suppliers(spark, folder).select("s_suppkey", "n_name")
    return _summed(lines(spark, folder).join(nations, F.col("l_suppkey") == F.col("s_suppkey")), F.col("n_name"), F.col("l_partkey"))


def nation_grid(spark: SparkSession, folder: str) -> DataFrame:
    """nation x part with explicit nulls for absent cells."""
    return complete_grid(by_nation(spark, folder))


def groups(spark: SparkSession, folder: str) -> DataFrame:
    return suppliers(spark, folder).select(
        F.col("s_suppkey").cast("string").alias(SAMPLE), F.col("r_name").alias("Group"), F.col("n_name").alias("Batch")
    )


def peptides(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item as a peptide measurement."""
    return lines_with_parts(spark, folder).select(
        F.col("l_suppkey").cast("string").alias(SAMPLE),
        F.concat_ws(";", "p_brand", "p_type").alias(FEATURE),
        F.col("p_name").alias("Sequence"),
        F.col("l_extendedprice").alias("Intensity"),
        F.col("l_discount").alias("PEP"),
        F.concat_ws(",", "l_returnflag", "l_linestatus").alias("Modifications"),
    )


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """log2 ratio of the mean intensity of a part in two regions."""
    labelled = by_part(spark, folder).join(groups(spark, folder), SAMPLE)
    mean = lambda g: F.avg(F.when(F.col("Group") == g, F.col("Intensity")))
    return (
        labelled.groupBy(FEATURE).agg(F.log2(F.try_divide(mean("EUROPE"), mean("ASIA"))).alias("c"))
        .filter("c is not null").select(FEATURE, F.round("c", 6).alias("log2_fold_change"))
    )


def gene_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias(FEATURE), F.col("p_name").alias("Gene"))


def gene_sets(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    return parts.select(F.lit("brand").alias("library"), F.col("p_brand").alias("term"), F.col("p_name").alias("gene")).unionByName(
        parts.select(F.lit("size").alias("library"), F.col("p_size").cast("string").alias("term"), F.col("p_name").alias("gene"))
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def tidy(df: DataFrame, digits: int = 6, value: str | None = None) -> DataFrame:
    """(sample, feature, value) with rounded values, for comparison with SQL."""
    value = value or [c for c in df.columns if "Intensity" in c][0]
    return df.select(F.col(SAMPLE).alias("sample"), F.col(f"`{FEATURE}`").alias("feature"), F.round(F.col(f"`{value}`"), digits).alias("value"))


# ---------------------------------------------------------------- as SQL text

BY_PART = """i as (select cast(l_suppkey as varchar) s, cast(l_partkey as varchar) p, round(sum(l_extendedprice), 2) x
  from lineitem group by 1, 2)"""
BY_BRAND = """i as (select cast(l_suppkey as varchar) s, p_brand p, round(sum(l_extendedprice), 2) x
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""
BY_TYPE = """i as (select cast(l_suppkey as varchar) s, p_type p, round(sum(l_extendedprice), 2) x
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""
BY_GROUP = """i as (select cast(l_suppkey as varchar) s, p_brand || ';' || p_type p, round(sum(l_extendedprice), 2) x
  from lineitem join part on l_partkey = p_partkey group by 1, 2)"""
BY_NATION = """c as (select n_name s, cast(l_partkey as varchar) p, round(sum(l_extendedprice), 2) x
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2)"""
NATION_GRID = BY_NATION + """,
  i as (select a.s, b.p, c.x from (select distinct s from c) a cross join (select distinct p from c) b
        left join c on c.s = a.s and c.p = b.p)"""
GROUPS = """m as (select cast(s_suppkey as varchar) s, r_name g, n_name b
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
PEPTIDES = """pep as (select cast(l_suppkey as varchar) s, p_brand || ';' || p_type p, p_name q, l_extendedprice x,
  l_discount e, l_returnflag r, l_linestatus t from lineitem join part on l_partkey = p_partkey)"""
CHANGES = BY_PART + ", " + GROUPS + """,
  ch as (select p, round(c, 6) c from (
    select p, log2(avg(x) filter (where g = 'EUROPE') / avg(x) filter (where g = 'ASIA')) c
    from i join m using (s) group by p) where c is not null)"""
GENE_SETS = """gs as (select distinct 'brand' l, p_brand t, p_name g from part
  union all select distinct 'size', cast(p_size as varchar), p_name from part)"""
GENE_PAIRS = "gp as (select cast(p_partkey as varchar) p, p_name g from part)"
