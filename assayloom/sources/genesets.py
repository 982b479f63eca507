"""Gene sets, backgrounds and annotation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.identifiers import text_cell
from assayloom.schema import col


def _ending(path: str, allowed: Sequence[str], what: str) -> str:
    if not path:
        raise ValueError(f"no path to {what}")
    for ending in allowed:
        if path.endswith(ending):
            return ending
    raise ValueError(f"{what} are read from {' or '.join(allowed)}: {path!r}")


def _members(parts: Column, skip: int) -> DataFrame:
    return F.explode(F.filter(F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0))), lambda g: F.trim(g) != ""))


def read_gene_sets(spark: SparkSession, path: str, library: str = "") -> DataFrame:
    """(library, term, gene) rows of a csv, txt, json, jsonl or gmt file; blank members are dropped.

    A ``.json`` file is one document and one task reads it; large libraries belong
    into a ``.jsonl`` file with an object of one or more sets per line.
    """
    ending = _ending(path, (".csv", ".txt", ".json", ".jsonl", ".gmt"), "gene sets")
    if ending in (".json", ".jsonl"):
        text = spark.read.text(path, wholetext=ending == ".json")
        sets = text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("term", "genes"))
        rows = sets.select("term", F.explode("genes").alias("gene")).filter(F.trim("gene") != "")
    else:
        lines = spark.read.text(path)
        if ending == ".csv":
            # a cell, quoted or not, from the start or a comma on; nothing is looked at twice
            cells = F.regexp_extract_all("value", F.lit(r'(?:^|,)(?:"(?:[^"]++|"")*+"(?=,|$)|[^,]*+)'), F.lit(0))
            parts = F.transform(
                cells, lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^,", ""), '^"(.*)"$', "$1"), '""', '"')
            )
        else:
            parts = F.split(F.trim("value"), "\t")
        skip = 2 if ending == ".gmt" else 1
        rows = lines.filter(F.length("value") > 0).select(F.get(parts, F.lit(0)).alias("term"), _members(parts, skip).alias("gene"))
    return rows.select(F.lit(library).alias("library"), "term", "gene")


def read_background(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(gene) rows: first column of a csv, or one gene per line of a txt file."""
    if not path:
        return None
    if _ending(path, (".csv", ".txt"), "background") == ".csv":
        cells = spark.read.csv(path, header=False, inferSchema=False)
        genes = cells.select(text_cell(col(cells.columns[0])).alias("gene"))
    else:
        genes = spark.read.text(path).select(F.trim("value").alias("gene"))
    return genes.filter(F.length("gene") > 0)


def annotation_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of an annotation file; reads its header only."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False).columns


def read_annotations(
    spark: SparkSession, path: str, ids: DataFrame | None = None, fields: Sequence[str] | None = None, *, key: str = "Entry"
) -> DataFrame:
    """Rows of the wanted entries with the wanted fields, from a tab-separated file or parquet folder."""
    if path.endswith(".parquet"):
        table = spark.read.parquet(path)
    else:
        raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False, escape='"')
        table = raw.select(*[text_cell(col(c)).alias(c) for c in raw.columns])
    if fields is not None:
        table = table.select(col(key), *[col(f) for f in fields if f != key])
    if ids is not None:
        wanted = ids.select(col(ids.columns[0]).alias(key))
        table = table.join(wanted, key, "left_semi")
    return table
