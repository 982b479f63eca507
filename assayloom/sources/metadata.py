"""Sample metadata: reading, turning, renaming, and collapsing runs to samples."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.identifiers import text_cell
from assayloom.plans.prefix import group_quantiles
from assayloom.plans.storage import cut
from assayloom.schema import FEATURE, SAMPLE, col, measure_column, require_columns

# Delimiter by file ending.
DELIMITERS = {".csv": ",", ".psv": "|", ".tsv": "\t"}


class Metadata(NamedTuple):
    table: DataFrame
    messages: list[str]


def infer_types(cells: DataFrame) -> DataFrame:
    """Cast text columns whose every cell is a whole number, a number or a truth value."""
    tests = {"bigint": lambda c: c.try_cast("bigint"), "double": lambda c: c.try_cast("double"),
             "boolean": lambda c: F.when(F.lower(c).isin("true", "false"), c)}
    fits = [
        F.bool_and(test(col(c)).isNotNull() | col(c).isNull()).alias(f"{i}|{t}")
        for i, c in enumerate(cells.columns)
        for t, test in tests.items()
    ]
    found = cells.agg(*fits).first().asDict() if cells.columns else {}
    kind = lambda i: next((t for t in tests if found[f"{i}|{t}"]), "string")
    return cells.select(*[col(c).cast(kind(i)).alias(c) for i, c in enumerate(cells.columns)])


def read_metadata(spark: SparkSession, path: str, orientation: str = "Columns") -> Metadata:
    """One row per sample.  With ``Rows`` orientation the file holds one row per property."""
    if path == "":
        raise ValueError("no path to a metadata file")
    ending = next((e for e in DELIMITERS if path.endswith(e)), None)
    if ending is None:
        raise ValueError(f"metadata must end in {' or '.join(DELIMITERS)}: {path!r}")
    raw = spark.read.csv(
        path, sep=DELIMITERS[ending], header=True, inferSchema=False,
        ignoreLeadingWhiteSpace=ending == ".csv", ignoreTrailingWhiteSpace=False, escape='"',
    )
    cells = cut(raw.select(*[text_cell(col(c)).alias(c) for c in raw.columns]))  # read once, looked at three times
    if not cells.columns:
        raise ValueError("The file is empty.")
    if orientation.startswith("Rows"):
        cells = turn(cells)
    table = infer_types(cells)
    messages = [f"Read metadata from {path}."]
    if len(table.columns) > table.count():
        messages.append("The imported table is wider than tall; check its orientation.")
    return Metadata(table, messages)


def turn(cells: DataFrame) -> DataFrame:
    """Swap rows and columns; the first column holds the new column names (a short list)."""
    head, *samples = cells.columns
    names = [r[0] for r in cells.select(col(head)).collect()]  # the properties, i.e. column names
    tall = cells.unpivot([col(head)], [col(s) for s in samples], head + "|sample", "value")
    wide = tall.groupBy(col(head + "|sample")).pivot(head, names).agg(F.first("value"))
    return wide.withColumnRenamed(head + "|sample", head)


def medians_of_runs(
    df: DataFrame, runs: DataFrame, *, run: str = "MS run", name: str = "sample name",
    value: str | None = None, sample: str = SAMPLE, feature: str = FEATURE,
) -> DataFrame:
    """Median over the runs of each named sample."""
    measure = measure_column(df, value)
    require_columns(runs, run, name)
    named = df.join(runs.select(col(run).alias(sample), col(name).alias("__name")), sample, "left")
    named = named.filter(col("__name").isNotNull()).drop(sample).withColumnRenamed("__name", sample)
    medians = group_quantiles(named, [feature, sample], measure, {measure: 0.5})
    return named.select(col(feature), col(sample)).distinct().join(medians, [feature, sample], "left")


def assign_column(metadata: DataFrame, required: str | None, unknown: str | None) -> DataFrame:
    """Rename ``unknown`` to ``required``; nothing to do if either is blank."""
    if not required or not unknown:
        return metadata
    if required in metadata.columns:
        raise ValueError(f"column {required!r} exists; nothing can be renamed to it")
    return metadata.withColumnRenamed(unknown, required)
