"""Column names of the long tables and the checks made on them (no Spark job)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = "Sample"
FEATURE = "Protein ID"
GENE = "Gene"

# Fragments that mark a measure column, in order of preference.
MEASURE_FRAGMENTS = ["intensity", "ibaq", "lfq", "spectral count"]

# Measure names an intensity table may carry.
MEASURE_NAMES = [
    "Intensity",
    "iBAQ",
    "LFQ intensity",
    "MaxLFQ Total Intensity",
    "MaxLFQ Intensity",
    "Total Intensity",
    "MaxLFQ Unique Intensity",
    "Unique Spectral Count",
    "Unique Intensity",
    "Spectral Count",
    "Total Spectral Count",
]


def quoted(name: str) -> str:
    """A column name for SQL text, whatever dots or blanks it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Reference a column literally."""
    return F.col(quoted(name))


def measure_column(df: DataFrame, name: str | None = None) -> str:
    """Name of the measure column: the given one, else the first that looks like a measure."""
    if name is not None:
        if name not in df.columns:
            raise ValueError(f"column {name!r} is not in {df.columns}")
        return name
    for fragment in MEASURE_FRAGMENTS:
        for column in df.columns:
            if fragment in column.lower():
                return column
    raise ValueError(f"no measure column among {df.columns}")


def is_long_format(df: DataFrame) -> bool:
    """True when the table starts with the sample, feature and gene columns."""
    return df.columns[:3] == [SAMPLE, FEATURE, GENE]


def is_intensity_table(df: DataFrame) -> bool:
    """True when the table has sample, feature and a known (or normalised) measure."""
    if SAMPLE not in df.columns or FEATURE not in df.columns:
        return False
    return any(name in column for name in MEASURE_NAMES for column in df.columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def require_columns(df: DataFrame, *names: str) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}; table has {df.columns}")
