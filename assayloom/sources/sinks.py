"""Writing result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, kind: str = "parquet", *, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> str:
    """Write a table as parquet, or as csv with a header, and return its path."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.csv(path, header=True)
    else:
        raise ValueError(f"unknown kind {kind!r}; use 'parquet' or 'csv'")
    return path


def write_tables(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet", *, mode: str = "errorifexists") -> dict[str, str]:
    """Write each named table into a folder of its own."""
    return {name: write_table(df, f"{folder.rstrip('/')}/{name}", kind, mode=mode) for name, df in tables.items()}
