"""Between long tables and one vector per sample."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.schema import FEATURE, SAMPLE, col, measure_column


def to_vectors(df: DataFrame, *, value: str | None = None, sample: str = SAMPLE, feature: str = FEATURE) -> DataFrame:
    """(id, vec): the values of a sample in feature order.  The table must be complete."""
    measure = measure_column(df, value)
    return df.groupBy(col(sample).alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(col(feature).alias("f"), col(measure).cast("double").alias("x")))).alias("cells")
    ).select("id", F.col("cells.x").alias("vec"))


def require_complete(df: DataFrame, *, value: str | None = None, sample: str = SAMPLE, feature: str = FEATURE) -> None:
    """Raise if a sample x feature cell is missing (one aggregation over the table)."""
    measure = measure_column(df, value)
    row = df.agg(
        F.count_if(col(measure).isNull() | F.isnan(col(measure).cast("double"))).alias("nulls"),
        F.count("*").alias("cells"),
        F.count_distinct(col(sample)).alias("samples"),
        F.count_distinct(col(feature)).alias("features"),
    ).first()
    if row["nulls"] or row["cells"] != row["samples"] * row["features"]:
        raise ValueError("The table has missing values. Consider filtering or imputing them first.")


def with_ml_vector(vectors: DataFrame, name: str = "features") -> DataFrame:
    return vectors.withColumn(name, array_to_vector(F.col("vec").cast("array<double>")))
