"""Chart-ready tables: what a figure would draw, computed where the data is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.filters import keep_share
from assayloom.plans.prefix import group_quantiles
from assayloom.schema import FEATURE, SAMPLE, col, measure_column

__all__ = [
    "keep_share", "box_statistics", "compare_boxes", "histogram", "compare_histograms", "volcano",
    "similar_features", "intensity_band", "scatter", "heat_map",
]


def box_statistics(df: DataFrame, by: str | None = None, *, value: str | None = None) -> DataFrame:
    """Smallest, quartiles and largest value, of all rows or per sample or feature."""
    measure = measure_column(df, value)
    keys = [by] if by else []
    probabilities = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return group_quantiles(df, keys, measure, probabilities)


def compare_boxes(before: DataFrame, after: DataFrame, by: str | None = None) -> DataFrame:
    """Box statistics of two tables, told apart by ``table``."""
    a = box_statistics(before, by).withColumn("table", F.lit("before"))
    return a.unionByName(box_statistics(after, by).withColumn("table", F.lit("after")))


def _range(df: DataFrame, measure: str, logged: bool) -> DataFrame:
    x = F.log10(col(measure)) if logged else col(measure)
    return df.select(x.cast("double").alias("x")).filter("x is not null")


def _binned(values: DataFrame, bounds: DataFrame, bins: int) -> DataFrame:
    """(bin, left, right, n); ``bounds`` is one row (start, size)."""
    place = F.floor(F.try_divide(F.col("x") - F.col("b.start"), F.col("b.size")))
    at_end = (place > 0) & (F.col("x") >= F.col("b.stop")) & (place * F.col("b.size") + F.col("b.start") >= F.col("b.stop"))
    return (
        values.withColumn("b", bounds.select(F.struct("start", "size", "stop")).scalar())
        .select(F.coalesce(F.when(at_end, place - 1).otherwise(place), F.lit(0)).cast("long").alias("bin"), "b")
        .groupBy("bin").agg(F.count("*").alias("n"), F.first("b").alias("b"))
        .select("bin", (F.col("b.start") + F.col("bin") * F.col("b.size")).alias("left"),
                (F.col("b.start") + (F.col("bin") + 1) * F.col("b.size")).alias("right"), "n")
    )


def histogram(df: DataFrame, bins: int = 100, *, logged: bool = False, value: str | None = None) -> DataFrame:
    """Counts per bin between the smallest and the largest value; empty bins are absent."""
    values = _range(df, measure_column(df, value), logged)
    bounds = values.agg(F.min("x").alias("start"), F.max("x").alias("stop")).withColumn(
        "size", (F.col("stop") - F.col("start")) / bins
    )
    return _binned(values, bounds, bins)


def compare_histograms(before: DataFrame, after: DataFrame, bins: int = 100, *, logged: bool = False, overlay: bool = False) -> DataFrame:
    """Histograms of two tables with a common start; with a common bin width for an overlay."""
    parts = {"before": _range(before, measure_column(before), logged), "after": _range(after, measure_column(after), logged)}
    spans = [v.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("table", F.lit(n)) for n, v in parts.items()]
    spans = spans[0].unionByName(spans[1]).withColumn("own", (F.col("hi") - F.col("lo")) / bins)
    whole = spans.agg(F.min("lo").alias("start"), F.max("hi").alias("stop"), F.max("own").alias("widest"))
    out = None
    for name, values in parts.items():
        own = spans.filter(F.col("table") == name).agg(F.max("own").alias("o")).scalar()
        size = F.col("widest") if overlay else F.col("own")
        bounds = whole.withColumn("own", own).select("start", "stop", size.alias("size"))
        one = _binned(values, bounds, bins).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def volcano(
    results: DataFrame, alpha: float = 0.05, fc_threshold: float = 0.0, of_interest: Sequence[str] = (), *,
    p: str = "corrected_p_value", change: str = "log2_fold_change", feature: str = FEATURE,
) -> DataFrame:
    """-log10 p against fold change, with flags for significant and chosen features."""
    strength = -F.log10(col(p))
    flagged = (strength >= -F.log10(F.lit(float(alpha)))) & (F.abs(col(change)) >= fc_threshold)
    chosen = F.arrays_overlap(F.split(col(feature), ";"), F.array(*map(F.lit, of_interest))) if of_interest else F.lit(False)
    return results.select(
        col(feature), col(change), strength.alias("minus_log10_p"),
        F.coalesce(flagged | (col(p) == 0), F.lit(False)).alias("significant"), chosen.alias("of_interest"),
    )


def similar_features(
    df: DataFrame, chosen: str, similarity: float = 1.0, measure_of: str = "euclidean distance", *,
    value: str | None = None, sample: str = SAMPLE, feature: str = FEATURE,
) -> DataFrame:
    """(feature, similarity) of the features whose standardised course is close to the chosen one.

    The chosen feature's rows are one column on the sample; all other features
    are compared in one aggregation.
    """
    if measure_of == "euclidean distance":
        if similarity < 0:
            raise ValueError("a euclidean distance is 0 or more")
    elif measure_of == "cosine similarity":
        if not -1 <= similarity <= 1:
            raise ValueError("a cosine similarity is -1 to 1")
    else:
        raise ValueError(f"unknown similarity measure {measure_of!r}")
    measure = measure_column(df, value)
    stats = df.groupBy(col(feature)).agg(F.avg(col(measure)).alias("__m"), F.stddev_pop(col(measure)).alias("__s"))
    scaled = df.join(stats, feature).select(
        col(sample), col(feature), F.try_divide(col(measure) - F.col("__m"), F.col("__s")).alias("z")
    )
    target = scaled.filter(col(feature) == chosen).select(col(sample), F.col("z").alias("__target"))
    joined = scaled.filter(col(feature) != chosen).join(target, sample)
    if measure_of == "euclidean distance":
        score = F.sqrt(F.sum(F.pow(F.col("z") - F.col("__target"), F.lit(2.0))))
        near = F.col("similarity") <= similarity
    else:
        score = F.try_divide(
            F.sum(F.col("z") * F.col("__target")),
            F.sqrt(F.sum(F.col("z") * F.col("z"))) * F.sqrt(F.sum(F.col("__target") * F.col("__target"))),
        )
        near = F.col("similarity") >= similarity
    whole = F.count("z") == F.count("*")
    return joined.groupBy(col(feature)).agg(F.when(whole, score).alias("similarity")).filter(near)


def intensity_band(df: DataFrame, *, value: str | None = None, sample: str = SAMPLE) -> DataFrame:
    """Smallest and largest value per sample, the band behind a line chart."""
    measure = measure_column(df, value)
    return df.groupBy(col(sample)).agg(F.min(col(measure)).alias("low"), F.max(col(measure)).alias("high"))


def scatter(scores: DataFrame, colour: DataFrame | None = None, *, key: str = "id", colour_key: str = SAMPLE) -> DataFrame:
    """Component or anomaly scores with an optional colour column per sample."""
    if colour is None:
        return scores
    return scores.join(colour.withColumnRenamed(colour_key, key), key, "left")


def heat_map(
    df: DataFrame, labels: DataFrame | None = None, standardise: str | None = None, groups: DataFrame | None = None, *,
    value: str | None = None, sample: str = SAMPLE, feature: str = FEATURE,
) -> DataFrame:
    """Long cells (sample, feature, value, ...), optionally standardised by sample or feature.

    ``labels`` (id, label) orders the rows of a heat map by cluster, ``groups``
    (sample, group...) colours them.
    """
    measure = measure_column(df, value)
    cells = df.select(col(sample), col(feature), col(measure).cast("double").alias("value"))
    if standardise is not None:
        key = {"row": sample, "column": feature}[standardise]
        stats = cells.groupBy(col(key)).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
        cells = cells.join(stats, key).select(
            col(sample), col(feature), F.try_divide(F.col("value") - F.col("__m"), F.col("__s")).alias("value")
        )
    if labels is not None:
        cells = cells.join(labels.select(F.col("id").alias(sample), "label"), sample, "left")
    if groups is not None:
        cells = cells.join(groups, sample, "left")
    return cells
