"""Transformation and per-sample normalisation of the measure.

Every statistic is a partial aggregation per sample that is joined back, so a
sample holding a large share of all rows never has to sit in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.plans.prefix import group_quantiles, same_keys
from assayloom.schema import FEATURE, SAMPLE, col, measure_column


class Normalised(NamedTuple):
    table: DataFrame
    samples: DataFrame  # zeroed or dropped samples


def _log(x: Column, base: str) -> Column:
    if base == "log2":
        return F.log2(x)
    if base == "log10":
        return F.log10(x)
    raise ValueError(f"unknown log base {base!r}; use 'log2' or 'log10'")


def by_log(df: DataFrame, log_base: str = "log10", *, value: str | None = None) -> DataFrame:
    """Logarithm of the measure; values that have none become null."""
    measure = measure_column(df, value)
    return df.withColumn(measure, _log(col(measure), log_base))


def _replace(df: DataFrame, measure: str, scaled: Column, *helpers: str) -> DataFrame:
    return df.withColumn(f"Normalised {measure}", scaled).drop(measure, *helpers)


def by_z_score(df: DataFrame, *, value: str | None = None, sample: str = SAMPLE) -> DataFrame:
    """Centre and scale each sample; without any spread it is only centred."""
    measure = measure_column(df, value)
    x = col(measure)
    stats = df.groupBy(col(sample)).agg(F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__sd"))
    centred = x - F.col("__mean")
    scaled = F.when(F.col("__sd") == 0, centred).otherwise(F.try_divide(centred, F.col("__sd")))
    return _replace(same_keys(df, stats, [sample]), measure, scaled, "__mean", "__sd")


def _divide(df: DataFrame, measure: str, divisors: DataFrame, sample: str) -> Normalised:
    """Divide by the sample's divisor; a divisor of zero zeroes the sample."""
    zero = F.col("__d") == 0
    scaled = F.when(zero, F.lit(0.0)).otherwise(F.try_divide(col(measure), F.col("__d")))
    table = _replace(same_keys(df, divisors, [sample], "left"), measure, scaled, "__d")
    return Normalised(table, divisors.filter(zero).select(col(sample)))


def by_median(
    df: DataFrame, percentile: float = 0.5, *, value: str | None = None, sample: str = SAMPLE
) -> Normalised:
    """Divide each sample by its own (exact) percentile."""
    if not 0 <= percentile <= 1:
        raise ValueError("percentile must lie between 0 and 1")
    measure = measure_column(df, value)
    return _divide(df, measure, group_quantiles(df, [sample], measure, {"__d": percentile}), sample)


def by_total_sum(df: DataFrame, *, value: str | None = None, sample: str = SAMPLE) -> Normalised:
    """Divide each sample by its summed intensity."""
    measure = measure_column(df, value)
    sums = df.groupBy(col(sample)).agg(F.coalesce(F.sum(col(measure)), F.lit(0.0)).alias("__d"))
    return _divide(df, measure, sums, sample)


def by_reference_feature(
    df: DataFrame,
    reference: str,
    *,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> Normalised:
    """Divide each sample by its value of one feature; samples without a positive one are dropped.

    The reference is the first group (by name) that lists the given id.  If no
    group does, both results are empty.
    """
    measure = measure_column(df, value)
    holds = F.array_contains(F.split(col(feature), ";"), reference)
    candidates = df.filter(holds)
    group = candidates.agg(F.min(col(feature)).alias("g")).scalar()
    found = candidates.filter(col(feature) == group)
    usable = found.filter(col(measure) > 0).select(col(sample), col(measure).alias("__d"))
    known = candidates.agg(F.count("*").alias("n")).scalar() > 0
    dropped = df.select(col(sample)).distinct().filter(known).join(usable, sample, "left_anti")
    scaled = col(measure) / F.col("__d")
    return Normalised(_replace(df.join(usable, sample), measure, scaled, "__d"), dropped)
