"""Filling missing values (null cells) of an intensity table.

Missing cells are explicit rows with a null value, as the readers and
``complete_grid`` produce them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.functions.draws import normal
from assayloom.plans.blocks import nearest_donors
from assayloom.plans.prefix import group_quantiles
from assayloom.plans.storage import cut
from assayloom.schema import FEATURE, SAMPLE, col, measure_column


def _fill(df: DataFrame, measure: str, fill: Column, *helpers: str) -> DataFrame:
    names = [c for c in df.columns if c not in helpers]
    return df.withColumn(measure, F.coalesce(col(measure), fill)).select(*map(col, names))


def by_simple_statistic(
    df: DataFrame,
    strategy: str = "mean",
    *,
    value: str | None = None,
    feature: str = FEATURE,
) -> DataFrame:
    """Fill with the feature's mean, median or most frequent (smallest on ties) value.

    Features without any value are dropped.
    """
    measure = measure_column(df, value)
    x = col(measure)
    observed = df.filter(x.isNotNull())
    if strategy == "mean":
        fills = observed.groupBy(col(feature)).agg(F.avg(x).alias("__fill"))
    elif strategy == "median":
        fills = group_quantiles(observed, [feature], measure, {"__fill": 0.5})
    elif strategy == "most_frequent":
        counted = observed.groupBy(col(feature), x.alias("__x")).agg(F.count("*").alias("__n"))
        best = F.max(F.struct(F.col("__n"), (-F.col("__x")).alias("low")))
        fills = counted.groupBy(col(feature)).agg((-best["low"]).alias("__fill"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return _fill(df.join(fills, feature), measure, F.col("__fill"), "__fill")


def by_min_per_sample(
    df: DataFrame, shrinking_value: float = 1.0, *, value: str | None = None, sample: str = SAMPLE
) -> DataFrame:
    """Fill with a share of the sample's smallest value; empty samples stay empty."""
    measure = measure_column(df, value)
    lows = df.groupBy(col(sample)).agg((F.min(col(measure)) * float(shrinking_value)).alias("__fill"))
    return _fill(df.join(lows, sample), measure, F.col("__fill"), "__fill")


def by_min_per_feature(
    df: DataFrame, shrinking_value: float = 1.0, *, value: str | None = None, feature: str = FEATURE
) -> DataFrame:
    """Fill with a share of the feature's smallest value; features without a value are dropped."""
    measure = measure_column(df, value)
    lows = df.groupBy(col(feature)).agg((F.min(col(measure)) * float(shrinking_value)).alias("__fill"))
    return _fill(df.join(lows.filter("__fill is not null"), feature), measure, F.col("__fill"), "__fill")


def by_min_per_dataset(df: DataFrame, shrinking_value: float = 1.0, *, value: str | None = None) -> DataFrame:
    """Fill with a share of the smallest value of the whole table."""
    measure = measure_column(df, value)
    low = df.agg((F.min(col(measure)) * float(shrinking_value)).alias("m")).scalar()
    return _fill(df, measure, low)


def by_normal_draws(
    df: DataFrame,
    strategy: str = "perProtein",
    down_shift: float = 0.0,
    scaling_factor: float = 1.0,
    *,
    seed: int = 0,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> DataFrame:
    """Fill with powers of ten of normal draws fitted to the log10 values.

    ``perProtein`` fits every feature by itself and skips those with fewer than
    two values.  ``perDataset`` fits once, with a location of at least zero and
    draws made positive; it too needs two values.
    """
    if strategy not in ("perProtein", "perDataset"):
        raise ValueError(f"unknown strategy {strategy!r}")
    measure = measure_column(df, value)
    logged = F.log10(col(measure))
    fit = [F.avg(logged).alias("__mean"), F.stddev_samp(logged).alias("__sd"), F.count(col(measure)).alias("__n")]
    if strategy == "perProtein":
        fitted = df.join(df.groupBy(col(feature)).agg(*fit), feature)
        mean, sd, n = F.col("__mean"), F.col("__sd"), F.col("__n")
        helpers = ["__mean", "__sd", "__n"]
    else:
        fitted = df.withColumn("__fit", df.agg(F.struct(*fit).alias("f")).scalar())
        mean, sd, n = F.col("__fit.__mean"), F.col("__fit.__sd"), F.col("__fit.__n")
        helpers = ["__fit"]
    draw = normal(seed, col(sample), col(feature)) * sd * float(scaling_factor)
    location = mean + float(down_shift) * sd
    if strategy == "perDataset":
        exponent = F.abs(F.greatest(location, F.lit(0.0)) + draw)
    else:
        exponent = location + draw
    return _fill(fitted, measure, F.when(n >= 2, F.pow(F.lit(10.0), exponent)), *helpers)


def by_nearest_samples(
    df: DataFrame,
    neighbours: int = 5,
    *,
    value: str | None = None,
    sample: str = SAMPLE,
    feature: str = FEATURE,
) -> DataFrame:
    """Fill with the mean over the nearest samples that have the feature.

    Samples are compared on their common features; the squared distance is
    scaled up to all features.  Without any comparable sample the feature's mean
    is used.  Features without a value are dropped.
    """
    measure = measure_column(df, value)
    means = (
        df.groupBy(col(feature)).agg(F.avg(col(measure)).alias("__mean")).filter("__mean is not null")
    )
    kept = cut(df.join(means, feature))  # numbered, tiled and filled below
    donors = nearest_donors(kept.drop("__mean"), neighbours, sample, feature, measure)
    fills = donors.groupBy(col(sample), col(feature)).agg(F.avg("donor_value").alias("__near"))
    joined = kept.join(fills, [sample, feature], "left")
    return _fill(joined, measure, F.coalesce("__near", "__mean"), "__near", "__mean").select(*map(col, df.columns))


class Quality(NamedTuple):
    missing: DataFrame  # one row: number of null cells
    constant: DataFrame  # features whose measure has a single distinct value


def flag_invalid_values(df: DataFrame, *, value: str | None = None, feature: str = FEATURE) -> Quality:
    """Remaining nulls and constant features."""
    measure = col(measure_column(df, value))
    span = df.groupBy(col(feature)).agg(F.min(measure).alias("lo"), F.max(measure).alias("hi"))
    return Quality(
        df.agg(F.count_if(measure.isNull()).alias("missing")),
        span.filter("lo = hi").select(col(feature)),
    )


def number_of_imputed_values(before: DataFrame, after: DataFrame, *, value: str | None = None) -> DataFrame:
    """How many null cells were filled: one row."""
    nulls = lambda d: d.agg(F.count_if(col(measure_column(d, value)).isNull()).alias("n")).scalar()
    return before.sparkSession.range(1).select((nulls(before) - nulls(after)).alias("imputed"))
